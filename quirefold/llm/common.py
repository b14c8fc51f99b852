"""Pieces shared by the corpus operators: word hashing, shared-folder tables, components, exact cuts."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space. Python's ``bytes.split`` cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words, 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        own = f"__{name}"
        while own in taken:
            own += "_"
        taken.add(own)
        out.append(own)
    return out


def join_few(rows: DataFrame, few: DataFrame, on: str, key: str, most: int, bits: int = 24) -> DataFrame:
    """``rows`` with the columns of ``few`` (distinct in ``key``) where rows' ``on`` equals it, nulls elsewhere.

    Up to ``most`` rows of ``few`` are broadcast. Of more, a bitmap of 2**bits hashed keys (2 MB, whatever their number) is: rows that it rules out stay where they are, and only the
    others are shuffled to the join, where Spark's skew join splits a common key.
    """
    if few.count() <= most:
        return rows.join(F.broadcast(few), F.col(on) == F.col(key), "left")
    cell = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    words = few.select(cell(F.col(key)).alias("x")).groupBy(F.shiftright("x", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(x % 32 as int))")).alias("m")).toPandas()
    table = np.zeros(1 << (bits - 5), dtype=np.uint32)
    table[words["w"].to_numpy(dtype=np.int64)] = words["m"].to_numpy(dtype=np.int64).astype(np.uint32)
    shared = rows.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def maybe(x: pd.Series) -> pd.Series:
        v = x.fillna(0).to_numpy(dtype=np.int64)
        return pd.Series((shared.value[v >> 5] >> (v & 31).astype(np.uint32) & np.uint32(1)).astype(bool))

    can = F.col(on).isNotNull() & maybe(cell(F.col(on)))
    apart = rows.where(~can).select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in few.schema))
    return apart.unionByName(rows.where(can).join(few, F.col(on) == F.col(key), "left"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local session gets a temporary one; a cluster must name its own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        named = f"file://{tempfile.mkdtemp(prefix='spark-checkpoint-')}"
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quirefold-{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to Parquet in the shared folder and read back: cuts lineage, survives lost executors, computes once."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Lowers what Spark hands to Python at a time to ``rows`` rows and ``size`` bytes: whole texts may be long.

    Only ever lowers the session's settings, and changes no result.
    """
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}", None)
        least = int(now) if now and now.isdigit() else 0
        if not 0 < least <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def releasing(run: Batches) -> Batches:
    """``run``, after which the worker gives memory that it no longer uses back to the system: workers live on beside the next stages' tasks."""

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
        if trim:
            trim(0)

    return released


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Batches sorted by key and tile, recut so that none splits a group, with the groups' starts and ends."""
    held: list[pa.RecordBatch] = []

    def grouped(parts: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        t = pa.Table.from_batches(parts)
        keys, tiles = t["key"].to_numpy(), t["tile"].to_numpy()
        start = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (tiles[1:] != tiles[:-1])])
        return t, start, np.r_[start[1:], len(keys)]

    for b in batches:
        if not b.num_rows:
            continue
        key, tile = b.column("key").to_numpy(), b.column("tile").to_numpy()
        last = int(np.argmax((key == key[-1]) & (tile == tile[-1])))
        if held and (last or held[-1].column("key")[0] != b.column("key")[0] or held[-1].column("tile")[0] != b.column("tile")[0]):
            yield grouped([*held, b.slice(0, last)] if last else held)
            held = []
        elif last:
            yield grouped([b.slice(0, last)])
        held.append(b.slice(last))
    if held:
        yield grouped(held)


class WordHashes(dict):
    """Word bytes to a 64-bit hash, remembered between batches up to a bound."""

    LIMIT = 1 << 17

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive hashes of every run of k words; empty if there are fewer."""
    n = len(word_hashes) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + word_hashes[i : i + n]
    return mix(out)


class TextHashes:
    """The hashes that ``WordHashes`` gives the words of lower-cased texts, of many texts at once and without a dictionary: XXH64, step by step over all words of a block."""

    BLOCK, LONG = 1 << 15, 32
    PRIMES = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)

    def __init__(self) -> None:
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self.space = np.isin(np.arange(256), [32, *range(9, 14)])

    def bounds(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First bytes of all words, the bytes behind them, and how many words each text data[edges[i]:edges[i + 1]] has."""
        inside = np.zeros(len(data) + 1, dtype=bool)
        np.logical_not(self.space[data], out=inside[:-1])
        apart = np.zeros(len(data) + 1, dtype=bool)
        apart[edges] = True  # words of two texts are two, though no space is between them
        start, end = inside.copy(), inside.copy()
        start[1:] &= ~inside[:-1] | apart[1:]
        end[:-1] &= ~inside[1:] | apart[1:]
        start = np.flatnonzero(start)
        return start, np.flatnonzero(end) + 1, np.diff(np.searchsorted(start, edges))

    def words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the words data[start:end], which are in ascending order."""
        out = np.empty(len(start), dtype=np.uint64)
        for at in range(0, len(start), self.BLOCK):
            s, e = start[at : at + self.BLOCK], end[at : at + self.BLOCK]
            out[at : at + self.BLOCK] = self.hashed(np.append(self.lower[data[s[0] : e[-1]]], np.zeros(8, dtype=np.uint8)), s - s[0], e - s)
        return out

    def hashed(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """XXH64 of data[start:start + size]; data goes on for eight bytes."""
        p1, p2, p3, p4, p5 = (np.uint64(x) for x in self.PRIMES)
        turned = lambda x, n: x << np.uint64(n) | x >> np.uint64(64 - n)
        lanes = lambda kind: np.ndarray(len(data) - 7, kind, data, strides=(1,))
        eights, fours = lanes("<u8"), lanes("<u4")
        out, long = size.astype(np.uint64) + p5, np.flatnonzero(size >= self.LONG)
        for n in range(1, self.LONG // 8):
            some = np.flatnonzero(size >= 8 * n)
            if not len(some):
                break
            out[some] = turned(out[some] ^ turned(eights[start[some] + 8 * (n - 1)] * p2, 31) * p1, 27) * p1 + p4
        at = start + (size & -8)
        some = np.flatnonzero(size & 4)
        out[some] = turned(out[some] ^ fours[at[some]].astype(np.uint64) * p1, 23) * p2 + p3
        at += size & 4
        for n in range(3):
            some = np.flatnonzero(size & 3 > n)
            out[some] = turned(out[some] ^ data[at[some] + n].astype(np.uint64) * p5, 11) * p1
        out = (out ^ out >> np.uint64(33)) * p2
        out = (out ^ out >> np.uint64(29)) * p3
        out ^= out >> np.uint64(32)
        for x in long.tolist():
            out[x] = xxhash.xxh64_intdigest(data[start[x] : start[x] + size[x]].tobytes())
        return out

    def runs(self, data: np.ndarray, edges: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """``shingle_hashes`` of the texts, one after the other, and how many each has."""
        start, end, count = self.bounds(data, edges)
        every = shingle_hashes(self.words(data, start, end), k)
        length, last = np.maximum(count - (k - 1), 0), np.cumsum(count)
        within = np.arange(length.sum()) + np.repeat((last - count) - (np.cumsum(length) - length), length)
        return every[within], length


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of texts or binaries, a null one having none, and where each value starts and the last one ends."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    edges = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data else np.empty(0, dtype=np.uint8))[edges[0] : edges[-1]], edges - edges[0]


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node of every node that has an edge.

    ``edges``: two long columns, in any order; loops and repeats are harmless, nulls are dropped.
    Returns (node, component). Alternates the large-star and small-star steps, each an aggregation with partial sums
    and a join. A hub's edges stream through one task's join, or several where Spark's skew join splits them; they are never held together. Rounds grow
    with the logarithm of the longest path.
    """
    a, b = edges.columns
    step = (
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    step = materialise(step, "edges")
    before = None
    while True:
        seen = step.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen == before or seen["n"] == 0:
            break
        before = seen
        both = step.select("u", "v").unionByName(step.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small, "u")
        step = materialise(
            joined.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u > v")
            .distinct(),
            "edges",
        )
    own = step.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return step.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(own)


def kth_largest(keys: DataFrame, columns: list[str], k: int, bits: int = 60, digit: int = 12) -> list[int] | None:
    """The k-th largest of tuples of longs in [0, 2**bits), ordered by the columns in turn, by histograms of at most 2**digit cells.

    Small jobs whose number the bits bound, whatever the size of the table: neither a global sort nor one task that
    sees all rows. The answer splits the rows like the k-th largest does: k rows are no smaller, if no two rows are equal. None if there are fewer than k rows.
    """
    rows, low, left = keys, [], k
    for n, column in enumerate(columns):
        least, shift = 0, bits
        while shift:
            shift -= digit
            cells = rows.groupBy(F.shiftright(column, shift).alias("c")).count().collect()
            for c, count in sorted(((r["c"], r["count"]) for r in cells), reverse=True):
                if count >= left:
                    least = c << shift
                    break
                left -= count
            else:
                return None
            if count == left:  # all of the cell and above
                return [*low, least] + [0] * (len(columns) - n - 1)
            rows = rows.where((F.col(column) >= least) & (F.col(column) < least + (1 << shift)))
        low.append(least)
    return low


def no_smaller(columns: list[str], edge: list[int]) -> Column:
    """Whether the columns, in turn, are no smaller than the edge."""
    out = F.lit(True)
    for c, e in reversed(list(zip(columns, edge, strict=True))):
        out = (F.col(c) > e) | ((F.col(c) == e) & out)
    return out
