"""Compressing vectors to short codes: product quantisation with whole numbers, assigned by partial-distance search.

A vector's components become whole numbers and are cut into consecutive parts; each part position has a codebook of at most 256 entries. A part's nearest entry is found
dimension by dimension, those in which the codebook varies most first: after the first few, the entry that leads is measured in full, and entries whose distance so far
exceeds the best full one are dropped, for a batch of parts at a time. All distances and means are whole numbers, so results do not depend on how the rows are dealt.
Tasks add up the parts of each entry; what reaches the driver is one row for each component of each entry, whatever the size of the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirefold.llm.common import materialise

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Parts searched at a time, dimensions taken of all entries before the first are dropped, and after how many more a new leader is measured.
BATCH, HEAD, TURN = 1024, 4, 4
#: Labels up to this many are broadcast; a longer list is joined by a shuffle.
BROADCAST_LABELS = 10_000

#: One length's codebooks: for each part, an array of entries by components.
Books = dict[int, list[np.ndarray]]


def whole_vectors(table: DataFrame, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label, dim, q: the vectors that take part, as arrays of ints."""
    v = F.col(vector_col)
    # Squared distances between vectors of smaller components fit into a long.
    most = F.sqrt(F.lit(float(1 << 63)) / F.greatest(F.size(v), F.lit(1))) / 2 - 1
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")) & (F.abs(x.cast("double") * scale) < most))
    q = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("int"))
    return table.where(fine).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.size(v).alias("dim"), q.alias("q"))


def edges(dim: int, parts: int) -> list[int]:
    """Where the parts of a vector begin and end: equal lengths, the first parts one longer where there is a rest."""
    return [k * (dim // parts) + min(k, dim % parts) for k in range(parts + 1)]


def falling_variance(book: np.ndarray) -> np.ndarray:
    """Dimensions, those in which the entries vary most first."""
    return np.argsort(-book.astype(np.float64).var(axis=0), kind="stable")


def nearest_entries(x: np.ndarray, book: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row, the first of equally near ones, and its squared distance."""
    so_far = np.zeros((len(x), len(book)), dtype=np.int64)
    for d in order[:HEAD]:
        so_far += (x[:, d, None] - book[None, :, d]) ** 2
    full = lambda r, e: ((x[r] - book[e]) ** 2).sum(axis=1)
    best = full(slice(None), so_far.argmin(axis=1))
    row, entry = np.nonzero(so_far <= best[:, None])
    part = so_far[row, entry]

    def first_least() -> np.ndarray:
        """Of the pairs left, where each row's first of the least distance is; pairs are in order of row and entry."""
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        at = np.flatnonzero(part == np.repeat(np.minimum.reduceat(part, starts), np.diff(np.r_[starts, len(row)])))
        return at[np.r_[True, row[at][1:] != row[at][:-1]]]

    for n, d in enumerate(order[HEAD:], 1):
        part = part + (x[row, d] - book[entry, d]) ** 2
        if n % TURN == 0 and len(row) > len(x):
            at = first_least()
            best[row[at]] = np.minimum(best[row[at]], full(row[at], entry[at]))
        left = part <= best[row]
        row, entry, part = row[left], entry[left], part[left]
    at = first_least()
    return entry[at], part[at]


def searched(batches: Iterator[pa.RecordBatch], books: Books) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """batch, dimension, row numbers, whole vectors, entries (rows by parts), squared distances (rows by parts)."""
    orders = {dim: [falling_variance(b) for b in book] for dim, book in books.items()}
    for b in batches:
        dims = b.column("dim").to_numpy()
        for dim in map(int, np.unique(dims)):
            every, cut = np.flatnonzero(dims == dim), edges(dim, len(books[dim]))
            for at in (every[k : k + BATCH] for k in range(0, len(every), BATCH)):
                x = b.column("q").take(pa.array(at)).flatten().to_numpy().astype(np.int64).reshape(len(at), dim)
                both = [nearest_entries(x[:, cut[p] : cut[p + 1]], book, orders[dim][p]) for p, book in enumerate(books[dim])]
                yield b, dim, at, x, np.stack([e for e, _ in both], axis=1), np.stack([d for _, d in both], axis=1)


def first_books(rows: DataFrame, parts: int, entries: int) -> Books:
    """Codebooks of the vectors with the smallest ids of each length; each task hands on as many rows of a length at most."""
    order = Window.partitionBy("dim").orderBy(F.col("vec_id").asc_nulls_last(), "q")
    books: Books = {}
    for dim, q in rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= entries).orderBy("dim", "n").select("dim", "q").collect():
        books.setdefault(dim, []).append(q)
    return {dim: [np.array(q, dtype=np.int64).reshape(len(q), dim)[:, a:b] for a, b in zip(cut, cut[1:])] for dim, q in books.items() for cut in [edges(dim, parts)]}


def moved(rows: DataFrame, books: Books) -> Books:
    """Each entry as the mean, rounded down, of the parts that are nearest to it; one that no part is nearest to stays."""
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for _, dim, _, x, entry, _ in searched(batches, shared.value):
            cut = edges(dim, entry.shape[1])
            for p, book in enumerate(shared.value[dim]):
                # The last column counts.
                own = sums.setdefault((dim, p), np.zeros((len(book), book.shape[1] + 1), dtype=np.int64))
                np.add.at(own, entry[:, p], np.c_[x[:, cut[p] : cut[p + 1]], np.ones(len(x), dtype=np.int64)])
        for (dim, p), own in sums.items():
            used = np.flatnonzero(own[:, -1])
            width = own.shape[1]
            yield pa.RecordBatch.from_pydict({
                "dim": pa.array(np.full(len(used) * width, dim), "int32"), "part": pa.array(np.full(len(used) * width, p), "int32"), "entry": pa.array(np.repeat(used, width), "int32"),
                "at": pa.array(np.tile(np.arange(width), len(used)), "int32"), "value": own[used].ravel(),
            })

    total = rows.mapInArrow(added, "dim int, part int, entry int, at int, value long").groupBy("dim", "part", "entry", "at").agg(F.sum("value").alias("value"))
    sums = {dim: [np.zeros((len(b), b.shape[1] + 1), dtype=np.int64) for b in book] for dim, book in books.items()}
    for dim, p, e, at, value in total.collect():
        sums[dim][p][e, at] = value
    shared.unpersist()
    return {dim: [np.where(s[:, -1:] > 0, s[:, :-1] // np.maximum(s[:, -1:], 1), b) for s, b in zip(sums[dim], book, strict=True)] for dim, book in books.items()}


def digest(book: list[np.ndarray]) -> str:
    """SHA-256 of one length's entries: all components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in book for x in b.ravel().tolist()).encode()).hexdigest()


def compress_vectors(table: DataFrame, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, **columns: str) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of each vector that takes part.

    Components are multiplied by ``scale`` and rounded down. code: the nearest entry's number of each part, two hex digits each (``entries`` is 256 at most); error: squared distances, added over
    the parts; label_error: errors added over the rows of the same label, null labels together; codebooks_sha256: of all final entries of the vector's length. Ties go to the lower entry.

    Vectors that are null, hold null or non-finite components, or are so large that squared distances may not fit into a long (for 64 components: from 2**17) take no part. Zero vectors do,
    and empty ones: their code is that of entry 0. Every length has codebooks of its own, from its smallest vec_ids; rows without vec_id come last, rows that repeat one follow by
    vector. Lengths that the parts do not divide make the first parts one longer. Other columns are ignored. An empty table gives no rows.
    """
    rows = materialise(whole_vectors(table, scale, **columns), "whole-vectors")
    books = first_books(rows, parts, entries)
    for _ in range(rounds):
        books = moved(rows, books)
    shared = rows.sparkSession.sparkContext.broadcast(books)
    digests = {dim: digest(book) for dim, book in books.items()}

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, dim, at, _, entry, distance in searched(batches, shared.value):
            own = b.select(["vec_id", "label"]).take(pa.array(at))
            code = [r.tobytes().hex() for r in entry.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(code, "string"), pa.array(distance.sum(axis=1)), pa.array([digests[dim]] * len(at), "string")], ["vec_id", "label", "code", "error", "codebooks_sha256"])

    kinds = f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, code string, error long, codebooks_sha256 string"
    codes = materialise(rows.mapInArrow(coded, kinds), "codes")
    per = codes.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error"))
    if per.count() <= BROADCAST_LABELS:
        per = F.broadcast(per)
    return codes.join(per, F.col("label").eqNullSafe(F.col("l"))).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
