"""Near copies by SimHash and min-hash candidates and exact similarity: five-word runs, Jaccard 0.8.

Candidates come from two searches. Fingerprints of the runs within three bits are found by the general pigeonhole of ``simhash``; three of 64 bits
reach similarities of some 0.95. For those from 0.8 on each text also leaves the least of its runs under many hash functions, taken seven at a time;
texts that share all of one such band meet in a group. One byte of each least run estimates the similarity within a group: a flood joins those surely alike, and each other row names the two rows outside its own
flood that it looks most like: 3n pairs at most of a group of n texts. Every pair is compared on the texts; none is linked unchecked. Then all pairs of a group that the links found leave in
different components are compared too, within tasks that hold the runs of two blocks of a group: only links come out, one for each two components that it joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.llm import simhash
from quirefold.llm.common import WordHashes, bound_batches, connected_components, free_names, groups_of, materialise, mix, releasing, shingle_hashes, shuffle_width

SHINGLE = 5
SIMILARITY = 0.8
#: A pair of similarity 0.8 shares one of 24 bands of seven with a chance of 0.996, one of 0.9 all but surely.
BANDS, WIDTH = 24, 7
#: Estimates (their standard error is 0.03) so far above or below the similarity join two texts in a flood, or rule them out.
SURE, AT_LEAST = 0.06, 0.09
#: Bits within which fingerprints are compared.
BITS_APART = 3
#: Rows of one group that one task takes; larger groups are cut into blocks that meet pairwise.
BLOCK = 1 << 13
#: Bytes of runs of one group that a block holds at most, unless one text has more.
BLOCK_BYTES = 1 << 24


def run_hashes(text: bytes | None, words: WordHashes) -> np.ndarray:
    """Distinct runs of five words, sorted; a shorter text is one run, and a text without words has none."""
    found = words.of((text or b"").lower().split())
    return np.unique(shingle_hashes(found, min(SHINGLE, max(1, len(found)))))


ODD = mix(np.arange(1, BANDS * WIDTH + 1, dtype=np.uint64)) | np.uint64(1)


def least_runs(runs: np.ndarray) -> np.ndarray:
    """The least of the runs under each hash function."""
    least = np.full(BANDS * WIDTH, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(runs), 1 << 10):  # bounds the matrix, whatever the text
        least = np.minimum(least, (ODD[:, None] * runs[None, at : at + (1 << 10)]).min(axis=1))
    return least


def bands(least: np.ndarray) -> np.ndarray:
    key = np.arange(BANDS, dtype=np.uint64)
    for x in least.reshape(BANDS, WIDTH).T:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + x)
    return key


def majority(runs: np.ndarray) -> int:
    """A bit is 1 if over half of the runs have it."""
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(runs), 1 << 16):
        total += np.unpackbits(runs[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(runs), bitorder="little").view("<u8")[0])


def sketched(texts: DataFrame) -> DataFrame:
    """node, fp, keys (of its bands), sketch (a byte of each least run) of rows of node, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for b in batches:
            fps, keys, sketches = [], [], []
            for t in b.column("text").cast(pa.binary()).to_pylist():
                runs = run_hashes(t, words)
                least = least_runs(runs)
                fps.append(majority(runs))
                keys.append(bands(least).view(np.int64))
                sketches.append((mix(least) & np.uint64(255)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column("node"), pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], ["node", "fp", "keys", "sketch"]
            )

    return texts.mapInArrow(releasing(run), "node long, fp long, keys array<long>, sketch binary")


def group_pairs(sketch: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Pairs of rows of one group to compare: a flood over sure ones, and for each row outside the largest flood the two likeliest of the others."""
    n, pairs = len(sketch), []
    flood, todo, k = np.full(n, -1), np.arange(n), 0
    sure = min(1.0, similarity + SURE)
    while len(todo):
        stack, todo = [todo[0]], todo[1:]
        flood[stack[0]] = k
        while stack and len(todo):
            x = stack.pop()
            near = (sketch[todo] == sketch[x]).mean(axis=1) >= sure
            hit, todo = todo[near], todo[~near]
            flood[hit] = k
            pairs += [(int(x), int(y)) for y in hit]
            stack.extend(hit.tolist())
        k += 1
    if k > 1:
        largest = np.bincount(flood).argmax()
        for x in np.flatnonzero(flood != largest):
            other = np.flatnonzero(flood != flood[x])
            like = (sketch[other] == sketch[x]).mean(axis=1)
            for y in np.argsort(-like, kind="stable")[:2]:
                if like[y] >= similarity - AT_LEAST:
                    pairs.append((int(x), int(other[y])))
    return pairs


def torn_links(runs: list[np.ndarray], component: np.ndarray, side: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links (rows) that connect what the similarity connects of different components; all pairs are compared, or those across where rows are of two sides."""
    names, which = np.unique(component, return_inverse=True)
    across, size = side.min() != side.max(), np.array([len(r) for r in runs])
    row = np.repeat(np.arange(len(runs)), size)
    flat = np.concatenate(runs)
    order = np.argsort(flat, kind="stable")
    flat, row, out = flat[order], row[order], []
    for x in np.flatnonzero(which != np.bincount(which).argmax()):
        lo, hi = np.searchsorted(flat, runs[x]), np.searchsorted(flat, runs[x], side="right")
        n, both = hi - lo, np.zeros(len(runs), dtype=np.int64)
        for s, e in spans_of(n):  # rows that have each of the runs
            at = np.repeat(lo[s:e] - np.cumsum(n[s:e]) + n[s:e], n[s:e]) + np.arange(n[s:e].sum())
            both += np.bincount(row[at], minlength=len(runs))
        alike = (both >= similarity * (size + size[x] - both)) & (which != which[x])
        if across:
            alike &= side != side[x]
        hit = np.flatnonzero(alike)
        joined, first = np.unique(which[hit], return_index=True)
        if len(joined):
            out += [(int(x), int(y)) for y in hit[first]]
            which[np.isin(which, joined)] = which[x]
            if len(out) == len(names) - 1:
                break
    return out


def spans_of(counts: np.ndarray, most: int = 1 << 20) -> list[tuple[int, int]]:
    """Spans of the counts, each of a sum of about ``most`` at most or of one count."""
    part = np.cumsum(counts) // most
    cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else np.zeros(1, dtype=np.int64)
    return list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))


def banded(sketches: DataFrame) -> DataFrame:
    """key, node, n of the groups of n > 1 rows that share a band."""
    rows = sketches.select(F.explode("keys").alias("key"), "node")
    return materialise(rows.join(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"), "groups")


def dealt(met: DataFrame, blocks: Column, columns: list[str]) -> DataFrame:
    """key, tile, side (a row's block), node and the columns, by key and tile: blocks of a large group meet pairwise, so a row goes to one tile for each block there is."""
    own = F.pmod(F.xxhash64("node"), blocks)
    tile = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda k: F.least(k, own) * blocks + F.greatest(k, own))
    rows = met.select("key", F.explode(tile).alias("tile"), own.alias("side"), "node", *columns)
    return rows.repartition(shuffle_width(met.sparkSession), "key", "tile").sortWithinPartitions("key", "tile", "node")


def banded_pairs(met: DataFrame, sketches: DataFrame, similarity: float, block: int) -> DataFrame:
    """Pairs (lead, node), lead < node, that some band's group brings together."""
    met = met.join(sketches.select("node", "sketch"), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, start, end in groups_of(batches):
            nodes, out = t["node"].to_numpy(), []
            sketch = np.frombuffer(b"".join(t["sketch"].to_pylist()), dtype=np.uint8).reshape(len(nodes), -1)
            for s, e in zip(start, end, strict=True):
                out += [(nodes[s + x], nodes[s + y]) for x, y in group_pairs(sketch[s:e], similarity)]
            yield node_pairs(out)

    return dealt(met, F.ceil(F.col("n") / F.lit(block)).cast("long"), ["sketch"]).mapInArrow(releasing(run), "lead long, node long")


def banded_links(met: DataFrame, texts: DataFrame, similarity: float, block: int, block_bytes: int) -> DataFrame:
    """Links (lead, node), lead < node, that connect what is alike within groups of rows (key, node, component) in different components."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([run_hashes(t, words).tobytes() for t in b.column("text").cast(pa.binary()).to_pylist()], pa.binary())], ["node", "runs"])

    some = texts.join(met.select("node").distinct(), "node", "left_semi")
    runs = materialise(some.select("node", "text").mapInArrow(releasing(hashed), "node long, runs binary"), "runs")
    met = met.select("key", "node", "component").join(runs.select("node", F.octet_length("runs").alias("size")), "node")
    blocks = F.ceil(F.greatest(F.count("*") / F.lit(block), F.sum("size") / F.lit(block_bytes), F.lit(1.0))).cast("long")
    met = met.join(met.groupBy("key").agg(blocks.alias("blocks")), "key").join(runs, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, start, end in groups_of(batches):
            nodes, component, side, out = t["node"].to_numpy(), t["component"].to_numpy(), t["side"].to_numpy(), []
            for s, e in zip(start, end, strict=True):
                own = [np.frombuffer(x, dtype=np.uint64) for x in t["runs"].slice(s, e - s).to_pylist()]
                out += [(nodes[s + x], nodes[s + y]) for x, y in torn_links(own, component[s:e], side[s:e], similarity)]
            yield node_pairs(out)

    return dealt(met, F.col("blocks"), ["component", "runs"]).mapInArrow(releasing(run), "lead long, node long").distinct()


def node_pairs(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = np.array(pairs, dtype=np.int64).reshape(-1, 2).T
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["lead", "node"])


def fingerprint_pairs(sketches: DataFrame) -> DataFrame:
    """Pairs (lead, node) that fingerprints within three bits bring together: one of each fingerprint with the others, and across links."""
    each = materialise(sketches.groupBy("fp").agg(F.min("node").alias("first")), "distinct-fingerprints")
    same = sketches.join(each, "fp").where("node <> first").select(F.col("first").alias("lead"), "node")
    n, both = simhash.bit_counts(each)
    if n < 2:
        return same
    links = simhash.fingerprint_links(each.select("fp"), n, both, BITS_APART)
    a, b = each.select(F.col("fp").alias("a"), F.col("first").alias("x")), each.select(F.col("fp").alias("b"), F.col("first").alias("y"))
    across = links.distinct().join(a, "a").join(b, "b").select(F.least("x", "y").alias("lead"), F.greatest("x", "y").alias("node"))
    return same.unionByName(across)


def compared(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (lead, node) whose texts are alike."""
    x = texts.select(F.col("node").alias("lead"), F.col("text").alias("x"))
    sided = pairs.join(texts, "node").join(x, "lead").select("lead", "node", "x", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for b in batches:
            alike, before, s = [], None, np.empty(0)
            for x, t in zip(*(b.column(c).cast(pa.binary()).to_pylist() for c in ("x", "text")), strict=True):
                if x != before:
                    before, s = x, run_hashes(x, words)
                t = run_hashes(t, words)
                both = len(np.intersect1d(s, t, assume_unique=True))
                alike.append(both >= similarity * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([b.column("lead"), b.column("node")], ["lead", "node"]).filter(pa.array(alike, pa.bool_()))

    return sided.mapInArrow(releasing(run), "lead long, node long")


def near_links(texts: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Links (lead, node) that connect the rows of ``node``, ``text`` (nodes distinct) that are alike."""
    sketches = materialise(sketched(texts), "sketches")
    met = banded(sketches)
    pairs = banded_pairs(met, sketches, similarity, block).unionByName(fingerprint_pairs(sketches)).where("lead <> node").distinct()
    pairs = materialise(pairs, "pairs")
    some = texts.join(pairs.select(F.explode(F.array("lead", "node")).alias("node")).distinct(), "node", "left_semi")
    links = materialise(compared(pairs, some, similarity), "links")
    # What those leave apart within a group is compared pair by pair, so no link between components is lost.
    met = met.join(connected_components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    met = materialise(met, "components")
    torn = met.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
    return links.unionByName(banded_links(met.join(torn, "key"), texts, similarity, block, block_bytes))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Rows of ``docs``, one of each group that links of at least the similarity connect: that with the smallest doc_id (then the smallest text hash).

    docs needs ``doc_id`` and ``text``; columns stay as they are. Rows alike in doc_id and text stay once. Null, empty and blank texts are alike.
    Rows with a null doc_id stay only where their group has no other. An empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    t, d, k = free_names(docs, "t", "d", "k")
    keyed = docs.withColumn(t, F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull()))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id")))
    nodes = materialise(keyed.groupBy(F.col(t).alias("node")).agg(first.alias("s"), F.first("text").alias("text")), "texts")
    found = connected_components(near_links(nodes.select("node", "text"), similarity))
    label = nodes.select("node", "s").join(found, "node", "left").select("node", "s", F.coalesce("component", "node").alias("component"))
    stay = label.groupBy("component").agg(F.min(F.struct("s.no", "s.id", "node")).alias("s")).select(F.col("s.id").alias(d), F.col("s.node").alias(k))
    kept = keyed.join(stay, F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(t) == F.col(k)), "left_semi")
    return kept.dropDuplicates(["doc_id", t]).drop(t)
