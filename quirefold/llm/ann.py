"""Approximate nearest neighbours by cross-polytope hashing.

A vector is turned by a few rounds of random signs and fast Hadamard transforms, and hashed to the signed axis nearest to it.
Each table joins one or more such hashes, the more the more vectors there are. A query probes the buckets whose axes it comes closest to, over all
tables. How many it probes is set by what a bounded sample of the queries needs to reach the wanted recall, measured against an exact search
for those. What lies in the buckets travels as one byte a component; the best of it is ranked by exact distances. Queries that find too few are
answered by an exact search over all rows, in blocks. Equal vectors are indexed once each with as many of their smallest ids as
any answer can hold, so a common vector fills no bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.llm.common import materialise, shuffle_width

TABLES = 16
#: Recall that the probes are set for, on so many queries.
RECALL, SAMPLE = 0.95, 64
#: Buckets of one table that a query weighs at most.
WEIGHED = 1 << 16
#: Rows of one key that one task takes; more are dealt by id to several.
SLICE = 1 << 16
#: Queries that one exact search answers.
BLOCK = 4096
#: Candidates that are ranked exactly, for each row of an answer.
SPARE = 3
#: Candidates that a task holds before it drops all but each query's nearest.
HELD = 1 << 18


def usable(vector: Column) -> Column:
    """A vector as doubles, -0 as 0; null where it is empty, zero, or holds null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    some = F.exists(vector, lambda x: x.cast("double") != 0.0)
    return F.when(vector.isNotNull() & fine & some, F.transform(vector, lambda x: x.cast("double") + F.lit(0.0)))


def vectors_of(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, dim, vec of the rows that take part."""
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), usable(F.col(vector_col)).alias("vec"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull()).select("vec_id", F.size("vec").alias("dim"), "vec")


def matrix(column: pa.ListArray, at: np.ndarray, dim: int) -> np.ndarray:
    """Rows ``at`` of a column of lists, all of the same length."""
    return column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dim)


def by_dim(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """dimension, row numbers, vectors."""
    dims = b.column("dim").to_numpy()
    for d in np.unique(dims):
        at = np.flatnonzero(dims == d)
        yield int(d), at, matrix(b.column("vec"), at, int(d))


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def hadamard(x: np.ndarray) -> np.ndarray:
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(-1, n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(-1, n)
        h *= 2
    return x / np.sqrt(n)


def padded(dim: int) -> int:
    return 1 << max(1, (dim - 1).bit_length())


def rotated(x: np.ndarray, table: int, part: int) -> np.ndarray:
    """A pseudo-random rotation of the rows, fixed by table and part; rows are padded to a power of two."""
    n = padded(x.shape[1])
    y = np.zeros((len(x), n))
    y[:, : x.shape[1]] = x
    signs = np.random.default_rng([table, part, n]).choice([-1.0, 1.0], size=(3, n))
    for s in signs:
        y = hadamard(y * s)
    return y


def signed_scores(x: np.ndarray, table: int, part: int) -> np.ndarray:
    y = rotated(x, table, part)
    return np.concatenate([y, -y], axis=1)


def hashes_for(rows: int, dim: int) -> int:
    """So many hashes a table that a bucket holds a row or more on average, three at most."""
    return max(1, min(3, int(log2(max(rows, 2)) / log2(2 * padded(dim)))))


def weighed_axes(dim: int, hashes: int) -> int:
    """Axes of each hash that a query weighs: all, or so many that their combinations stay within ``WEIGHED``."""
    return min(2 * padded(dim), int(WEIGHED ** (1 / hashes) + 1e-9))


def bucket_costs(scores: list[np.ndarray], axes: int) -> tuple[list[np.ndarray], np.ndarray]:
    """One query's nearest axes of each hash, and what each combination of them costs (an array with a side for each hash)."""
    near = [np.argsort(-s, kind="stable")[:axes] for s in scores]
    cost = np.zeros((1,) * len(scores))
    for p, (s, a) in enumerate(zip(scores, near, strict=True)):
        lost = (s[a[0]] - s[a]) ** 2
        cost = cost + lost.reshape([-1 if i == p else 1 for i in range(len(scores))])
    return near, cost


def coarse_key(dim: int, table: int, axes: list[np.ndarray]) -> np.ndarray:
    """Dimension, table, and all hashes but the last (or the only one) in one number."""
    key = np.full(len(axes[0]), dim * 64 + table, dtype=np.int64)
    for a in axes[: max(1, len(axes) - 1)]:
        key = key * (2 * padded(dim)) + a
    return key


def fine_key(axes: list[np.ndarray]) -> np.ndarray:
    return (axes[-1] if len(axes) > 1 else axes[0] * 0).astype(np.int32)


def as_bytes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Components as whole numbers of -127..127, and each row's unit."""
    unit = np.abs(x).max(axis=1) / 127
    return np.rint(x / unit[:, None]).astype(np.int8), unit


def byte_rows(x: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in x]


def index_rows(stored: DataFrame, tables: int, hashes: int) -> DataFrame:
    """key, fine, sid, unit, small: each vector in each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, at, x in by_dim(b):
                small, unit = as_bytes(x)
                own, small, x = pa.array(b.column("sid").to_numpy()[at]), pa.array(byte_rows(small), pa.binary()), units(x)
                for t in range(tables):
                    axes = [signed_scores(x, t, p).argmax(axis=1) for p in range(hashes)]
                    yield pa.RecordBatch.from_arrays([pa.array(coarse_key(d, t, axes)), pa.array(fine_key(axes)), own, pa.array(unit), small], ["key", "fine", "sid", "unit", "small"])

    return stored.select("sid", "dim", "vec").mapInArrow(run, "key long, fine int, sid long, unit double, small binary")


def key_counts(stored: DataFrame, tables: int, hashes: int) -> DataFrame:
    """key and how many rows of the index have it, added up within each batch before they travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, _, x in by_dim(b):
                x = units(x)
                for t in range(tables):
                    key, n = np.unique(coarse_key(d, t, [signed_scores(x, t, p).argmax(axis=1) for p in range(max(1, hashes - 1))] + ([np.zeros(len(x), dtype=np.int64)] if hashes > 1 else [])), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])

    return stored.select("dim", "vec").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def probe_rows(queries: DataFrame, tables: int, hashes: int, probes: int) -> DataFrame:
    """key, the fine hashes to look at, qid, unit, small: the cheapest ``probes`` buckets of each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, at, x in by_dim(b):
                small, unit = as_bytes(x)
                small, ids, x, axes = byte_rows(small), b.column("qid").to_numpy()[at], units(x), weighed_axes(d, hashes)
                for t in range(tables):
                    keys, fines, who = [], [], []
                    scores = [signed_scores(x, t, p) for p in range(hashes)]
                    for i in range(len(at)):
                        near, cost = bucket_costs([s[i] for s in scores], axes)
                        n = min(probes, cost.size)
                        best = np.unravel_index(np.argpartition(cost, n - 1, axis=None)[:n], cost.shape)
                        picked = [a[j] for a, j in zip(near, best, strict=True)]
                        key, fine = coarse_key(d, t, picked), fine_key(picked)
                        order = np.lexsort((fine, key))
                        key, fine = key[order], fine[order]
                        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                        keys += key[starts].tolist()
                        fines += np.split(fine, starts[1:])
                        who += [i] * len(starts)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys, pa.int64()), pa.array(fines, pa.list_(pa.int32())), pa.array(ids[who]), pa.array(unit[who]), pa.array([small[i] for i in who], pa.binary())],
                        ["key", "fines", "qid", "unit", "small"],
                    )

    return queries.select("qid", "dim", "vec").mapInArrow(run, "key long, fines array<int>, qid long, unit double, small binary")


def rank_in_slice(rows: pa.Table, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's nearest rows of one key by the shortened vectors: query, row, distance."""
    is_query = rows["fines"].is_valid().to_numpy()
    stored, asked = np.flatnonzero(~is_query), np.flatnonzero(is_query)
    none = np.empty(0, dtype=np.int64)
    if not len(stored) or not len(asked):
        return none, none, np.empty(0)
    small, unit, ids = rows["small"].to_pylist(), rows["unit"].to_numpy(), rows["id"].to_numpy()
    fine = rows["fine"].to_numpy()[stored]
    order = np.argsort(fine, kind="stable")
    stored, fine = stored[order], fine[order]
    x = np.frombuffer(b"".join([small[i] for i in stored]), dtype=np.int8).reshape(len(stored), -1) * unit[stored][:, None]
    lists, out = rows["fines"].to_pylist(), []
    for q in asked:
        lo, hi = np.searchsorted(fine, lists[q]), np.searchsorted(fine, lists[q], side="right")
        at = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi, strict=True)])
        if len(at):
            far = ((x[at] - np.frombuffer(small[q], dtype=np.int8) * unit[q]) ** 2).sum(axis=1)
            if len(at) > most:
                keep = np.argpartition(far, most - 1)[:most]
                at, far = at[keep], far[keep]
            out.append((np.full(len(at), ids[q]), ids[stored[at]], far))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (none, none, np.empty(0))


def nearest_of(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of what several slices found (query, row, distance) each query's nearest rows, once each."""
    q, sid, far = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((sid, q))
    q, sid, far = q[order], sid[order], far[order]
    once = np.r_[True, (q[1:] != q[:-1]) | (sid[1:] != sid[:-1])][: len(q)]
    q, sid, far = q[once], sid[once], far[once]
    order = np.lexsort((sid, far, q))
    q, sid, far = q[order], sid[order], far[order]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]][: len(q)])
    keep = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)])) < most
    return q[keep], sid[keep], far[keep]


def exact_search(asked: list[tuple[int, list[float]]], stored: DataFrame, k: int) -> DataFrame:
    """qid, vec_id, score: the k nearest rows of each of a bounded block of queries (qid, vector), over all rows."""
    spark = stored.sparkSession
    blocks = {d: (np.array([q for q, v in asked if len(v) == d]), np.array([v for _, v in asked if len(v) == d])) for d in {len(v) for _, v in asked}}
    shared = spark.sparkContext.broadcast(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for d, at, x in by_dim(b):
                ids = b.column("vec_id").to_numpy()[at]
                for i, (q, v) in enumerate(zip(*shared.value.get(d, ((), ())), strict=True)):
                    far, own = np.sqrt(((x - v) ** 2).sum(axis=1)), ids
                    if int(q) in best:
                        far, own = np.concatenate([best[int(q)][0], far]), np.concatenate([best[int(q)][1], own])
                    keep = np.lexsort((own, far))[:k]
                    best[int(q)] = [far[keep], own[keep]]
        if best:
            cols = [np.concatenate([np.full(len(v[0]), q) for q, v in best.items()]), np.concatenate([v[1] for v in best.values()]), np.concatenate([v[0] for v in best.values()])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["qid", "vec_id", "score"])

    found = stored.select("vec_id", "dim", "vec").mapInArrow(run, "qid long, vec_id long, score double")
    order = Window.partitionBy("qid").orderBy("score", "vec_id")
    return found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def probes_needed(stored: DataFrame, queries: DataFrame, k: int, tables: int, hashes: int, recall: float, sample: int) -> int | None:
    """How many buckets of each table find the share ``recall`` of the true neighbours of a sample of the queries; None if none do.

    At most ``sample`` queries, those with the smallest hashes, are searched exactly; the driver sees those and their neighbours alone.
    """
    some = [(r["qid"], r["vec"]) for r in queries.orderBy(F.xxhash64("qid"), "qid").limit(sample).select("qid", "vec").collect()]
    if not some:
        return 1
    true = exact_search(some, stored, k + 1).select("qid", "vec_id").distinct().join(stored.select("vec_id", "vec"), "vec_id").select("qid", "vec").collect()
    near: dict[int, list[list[float]]] = {}
    for r in true:
        near.setdefault(r["qid"], []).append(r["vec"])
    need = []
    for q, v in some:
        found = [w for w in near.get(q, []) if len(w) == len(v) and w != v]
        if not found:
            continue
        x, axes = units(np.array([v, *found])), weighed_axes(len(v), hashes)
        least = np.full(len(found), np.inf)
        for t in range(tables):
            scores = [signed_scores(x, t, p) for p in range(hashes)]
            near_axes, cost = bucket_costs([s[0] for s in scores], axes)
            for i in range(len(found)):
                at = [np.flatnonzero(a == s[i + 1].argmax()) for a, s in zip(near_axes, scores, strict=True)]
                if all(map(len, at)):
                    least[i] = min(least[i], int((cost <= cost[tuple(a[0] for a in at)]).sum()))
        need += least.tolist()
    if not need:
        return 1
    edge = sorted(need)[max(0, ceil(recall * len(need)) - 1)]
    return int(edge) if np.isfinite(edge) else None


def nearest(table: DataFrame, queries: DataFrame, k: int = 10, tables: int = TABLES, hashes: int | None = None, recall: float = RECALL, sample: int = SAMPLE, slice_rows: int = SLICE, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query's other rows, by Euclidean distance, ties to the smaller vec_id.

    table and queries: ``vec_id`` and ``embedding``; other columns are ignored. Rows with a null id, and vectors that are null, empty, zero, or hold
    null or non-finite components take no part, as query or as candidate. Rows that share a query's id are the query's own. Vectors of
    other lengths are never candidates. Fewer than k candidates give all of them; an empty table gives none. ``hashes`` and probes follow from the number of rows and
    from what ``sample`` queries need for ``recall``.
    """
    spark = table.sparkSession
    width = shuffle_width(spark)
    near = Window.partitionBy("vec").orderBy("vec_id")
    stored = vectors_of(table).distinct().withColumn("r", F.row_number().over(near)).where(F.col("r") <= k + 1)
    stored = materialise(stored.select(F.monotonically_increasing_id().alias("sid"), "vec_id", "dim", "vec"), "indexed")
    asked = materialise(vectors_of(queries), "queries")
    each = materialise(asked.groupBy("dim", "vec").agg(F.min("vec_id").alias("least")).select(F.monotonically_increasing_id().alias("qid"), "dim", "vec"), "asked")
    seen = stored.agg(F.count("*").alias("n"), F.max("dim").alias("dim")).first()
    hashes = hashes or hashes_for(seen["n"], seen["dim"] or 2)
    probes = probes_needed(stored, each, k, tables, hashes, recall, sample)
    while probes is None and hashes > 1:
        hashes -= 1
        probes = probes_needed(stored, each, k, tables, hashes, recall, sample)
    probes = probes or WEIGHED
    # Keys are as many as tables x (2 x dimension) ** hashes at most; only those over a slice are listed.
    large = key_counts(stored, tables, hashes).where(F.col("n") > slice_rows).select("key", F.ceil(F.col("n") / slice_rows).cast("int").alias("n"))
    large = materialise(large, "large-keys")
    if large.count() <= 100_000:
        large = F.broadcast(large)
    copies = F.coalesce("n", F.lit(1))
    left = index_rows(stored, tables, hashes).join(large, "key", "left").select("key", F.pmod(F.xxhash64("sid"), copies).cast("int").alias("part"), "fine", F.lit(None).cast("array<int>").alias("fines"), F.col("sid").alias("id"), "unit", "small")
    right = probe_rows(each.repartition(width), tables, hashes, probes).join(large, "key", "left").select("key", F.explode(F.sequence(F.lit(0), copies - 1)).alias("part"), F.lit(0).alias("fine"), "fines", F.col("qid").alias("id"), "unit", "small")
    most = SPARE * (k + 1)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for rows in tables_of_key(batches, ["key", "part"]):
            held.append(rank_in_slice(rows, most))
            size += len(held[-1][0])
            if size >= HELD:
                held = [nearest_of(held, most)]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, held[0])), ["qid", "sid", "far"])
                    held, size = [], 0
        if size:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, nearest_of(held, most))), ["qid", "sid", "far"])

    met = left.unionByName(right).repartition(width, "key", "part").sortWithinPartitions("key", "part").mapInArrow(search, "qid long, sid long, far double")
    order = Window.partitionBy("qid").orderBy("far", "sid")
    met = met.groupBy("qid", "sid").agg(F.min("far").alias("far")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= most)
    pairs = met.select("qid", "sid").join(stored.select("sid", "vec_id", "vec"), "sid").join(each.select("qid", "dim", F.col("vec").alias("own")), "qid")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, score = b.column("dim").to_numpy(), np.zeros(b.num_rows)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                score[at] = np.sqrt(((matrix(b.column("vec"), at, int(d)) - matrix(b.column("own"), at, int(d))) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([b.column("qid"), b.column("vec_id"), pa.array(score)], ["qid", "vec_id", "score"])

    best = pairs.select("qid", "dim", "vec_id", "vec", "own").mapInArrow(exact, "qid long, vec_id long, score double").groupBy("qid", "vec_id").agg(F.min("score").alias("score"))
    best = materialise(best.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy("score", "vec_id"))).where(F.col("r") <= k + 1).drop("r"), "best")
    # Queries that found too few are searched exactly, a bounded block of them at a time.
    full = best.groupBy("qid").agg(F.count("*").alias("n")).where(F.col("n") > k).select("qid")
    short = materialise(each.select("qid", "vec").join(full, "qid", "left_anti"), "short")
    left_over = short.count()
    blocks = ceil(left_over / block)
    if left_over:
        best = best.join(full, "qid", "left_semi")
    for i in range(blocks):
        own = short.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i).collect()
        best = best.unionByName(materialise(exact_search([(r["qid"], r["vec"]) for r in own], stored, k + 1).groupBy("qid", "vec_id").agg(F.min("score").alias("score")), "exact"))
    # One search a vector serves all queries that have it; each leaves its own row out.
    same = asked.select("vec_id", "vec").distinct().join(each.select("vec", "qid"), "vec").select(F.col("vec_id").alias("query_id"), "qid")
    out = same.join(best, "qid").where(F.col("vec_id") != F.col("query_id"))
    out = out.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")


def tables_of_key(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Sorted batches recut to one table for each key."""
    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(c).to_numpy(zero_copy_only=False) for c in keys]
        new = np.any([np.r_[True, c[1:] != c[:-1]] for c in cols], axis=0)
        starts = np.flatnonzero(new)
        for s, e in zip(starts, np.r_[starts[1:], b.num_rows], strict=True):
            key = tuple(c[s] for c in cols)
            if held and key != now:
                yield pa.Table.from_batches(held)
                held = []
            now = key
            held.append(b.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)
