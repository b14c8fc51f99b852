"""SimHash near-duplicates by the general pigeonhole principle.

Fingerprints of 64 bits link at ``max_distance`` differing bits or fewer. The bits are first put into
partitions so that bits that vary together share one: what varies together tells least apart, and the other
partitions stay selective. Each fingerprint then gets its own thresholds, one for each partition, which sum to
``max_distance - partitions + 1``: a pair within the distance must lie within the threshold of some partition.
Dynamic programming picks the thresholds that the counted candidates make cheapest, so a fingerprint in a crowded
bucket looks elsewhere. Candidates are verified within their bucket; only links come out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import bound_batches, connected_components, free_names, materialise, releasing, shuffle_width

BITS = 64
#: Index rows of one bucket that one task takes; larger buckets are cut into blocks that meet pairwise.
BLOCK = 1 << 20
#: Candidates that one more probe is worth.
PROBE_COST = 4


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """A bit is 1 if over half of the shingles' XXH64 (seed 42) have it; 0 without any word."""
    found = (text or b"").lower().split()
    if not found:
        return 0
    n = len(found)
    if n <= words:
        return xxhash.xxh64_intdigest(b" ".join(found), 42)
    joined = b" ".join(found)
    length = np.fromiter(map(len, found), dtype=np.int64, count=n)
    end = np.cumsum(length + 1) - 1
    start = (end - length)[: n - words + 1].tolist()
    end = end[words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    total = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(start), 1 << 16):
        part = slice(at, at + (1 << 16))
        h = np.array([digest(joined[s:e], 42) for s, e in zip(start[part], end[part], strict=True)], dtype="<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(start), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, words: int = 3) -> DataFrame:
    """Replaces the column ``text`` by ``fp``, the fingerprint as a signed long; other columns are kept.

    A null or empty text has fingerprint 0.
    """
    kept = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t, words) for t in b.column("text").cast(pa.binary()).to_pylist()), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(fps.view(np.int64))], [*kept, "fp"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"), "fp long"])
    return docs.mapInArrow(releasing(run), schema)


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints, and for each pair of bits how many have both: 2,080 numbers, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros((BITS, BITS), dtype=np.int64), 0
        for b in batches:
            v = np.ascontiguousarray(b.column("fp").to_numpy(zero_copy_only=False)).view(np.uint8).reshape(-1, 8)
            for at in range(0, len(v), 1 << 16):
                x = np.unpackbits(v[at : at + (1 << 16)], axis=1, bitorder="little").astype(np.float32)
                total += (x.T @ x).astype(np.int64)
            rows += len(v)
        if rows:
            i, j = np.triu_indices(BITS)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(i * BITS + j, -1)), pa.array(np.append(total[i, j], rows))], ["cell", "n"])

    out, rows = np.zeros((BITS, BITS)), 0
    for cell, n in fps.select("fp").mapInArrow(releasing(run), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        if cell < 0:
            rows = n
        else:
            out[cell // BITS, cell % BITS] = out[cell % BITS, cell // BITS] = n
    return rows, out


def correlated_partitions(rows: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of (nearly) equal width: from the most varying bit left, add those most correlated with the group."""
    p = np.diag(both) / max(rows, 1)
    cov = both / max(rows, 1) - np.outer(p, p)
    spread = np.sqrt(np.outer(np.diag(cov), np.diag(cov)))
    phi = np.abs(np.divide(cov, spread, out=np.zeros_like(cov), where=spread > 1e-12))
    left, groups = list(range(BITS)), []
    for g in range(parts):
        width = BITS // parts + (g < BITS % parts)
        group = [max(left, key=lambda b: (cov[b, b], -b))]
        left.remove(group[0])
        while len(group) < width:
            best = max(left, key=lambda b: (phi[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def segment(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), dtype=np.int64)
    for j, b in enumerate(bits):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << j
    return out


def flips(width: int, radius: int) -> list[int]:
    """Masks that flip exactly ``radius`` of ``width`` bits."""
    return [sum(1 << i for i in c) for c in combinations(range(width), radius)]


def ball_counts(counts: np.ndarray, width: int, most: int) -> np.ndarray:
    """For radius 0..most, how many indexed rows lie within the radius of each value."""
    at, out, total = np.arange(len(counts)), [], np.zeros_like(counts)
    for r in range(most + 1):
        for m in flips(width, r):
            total = total + counts[at ^ m]
        out.append(total)
    return np.stack(out)


def allocate(costs: list[np.ndarray], total: int) -> np.ndarray:
    """Thresholds (rows x partitions, -1: not looked at) with the given sum and the least cost.

    costs: for each partition, threshold -1.. by row, an array (thresholds x rows).
    """
    n, shift = costs[0].shape[1], len(costs)  # sums run from -partitions
    span = total + shift + 1
    best = np.full((span, n), np.inf)
    best[0] = 0.0
    picks = []
    for cost in costs:
        new, pick = np.full((span, n), np.inf), np.zeros((span, n), dtype=np.int8)
        for used in range(span):
            for t in range(min(cost.shape[0], span - used)):
                way = best[used] + cost[t]
                better = way < new[used + t]
                new[used + t][better] = way[better]
                pick[used + t][better] = t
        best = new
        picks.append(pick)
    at, out, cols = np.full(n, span - 1), np.zeros((n, len(costs)), dtype=np.int8), np.arange(n)
    for i in range(len(costs) - 1, -1, -1):
        t = picks[i][at, cols]
        out[:, i] = t - 1
        at = at - t
    return out


def links_of_group(fp: np.ndarray, flag: np.ndarray, max_distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the links between the queries (flag 2) and the index (flag 1) of one bucket connect.

    A flood: each row reached looks only at rows not yet reached, so a dense group takes about one look a row.
    """
    todo_i, todo_q = np.flatnonzero(flag & 1), np.flatnonzero(flag & 2)
    from_, to = [], []
    while len(todo_q):
        seed, todo_q = todo_q[0], todo_q[1:]
        if flag[seed] & 1:
            todo_i = todo_i[todo_i != seed]
        stack = [seed]
        while stack:
            x = stack.pop()
            if flag[x] & 2 and len(todo_i):
                near = np.bitwise_count(fp[todo_i] ^ fp[x]) <= max_distance
                hit, todo_i = todo_i[near], todo_i[~near]
                if len(hit):
                    todo_q = todo_q[~np.isin(todo_q, hit)]
                    from_.append(np.full(len(hit), seed))
                    to.append(hit)
                    stack.extend(hit.tolist())
            if flag[x] & 1 and len(todo_q):
                near = np.bitwise_count(fp[todo_q] ^ fp[x]) <= max_distance
                hit, todo_q = todo_q[near], todo_q[~near]
                if len(hit):
                    todo_i = todo_i[~np.isin(todo_i, hit)]
                    from_.append(np.full(len(hit), seed))
                    to.append(hit)
                    stack.extend(hit.tolist())
    none = np.empty(0, dtype=np.int64)
    return (np.concatenate(from_), np.concatenate(to)) if from_ else (none, none)


def bucket_links(key: np.ndarray, fp: np.ndarray, flag: np.ndarray, max_distance: int, small: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Links within each run of equal keys (sorted): small runs by comparing rows 1, 2, ... apart, all runs at once."""
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    length = np.diff(np.r_[start, len(key)])
    a, b = [], []
    big = length > small
    at = np.flatnonzero(np.repeat(~big, length))
    for gap in range(1, small):
        at = at[at + gap < len(key)]
        at = at[key[at] == key[at + gap]]
        if not len(at):
            break
        other = at + gap
        x, y = flag[at], flag[other]
        ok = (((x & 1) & (y >> 1)) | ((y & 1) & (x >> 1))).astype(bool) & (np.bitwise_count(fp[at] ^ fp[other]) <= max_distance)
        a.append(at[ok])
        b.append(other[ok])
    for s, n in zip(start[big], length[big], strict=True):
        f, t = links_of_group(fp[s : s + n], flag[s : s + n], max_distance)
        a.append(f + s)
        b.append(t + s)
    none = np.empty(0, dtype=np.int64)
    a, b = (np.concatenate(a), np.concatenate(b)) if a else (none, none)
    return fp[a].view(np.int64), fp[b].view(np.int64)


def runs_of_key(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list[np.ndarray]]:
    """Batches sorted by the first column, recut so that no run of equal keys is split."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        cols = [b.column(c).to_numpy(zero_copy_only=False) for c in columns]
        if not len(cols[0]):
            continue
        last = int(np.searchsorted(cols[0], cols[0][-1]))
        if last:
            head = [np.concatenate([*(h[i] for h in held), c[:last]]) for i, c in enumerate(cols)]
            held = []
            yield head
        held.append([c[last:] for c in cols])
    if held:
        yield [np.concatenate([h[i] for h in held]) for i in range(len(columns))]


def fingerprint_links(fps: DataFrame, rows: int, both: np.ndarray, max_distance: int = 3, parts: int | None = None, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect exactly what links of ``max_distance`` bits connect.

    fps: distinct longs ``fp``. parts: number of partitions; four while their 16-bit values are more
    than the fingerprints, three (21 or 22 bits) beyond. Counts of values, at most 4 x 2**16 or 3 x 2**22, go to the driver
    and back to the tasks; nothing that grows with the table does.
    """
    spark = fps.sparkSession
    parts = parts or (max_distance + 1 if rows < 1 << 22 else max(2, max_distance))
    groups = correlated_partitions(rows, both, parts)
    most = 2 if parts > 3 else 1

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.ascontiguousarray(b.column("fp").to_numpy(zero_copy_only=False)).view(np.uint64)
            for i, bits in enumerate(groups):
                val, n = np.unique(segment(v, bits), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(val), i)), pa.array(val), pa.array(n)], ["part", "value", "n"])

    found = fps.mapInArrow(releasing(values), "part long, value long, n long").groupBy("part", "value").agg(F.sum("n").alias("n")).toPandas()
    counts = [np.zeros(1 << len(bits), dtype=np.int64) for bits in groups]
    for i in range(parts):
        own = found[found["part"] == i]
        counts[i][own["value"].to_numpy()] = own["n"].to_numpy()
    shared = spark.sparkContext.broadcast(counts)

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        balls = [ball_counts(c.astype(np.float64), len(g), most) for c, g in zip(counts, groups, strict=True)]
        for b in batches:
            whole = np.ascontiguousarray(b.column("fp").to_numpy(zero_copy_only=False)).view(np.uint64)
            for at in range(0, len(whole), 1 << 15):
                v = whole[at : at + (1 << 15)]
                seg = [segment(v, bits) for bits in groups]
                costs = []
                for i, s in enumerate(seg):
                    tries = np.cumsum([len(flips(len(groups[i]), r)) for r in range(most + 1)])[:, None] * PROBE_COST
                    costs.append(np.vstack([np.zeros((1, len(s))), balls[i][:, s] + tries]))
                radius = allocate(costs, max_distance - parts + 1)
                for i, s in enumerate(seg):
                    out = [(s, v, np.where(radius[:, i] >= 0, 3, 1).astype(np.int8))]
                    for r in range(1, most + 1):
                        wide = radius[:, i] >= r
                        if wide.any():
                            for m in flips(len(groups[i]), r):
                                near = s[wide] ^ m
                                some = counts[i][near] > 0
                                out.append((near[some], v[wide][some], np.full(int(some.sum()), 2, dtype=np.int8)))
                    value, fp, flag = (np.concatenate(x) for x in zip(*out, strict=True))
                    blocks = -(-counts[i][value] // block)
                    for rows_of in ((blocks <= 1), *((blocks == n) for n in np.unique(blocks[blocks > 1]))):
                        n = int(blocks[rows_of].max()) if rows_of.any() else 1
                        own = (mix_block(fp[rows_of]) % np.uint64(n)).astype(np.int64)
                        for side in (1, 2) if n > 1 else (3,):
                            use = (flag[rows_of] & side) > 0
                            for k in range(n if n > 1 else 1):
                                tile = 0 if n == 1 else own[use] * n + k if side == 1 else k * n + own[use]
                                f = flag[rows_of][use] if n == 1 else np.full(int(use.sum()), side, dtype=np.int8)
                                key = (np.int64(i) << 22 | value[rows_of][use]) << 32 | tile
                                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[rows_of][use].view(np.int64)), pa.array(f)], ["bucket", "fp", "flag"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, fp, flag in runs_of_key(batches, ["bucket", "fp", "flag"]):
            a, b = bucket_links(key, np.ascontiguousarray(fp).view(np.uint64), flag.astype(np.int64), max_distance)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    n = shuffle_width(spark)
    dealt = fps.mapInArrow(releasing(probes), "bucket long, fp long, flag byte").repartition(n, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(releasing(verify), "a long, b long")


def mix_block(fp: np.ndarray) -> np.ndarray:
    return (fp * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)


def simhash_components(docs: DataFrame, words: int = 3, max_distance: int = 3, keys: tuple[str, ...] = ("doc_id",), block: int = BLOCK) -> DataFrame:
    """Every row's fingerprint and near-duplicate component.

    docs needs ``doc_id`` and ``text``; other columns are ignored unless named in ``keys``. Returns keys, ``fp``
    (signed long) and ``component_id``: the smallest non-null doc_id reachable over links, null if the component
    has none. Equal fingerprints always link. Null, empty and blank texts have fingerprint 0 and link
    like any other. An empty table gives no rows. Repeated rows each come back.
    """
    bound_batches(docs.sparkSession)
    rows = materialise(with_fingerprint(docs.select(*keys, *(["doc_id"] if "doc_id" not in keys else []), "text"), words), "fingerprints")
    each = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    n, both = bit_counts(each)
    if n == 0:
        return rows.select(*keys, "fp", F.col("doc_id").alias("component_id"))
    found = connected_components(fingerprint_links(each.select("fp"), n, both, max_distance, block=block))
    label = each.join(found.select(F.col("node").alias("fp"), "component"), "fp", "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    least = label.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return rows.join(label.join(least, "component").select("fp", "component_id"), "fp").select(*keys, "fp", "component_id")


def keep_one(docs: DataFrame, words: int = 3, max_distance: int = 3) -> DataFrame:
    """Rows of ``docs``, one of each component: that with the smallest doc_id (then the smallest text hash).

    Rows alike in doc_id and text stay once. Rows with a null doc_id stay only where their component has no other.
    """
    text_key = F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull())
    t, d, k = free_names(docs, "t", "d", "k")
    keyed = docs.withColumn(t, text_key)
    found = simhash_components(keyed.select("doc_id", t, "text"), words, max_distance, keys=("doc_id", t))
    # Components without any id are told apart by their smallest fingerprint's rows: null ids group by component of null.
    stay = found.groupBy(F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("fp"), F.col("fp").cast("string"))).alias("c")).agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", F.col(t).alias("t"))).alias("s")
    )
    stay = stay.select(F.col("s.doc_id").alias(d), F.col("s.t").alias(k))
    kept = keyed.join(stay, F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(t) == F.col(k)), "left_semi")
    return kept.dropDuplicates(["doc_id", t]).drop(t)
