"""Exact top-k search over binary codes by incremental multi-index hashing.

Codes are words of 64 bits, cut into segments of about log2(number of codes) bits. Two codes less than ``segments * (r + 1)`` bits apart have some segment
at most r bits apart. Round r therefore probes the values exactly r bits from each segment of the queries that are not done, and a
query is done once its k-th verified distance lies under that bound. Equal codes are indexed once, with as many of their
smallest ids as an answer can hold, and equal queries are searched once. The join itself verifies: only codes
that can still enter the answer come out of it.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.llm.common import materialise, shuffle_width

BITS = 64


def sign_codes(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, code: an array of 64-bit words; bit j of word i is 1 if component 64 i + j is above 0. All codes have as many words as the longest vector needs.

    Rows with a null id and vectors that are null, empty, or hold a null or non-finite component have no code.
    """
    v = F.col(vector_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x) < float("inf")))
    rows = table.where(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & fine)
    words = max(1, -(-(rows.agg(F.max(F.size(v)).alias("n")).first()["n"] or 1) // BITS))
    bit = lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    word = lambda i: F.aggregate(F.transform(F.slice(v, i * BITS + 1, BITS), bit), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    return rows.select(F.col(id_col).cast("long").alias("id"), F.array(*map(word, range(words))).alias("code"))


def segment_widths(n: int, bits: int = BITS) -> list[int]:
    """Widths of a word's segments for n codes of so many bits: 2 to 16 a word, of log2(n) bits or fewer."""
    m = min(16, max(2, ceil(BITS / max(1.0, log2(max(n, 2))))))
    return [BITS // m + (i < BITS % m) for i in range(m)] * (bits // BITS)


def segments(code: Column, widths: list[int]) -> Column:
    """(seg, value, width) of a code's segments; none reaches over two words."""
    out, at = [], 0
    for i, w in enumerate(widths):
        word = F.get(code, at // BITS)
        value = F.shiftrightunsigned(word, at % BITS).bitwiseAND(F.lit((1 << w) - 1).cast("long"))
        out.append(F.struct(F.lit(i).alias("seg"), value.alias("value"), F.lit(w).cast("long").alias("width")))
        at += w
    return F.array(*out)


def at_radius(value: Column, width: Column, radius: int) -> Column:
    """Array of the values that differ from one in exactly ``radius`` of its ``width`` bits: each step flips a bit above the last one flipped."""
    found = F.array(F.struct(value.alias("v"), F.lit(0).cast("long").alias("next")))
    for _ in range(radius):
        above = lambda x: F.when(x["next"] < width, F.sequence(x["next"], width - 1)).otherwise(F.array().cast("array<bigint>"))
        flip = lambda x: F.transform(above(x), lambda b: F.struct(x["v"].bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b.cast("int"))).alias("v"), (b + 1).alias("next")))
        found = F.flatten(F.transform(found, flip))
    return F.transform(found, lambda x: x["v"])


def distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def answered(asked: DataFrame, found: DataFrame) -> DataFrame:
    """query_id, distance, vec_id: each query with what was found for its code.

    A code that many queries have is dealt to several tasks, in proportion to its share of the queries; the few rows found for it go to each.
    """
    width = 4 * shuffle_width(asked.sparkSession)
    parts = asked.groupBy(F.col("code").alias("q")).agg(F.count("*").alias("n"))
    parts = parts.select("q", F.ceil(F.col("n") * width / F.lit(max(asked.count(), 1))).cast("long").alias("parts"))
    dealt = asked.select(F.col("id").alias("query_id"), F.col("code").alias("q"), F.pmod(F.xxhash64("id"), F.lit(width)).alias("turn"))
    copies = found.join(parts, "q").withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    busy = parts.where("parts > 1").select(F.col("q").alias("b"), F.col("parts").alias("of"))  # at most as many as ``width``
    dealt = dealt.join(F.broadcast(busy), F.col("q") == F.col("b"), "left").withColumn("turn", F.pmod("turn", F.coalesce("of", F.lit(1)).cast("long"))).select("query_id", "q", "turn")
    return dealt.join(copies, ["q", "turn"]).select("query_id", "distance", "vec_id")


def search(codes: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, distance: each query's k nearest rows but its own, by Hamming distance, ties to the smaller id. Exact.

    codes and queries: a long ``id`` and a ``code``, a long or an array of longs, all of the same number. Null ids or codes take no part; rows that share a query's id are
    its own. Fewer than k other rows give fewer rows of answer; an empty table gives none.
    """
    codes, queries = (x.withColumn("code", F.array("code")) if x.schema["code"].dataType.simpleString() == "bigint" else x for x in (codes, queries))
    codes, queries = (x.where(F.col("code").isNotNull() & F.forall("code", lambda w: w.isNotNull())).select("id", "code") for x in (codes, queries))
    rows = codes.where(F.col("id").isNotNull() & F.col("code").isNotNull()).distinct()
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("code").orderBy("id"))).where(F.col("r") <= k + 1)
    index = materialise(ranked.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "codes")
    asked = materialise(queries.where(F.col("id").isNotNull() & F.col("code").isNotNull()).select("id", "code").distinct(), "queries")
    seen = index.agg(F.count("*").alias("n"), F.max(F.size("code")).alias("words")).first()
    bits = BITS * (seen["words"] or 1)
    widths = segment_widths(seen["n"], bits)
    stored = materialise(index.select("code", "ids", F.explode(segments(F.col("code"), widths)).alias("s")).select("s.seg", "s.value", "code", "ids"), "segments")
    active = materialise(asked.select(F.col("code").alias("q")).distinct().withColumn("bound", F.lit(bits)), "active")
    best, done = None, []
    for radius in range(max(widths) + 1):
        probes = active.select("q", "bound", F.explode(segments(F.col("q"), widths)).alias("s"))
        probes = probes.select("q", "bound", "s.seg", F.explode(at_radius(F.col("s.value"), F.col("s.width"), radius)).alias("value"))
        apart = distance(F.col("q"), F.col("code"))
        # Not by broadcast, whatever the files' sizes promise: the probes are many more rows than what they come from.
        hits = probes.hint("merge").join(stored, ["seg", "value"]).where(apart <= F.col("bound")).select("q", apart.alias("distance"), "ids").distinct()
        hits = hits.select("q", "distance", F.explode("ids").alias("vec_id"))
        if best is not None:
            hits = hits.unionByName(best.join(active.select("q"), "q", "left_semi")).distinct()
        order = Window.partitionBy("q").orderBy("distance", "vec_id")
        best = materialise(hits.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).drop("r"), "best")
        state = active.select("q").join(best.groupBy("q").agg(F.count("*").alias("n"), F.max("distance").alias("d")), "q", "left")
        state = state.withColumn("bound", F.when(F.col("n") > k, F.col("d")).otherwise(F.lit(bits)))
        state = materialise(state.withColumn("open", (F.coalesce("n", F.lit(0)) <= k) | (F.col("d") >= len(widths) * (radius + 1))), "state")
        last = radius == max(widths)
        done.append(best.join(state if last else state.where(~F.col("open")), "q", "left_semi"))
        active = state.where("open").select("q", "bound")
        if last or active.isEmpty():
            break
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    out = answered(asked, found).where(F.col("vec_id") != F.col("query_id"))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "distance")
