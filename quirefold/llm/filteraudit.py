"""How filters interact: what every order of them removes, from counts by the set of filters that a document fails.

Each document becomes a mask of the filters that it fails. Documents are counted by part and mask, once; a subset-zeta transform turns a part's counts into
the survivors of every subset of filters, and a step of an order is the difference between two neighbouring subsets. Labels are counted likewise. All of it is DataFrame functions.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import SPACE, materialise

#: Filters of ``failures``, in the order of the mask's bits.
FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, MARKS = 200, 50, 3, "[#$%&*|]"
MEASURES = ("n", "good", "toxic")


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic of each document; bit k of mask is set where it fails the k-th filter.

    A: under 200 words. B: fewer than 50 distinct words of 100. C: more than 3 capitals A-Z of 100 code points. D: holds one of ``MARKS``. E: the same text as a row with a smaller doc_id.
    Texts are taken whole, null as empty; a null lang is the part ``''``. A row without doc_id is never later than another, nor labelled. Rows that repeat a doc_id count each.
    A doc_id with several labels is good, or toxic, if one of them says so.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    slim = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
    slim = slim.select("doc_id", "part", "text", words.alias("words"))
    fails = [
        F.size("words") < LEAST_WORDS,
        100 * F.size(F.array_distinct("words")) < DISTINCT_PERCENT * F.size("words"),
        100 * F.regexp_count("text", F.lit("[A-Z]")) > CAPITAL_PERCENT * F.length("text"),
        F.col("text").rlike(MARKS),
    ]
    rows = materialise(slim.select("doc_id", "part", mask_of(fails).alias("mask"), F.sha2("text", 256).alias("digest")), "masks")
    first = rows.groupBy(F.col("digest").alias("d")).agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")).where("rows > 1")
    # Written, so that both sides of the join are shuffled to it, and Spark's skew join can split a common text's rows.
    first = materialise(first, "first")
    said = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    both = rows.join(first.select("d", "first"), F.col("digest") == F.col("d"), "left").join(said, F.col("doc_id") == F.col("id"), "left")
    later = F.when(F.col("doc_id") > F.col("first"), 1 << FILTERS.index("E")).otherwise(0)
    none = F.lit(0)
    return both.select("part", F.col("mask").bitwiseOR(later).alias("mask"), F.coalesce("good", none).alias("good"), F.coalesce("toxic", none).alias("toxic"))


def mask_of(fails: list[Column]) -> Column:
    """Whole number whose bit k is set where the k-th condition holds; null counts as not."""
    out = F.lit(0)
    for k, f in enumerate(fails):
        out = out + F.when(f, 1 << k).otherwise(0)
    return out


def zeta(counts: Column, filters: int) -> Column:
    """Of an array by mask, the sums over all subsets of each mask: one pass over the array for each bit."""
    bits = F.array(*[F.lit(1 << k) for k in range(filters)])
    passed = lambda sums, bit: F.transform(sums, lambda x, i: x + F.when(i.bitwiseAND(bit) != 0, F.get(sums, i.bitwiseXOR(bit))).otherwise(0))
    return F.aggregate(bits, counts, passed)


def survivors(masks: DataFrame, filters: int) -> DataFrame:
    """part, and for each measure (n, good, toxic) two arrays: counts by mask failed, and survivors by the subset of filters applied."""
    full = (1 << filters) - 1
    counts = masks.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    # One array a part: 2**filters cells, whatever the number of documents.
    each = [F.expr(f"sum(CASE WHEN mask = {m} THEN {c} ELSE 0 END)") for c in MEASURES for m in range(full + 1)]
    arrays = [F.array(*each[k * (full + 1) : (k + 1) * (full + 1)]).alias(f"{c}_by_mask") for k, c in enumerate(MEASURES)]
    parts = counts.groupBy("part").agg(*arrays)
    # Who survives a set of filters fails none of them: its mask is a subset of the others.
    return parts.withColumns({f"{c}_left": F.reverse(zeta(F.col(f"{c}_by_mask"), filters)) for c in MEASURES})


def order_audit(masks: DataFrame, names: str = FILTERS) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: every step of every order of the filters, in every part.

    masks: part (null is a part of its own), mask, good (0/1), toxic (0/1), a row for each document; a filter's letter in ``names`` stands for the bit of its place. At most 6 filters: there
    are names! orders. kept: left after the step; removed: by it; redundant: failing its filter, but removed before; unique_fails: failing no other; good_lost and toxic_lost: removed with that label;
    shapley: what its filter removes, added over all orders. No documents, no rows.
    """
    n = len(names)
    if not 1 <= n <= 6:
        raise ValueError("1 to 6 filters")
    parts = survivors(masks, n)
    weights = F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)).cast("long") for k in range(n)])
    subsets = F.sequence(F.lit(0), F.lit((1 << n) - 1))

    def shapley(bit: int) -> Column:
        without = F.filter(subsets, lambda s: s.bitwiseAND(bit) == 0)
        drop = lambda s: F.get("n_left", s) - F.get("n_left", s.bitwiseOR(F.lit(bit)))
        return F.aggregate(without, F.lit(0).cast("long"), lambda a, s: a + F.get(weights, F.bit_count(s)) * drop(s))

    parts = parts.withColumn("shares", F.array(*[shapley(1 << k) for k in range(n)]))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(names)])
    rows = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    rows = rows.withColumn("place", F.expr(f"instr('{names}', substr(filter_order, step, 1)) - 1"))
    rows = rows.withColumn("before", F.expr(f"aggregate(sequence(1, {n}), 0, (a, i) -> a + CASE WHEN i < step THEN shiftleft(1, instr('{names}', substr(filter_order, i, 1)) - 1) ELSE 0 END)"))
    rows = rows.withColumn("bit", F.expr("shiftleft(1, place)")).withColumn("after", F.col("before").bitwiseOR(F.col("bit")))
    lost = lambda c: F.get(f"{c}_left", F.col("before")) - F.get(f"{c}_left", F.col("after"))
    failing = F.get("n_left", F.lit(0)) - F.get("n_left", F.col("bit"))
    return rows.select(
        "part", "filter_order", "step", F.get("n_left", F.col("after")).alias("kept"), lost("n").alias("removed"), (failing - lost("n")).alias("redundant"),
        F.get("n_by_mask", F.col("bit")).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.get("shares", F.col("place")).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``order_audit`` of the filters of ``failures`` over whole documents.

    Null texts, langs, doc_ids and labels, repeated rows and foreign columns as ``failures`` says; an empty table of documents gives no rows, one of labels no good and no toxic documents.
    """
    return order_audit(failures(docs, labels))
