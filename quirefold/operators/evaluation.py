"""Comparing encoders: sizes at equal looks, settings that are good enough, upper medians."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.sources.shared import checkpointed


def family(label: Column) -> Column:
    """``name x12 rest`` as ``name x rest``; a label of one word as it is."""
    parts = F.split(label, r"\s+")
    short = F.concat_ws(" ", F.concat(parts[0], F.lit(" "), F.substring(parts[1], 1, 1)), F.when(F.size(parts) > 2, F.array_join(F.slice(parts, 3, 99), " ")))
    return F.when(F.size(parts) > 1, short).otherwise(label)


def setting(label: Column) -> Column:
    return F.substring(F.split(label, r"\s+")[1], 2, 99).cast("double")


def upper_median(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, median: the middle value of each group, the higher of two; nulls do not count.

    Equal values are counted first. Their counts are dealt by value to ranges of about equal size, so a group of any size is many tasks' work: sums of the
    ranges say in which of them a group's middle lies, and a running sum within those alone finds it.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    counts = checkpointed(counts.repartitionByRange(value).withColumn("__r", F.spark_partition_id()))
    ranges = counts.groupBy(*keys, "__r").agg(F.sum("__n").alias("__in"))
    before = Window.partitionBy(*keys).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(*keys, "__r", F.coalesce(F.sum("__in").over(before), F.lit(0)).alias("__base"), "__in", F.floor(F.sum("__in").over(Window.partitionBy(*keys)) / 2).alias("__middle"))
    hit = ranges.where((F.col("__base") <= F.col("__middle")) & (F.col("__middle") < F.col("__base") + F.col("__in")))
    inside = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = counts.join(hit, [*keys, "__r"]).withColumn("__run", F.col("__base") + F.sum("__n").over(inside))
    return each.where(F.col("__run") > F.col("__middle")).groupBy(*keys).agg(F.min(value).alias("median"))


def bytes_at(points: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """keys, target, bytes_at: the size at which a family reaches a score, straight lines between the logarithms.

    points: keys, score, bytes; targets: keys, target. At or under the lowest score, its size; over the highest, null.
    """
    order = Window.partitionBy(*keys).orderBy("score", "bytes")
    spans = points.select(*keys, "score", "bytes", F.lead("score").over(order).alias("s1"), F.lead("bytes").over(order).alias("b1"), F.row_number().over(order).alias("n"))
    hit = targets.join(spans, keys, "left")
    inside = (F.col("score") <= F.col("target")) & (F.col("target") <= F.col("s1"))
    t = F.when(F.col("s1") == F.col("score"), 0.0).otherwise((F.col("target") - F.col("score")) / (F.col("s1") - F.col("score")))
    line = F.exp(F.log("bytes") + t * (F.log("b1") - F.log("bytes")))
    low = F.max(F.when((F.col("n") == 1) & (F.col("target") <= F.col("score")), F.col("bytes").cast("double")))
    first = F.min_by(F.when(inside, line), F.when(inside, F.col("n")))
    return hit.groupBy(*keys, "target").agg(F.coalesce(low, first).alias("bytes_at"))


def complete_cases(rows: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """keys that have a row of every kind there is."""
    n = rows.agg(F.count_distinct(kind).alias("__n"))
    per = rows.groupBy(*keys).agg(F.count_distinct(kind).alias("__k"))
    return per.join(F.broadcast(n), F.col("__k") == F.col("__n")).select(*keys)


def settings_that_serve(points: DataFrame, targets: DataFrame, keys: list[str], by: str = "family", hit_share: float = 0.9) -> DataFrame:
    """family, fixed, even: the first setting that reaches the target on nine in ten, and the first whose mean is no worse and worst at most 3 under.

    points: keys, family, setting, score; targets: keys, target. Settings rise, but fall for distances (families with a ``d``).
    """
    n = targets.agg(F.count("*").alias("n"))
    per = points.join(targets, keys).groupBy(by, "setting").agg(
        F.sum((F.col("score") >= F.col("target")).cast("int")).alias("ok"), F.count("*").alias("have"), F.avg(F.col("score") - F.col("target")).alias("mean"), F.min(F.col("score") - F.col("target")).alias("worst")
    )
    per = per.join(F.broadcast(n), F.lit(True)).withColumn("order", F.when(F.col(by).rlike(r" d( |$)"), -F.col("setting")).otherwise(F.col("setting")))
    good = F.col("ok") >= hit_share * F.col("n")
    even = (F.col("have") == F.col("n")) & (F.col("mean") >= 0) & (F.col("worst") >= -3)
    pick = lambda c: F.abs(F.min(F.when(c, F.col("order"))))
    return per.groupBy(by).agg(pick(good).alias("fixed"), pick(even).alias("even"))


def rank_services(services: DataFrame, needs: list[str], boosts: list[str]) -> DataFrame:
    """services (id, rank, picks) in order: needs met, then boosts, then their own rank.

    Sorted in ranges; a range's rows are numbered in a task of their own, and begin after the sum of the ranges before.
    """
    met = lambda names: F.size(F.array_intersect("picks", F.array(*map(F.lit, names)).cast("array<string>")))
    order = [F.desc("hits"), F.desc("boost"), F.asc("rank"), F.asc("id")]
    scored = services.select("id", "rank", met(needs).alias("hits"), met(boosts).alias("boost"))
    dealt = checkpointed(scored.repartitionByRange(*order).withColumn("__r", F.spark_partition_id()))
    sizes = dealt.groupBy("__r").agg(F.count("*").alias("__n"))
    # One row a range.
    starts = sizes.select("__r", F.coalesce(F.sum("__n").over(Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    placed = dealt.join(F.broadcast(starts), "__r").withColumn("place", (F.col("__base") + F.row_number().over(Window.partitionBy("__r").orderBy(*order))).cast("int"))
    return placed.select("id", "rank", "hits", "boost", "place")


def relative_totals(sizes: DataFrame, baseline: str) -> DataFrame:
    """family, ratio, missing: a family's sizes (family, image, bytes) over the baseline's of all images, and how many are out of range (null)."""
    whole = sizes.where(F.col("family") == baseline).agg(F.sum("bytes").alias("__whole"))
    per = sizes.groupBy("family").agg(F.sum("bytes").alias("sum"), F.count_if(F.col("bytes").isNull()).alias("missing"))
    return per.join(F.broadcast(whole), F.lit(True)).select("family", (F.coalesce("sum", F.lit(0)) / F.col("__whole")).alias("ratio"), "missing")


def setting_near(points: DataFrame, wanted: DataFrame, keys: list[str], within: float = 1e-6) -> DataFrame:
    """wanted (keys, wanted) with the points (keys, setting, ...) whose setting is that, to rounding: an equal join on cells, then the difference."""
    cell = lambda x: F.floor(x / (2 * within))
    asked = wanted.withColumn("__cell", F.explode(F.array(cell(F.col("wanted") - within), cell(F.col("wanted") + within)))).distinct()
    found = points.withColumn("__cell", cell(F.col("setting"))).join(asked, [*keys, "__cell"])
    return found.where(F.abs(F.col("setting") - F.col("wanted")) < within).drop("__cell").distinct()


def other_families(rows: DataFrame, baseline: str) -> DataFrame:
    """family: all that there are but the baseline."""
    return rows.select("family").distinct().where(F.col("family") != baseline)
