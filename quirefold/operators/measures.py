"""Weighted worst shares, running averages, checks of a rewritten deck, and row-wise decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.sources.shared import checkpointed


def weighted_worst(blocks: DataFrame, keys: list[str], share: float = 0.05) -> DataFrame:
    """keys, clarity: mean of the weighted mean score and of that of the lowest scores that hold the share of the weight.

    blocks: keys, score, weight, n (ties in order). The block that crosses the share counts. Blocks are dealt by score to ranges of about equal size, so a group of any size is many tasks' work: sums of
    the ranges say which of them lie wholly below the share, and a running sum is taken within the one that crosses it.
    """
    rows = blocks.select(*keys, "score", "weight", "n").repartitionByRange("score", "n").withColumn("__r", F.spark_partition_id())
    rows = checkpointed(rows)
    sums = rows.groupBy(*keys, "__r").agg(F.sum("weight").alias("__w"), F.sum(F.col("score") * F.col("weight")).alias("__s"))
    group = Window.partitionBy(*keys)
    base = F.coalesce(F.sum("__w").over(group.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    sums = checkpointed(sums.withColumn("__base", base).withColumn("__share", F.sum("__w").over(group) * share))
    below = F.col("__base") + F.col("__w") <= F.col("__share")
    # Null-safe, as null keys are a group like any other.
    crossed = sums.where(~below & (F.col("__base") < F.col("__share"))).select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__r").alias("__at"), "__base", "__share")
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col("__r") == F.col("__at")]
    order = Window.partitionBy(*keys).orderBy("score", "n").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.join(crossed, same).withColumn("__before", F.col("__base") + F.coalesce(F.sum("weight").over(order), F.lit(0.0)))
    inside = inside.where(F.col("__before") < F.col("__share")).select(*keys, F.col("weight").alias("__lw"), (F.col("score") * F.col("weight")).alias("__ls"))
    none = F.lit(None).cast("double")
    both = sums.select(*keys, "__w", "__s", F.when(below, F.col("__w")).alias("__lw"), F.when(below, F.col("__s")).alias("__ls")).unionByName(inside.select(*keys, none.alias("__w"), none.alias("__s"), "__lw", "__ls"))
    return both.groupBy(*keys).agg(((F.sum("__s") / F.sum("__w") + F.sum("__ls") / F.sum("__lw")) / 2).alias("clarity"))


def running_speed(rows: DataFrame, keys: list[str], order: str, value: str, keep: float = 0.7) -> DataFrame:
    """keys, speed: the first value, then ``keep`` of what was and the rest of the new one, in order of ``order`` and value.

    What is left of a value after all later ones is a power of ``keep``, so a sum by the row's place from the end gives the same: rows stream through a window, and no history is gathered.
    """
    back = Window.partitionBy(*keys).orderBy(F.desc(order), F.desc(value))
    first = F.lead(F.lit(1)).over(back).isNull()
    weight = F.pow(F.lit(keep), F.row_number().over(back) - 1) * F.when(first, 1.0).otherwise(1 - keep)
    return rows.withColumn("__part", F.col(value) * weight).groupBy(*keys).agg(F.sum("__part").alias("speed"))


def verify_pages(before: DataFrame, after: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """deck_id, same_count, same_sizes: whether a rewritten deck has its pages, each as large to half a unit.

    before, after: deck_id, page, width, height.
    """
    b = after.select("deck_id", "page", F.col("width").alias("w"), F.col("height").alias("h"), F.lit(1).alias("new"))
    both = before.withColumn("old", F.lit(1)).join(b, ["deck_id", "page"], "full")
    close = F.coalesce((F.abs(F.col("width") - F.col("w")) <= tolerance) & (F.abs(F.col("height") - F.col("h")) <= tolerance), F.lit(False))
    return both.groupBy("deck_id").agg((F.count("old") == F.count("new")).alias("same_count"), F.bool_and(close).alias("same_sizes"))


def fit_decision(size: Column, budget: Column, readable: Column) -> Column:
    return F.when(~readable, "unreadable").when(size <= budget, "original").otherwise("rewrite")


def lightest(attempts: DataFrame) -> DataFrame:
    """deck_id, bytes, predicted, measured: the lightest attempt, and the lightest of those that were built."""
    real = attempts.where("bytes > 0")
    return real.groupBy("deck_id").agg(F.min("bytes").alias("bytes"), F.min_by("predicted", F.struct("bytes", "seq")).alias("predicted"), F.min(F.when(~F.col("predicted"), F.col("bytes"))).alias("measured"))


def keep_shorter(streams: DataFrame, least: int = 65_536) -> DataFrame:
    """deck_id, ref, bytes: streams that got shorter (bytes from before to after), in decks that save enough by it."""
    gain = streams.where("after < before").withColumn("saved", F.sum(F.col("before") - F.col("after")).over(Window.partitionBy("deck_id")))
    return gain.where(F.col("saved") >= least).select("deck_id", "ref", F.col("after").alias("bytes"))
