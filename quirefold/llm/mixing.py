"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key. Within a source, the keys' range is cut into equal ranges of a bounded
expected number of rows; sums of the ranges give each range its start, a running sum within the range gives each document its
own. A document is taken as many whole times as the target holds the source, and once more, wholly or in part,
if its start lies before what is left of the target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirefold.llm.common import SPACE, free_names, materialise, word_count

#: Expected rows of one range of keys.
RANGE_ROWS = 1 << 12
#: Sources up to this many are broadcast; a longer list is joined by a shuffle.
BROADCAST_SOURCES = 10_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row a source: source, n_docs, source_size, target.

    Sources by code point (null last) weigh ``weights``, repeating. Targets share ``share`` of all sizes by
    weight, none above ``most`` times its source; what is cut off is shared again, by weight, until none is above. In closed
    form: sources fill up in the order of their size by weight, and the first level at which the rest fit is the answer.
    The windows without a key see one row a source, not the documents.
    """
    per = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("double")
    per = per.withColumn("w", weight).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    whole, before = Window.partitionBy(), order.rowsBetween(Window.unboundedPreceding, -1)
    left = share * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    heavy = F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    level = per.withColumn("level", left / heavy)
    fits = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct((F.col("cap") / F.col("w")).alias("at"), F.col("level").alias("level")))
    level = level.withColumn("first", F.min(fits).over(whole)["level"])
    target = F.when(F.col("first").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("first") * F.col("w")))
    return level.select("source", "n_docs", "source_size", target.alias("target"))


def mix_takes(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, range_rows: int = RANGE_ROWS, keep: tuple[str, ...] = ()) -> DataFrame:
    """What the mix takes of each document: keep, doc_id, source, size, source_size, target, taken (words, repeats counted).

    Sizes are numbers of words, 0 for a null text. The order within a source is by MD5 of the doc_id, so reruns
    agree; rows that repeat a doc_id follow one another, by size. The document at the cut is taken in part, so a
    source's words are its target rounded down. Documents without words are taken 0 times, null doc_ids
    come last. A source of null is a source like any other. An empty table gives no rows.
    """
    key = F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit("g"))
    # Only these columns travel, so names of the caller's own clash with none of those made here.
    docs = docs.select(*keep, "doc_id", "source", "text")
    tag = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    rows = materialise(docs.select(*keep, "doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    per = materialise(source_targets(rows, weights, share, most), "sources")
    per_side = per.select(tag.alias("__s"), "n_docs", "source_size", "target")
    if per.count() <= BROADCAST_SOURCES:
        per_side = F.broadcast(per_side)
    # Which of the source's equal ranges of keys a document lies in; those without an id lie behind all.
    at = F.conv(F.substring("__key", 1, 8), 16, 10).cast("double") / float(1 << 32)
    at = F.when(F.col("doc_id").isNull(), F.lit(2.0)).otherwise(at)
    n = F.ceil(F.col("n_docs") / F.lit(float(range_rows)))
    placed = rows.withColumn("__key", key).withColumn("__s", tag).join(per_side, "__s").withColumn("__range", F.floor(at * n).cast("long"))
    sums = placed.groupBy("__s", "__range").agg(F.sum("size").alias("__sum"))
    before = Window.partitionBy("__s").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("__s", "__range", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy("__s", "__range").orderBy("__key", "doc_id", "size", *keep).rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("__run", F.coalesce(F.sum("size").over(within), F.lit(0))).join(starts, ["__s", "__range"])
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size") - (F.col("__base") + F.col("__run"))
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return placed.select(*keep, "doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **how: object) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each time a document is taken.

    A document taken in part keeps its first words, joined by single spaces, and its ``n_chars`` is counted
    anew where there is such a column. Documents that are not taken go, with them null, empty and blank texts. Rows alike in doc_id and text have
    a take each. A null doc_id and a null source count like any other. An empty table gives no rows.
    """
    t, i, k, row, size, taken, n = free_names(docs, "t", "i", "k", "row", "size", "taken", "n")
    keyed = docs.withColumn(t, F.xxhash64(F.coalesce("text", F.lit("")))).withColumn(i, F.coalesce(F.col("doc_id").cast("string"), F.lit("none")))
    takes = mix_takes(keyed, keep=(t, i), **how).groupBy(t, i).agg(F.max("size").alias(size), F.sort_array(F.collect_list("taken"), asc=False).alias(k)).where(F.col(k)[0] > 0)
    # Sorted by the join's keys already, so the number of a row among its equals costs no exchange.
    joined = keyed.join(takes.hint("merge"), [t, i]).withColumn(row, F.row_number().over(Window.partitionBy(t, i).orderBy(F.lit(1))))
    joined = joined.withColumn(taken, F.get(k, F.col(row) - 1)).where(F.col(taken) > 0)
    whole, part = F.floor(F.col(taken) / F.col(size)).cast("int"), F.col(taken) % F.col(size)
    lengths = F.concat(F.array_repeat(F.col(size), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))
    out = joined.withColumn(n, F.explode(lengths))
    words = F.split(F.regexp_replace("text", f"^{SPACE}", ""), SPACE)
    text = F.when(F.col(n) == F.col(size), F.col("text")).otherwise(F.array_join(F.slice(words, 1, F.col(n).cast("int")), " "))
    out = out.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
