"""Whole plans for decks: flattening with retries, what a result says, and grids of settings to measure."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions.scalars import message_bytes
from quirefold.operators import flatten, split
from quirefold.sources.shared import checkpointed

# How many files flattening writes, how far it aims under the budget, by what share of the budget it lowers its aim besides what a file was over, and what a page takes besides its picture.
FLATTEN_TRIES, FLATTEN_AIM, FLATTEN_MARGIN, PAGE_OVERHEAD = 3, 0.985, 0.005, 400
# Whole sentences about a result; those with numbers in them stand in ``notes``.
SAID = {
    "original": "Your original already fits. Nothing was changed.",
    "signed": "Left out the Content Credentials, which sign the original’s exact bytes. The original keeps them.",
    "lost": "Text can’t be selected or searched, and links won’t click.",
    "kept": "Text, links and slide order are untouched.",
    "drawings": "Trimmed drawing coordinates to finer than any screen can show.",
    "tidy": "Tidied the file’s internal structure only. Every slide and image is unchanged.",
}
#: Rows of one table of parameters that a grid takes.
MOST_SETTINGS = 10_000


def flatten_plan(versions: DataFrame, decks: DataFrame, tries: int = FLATTEN_TRIES) -> DataFrame:
    """deck_id, page, version, bytes, round, fits: versions of pages, and whether the file that holds them is within the budget.

    decks: deck_id, budget, overhead (bytes of the container), growth (by how much a written file is larger than its parts promise, 1.0 if not at all). Versions are chosen for a target a little under the budget, each with
    what a page of a container usually takes, and a file is written. One that comes out over the budget, though the choice kept to its target, lowers the target by what it is over and a little more; there are
    ``tries`` files at most, and only decks that are still over go on.
    """
    heavier = versions.withColumn("bytes", F.col("bytes") + PAGE_OVERHEAD)
    open_ = decks.select("deck_id", "budget", "overhead", "growth", (F.col("budget") * FLATTEN_AIM).alias("target"))
    done = []
    for n in range(tries):
        chosen = flatten.choose_versions(heavier.join(open_.select("deck_id"), "deck_id", "left_semi"), open_.select("deck_id", F.col("target").alias("budget")))
        chosen = chosen.withColumn("bytes", F.col("bytes") - PAGE_OVERHEAD).withColumnRenamed("fits", "kept_to")
        written = chosen.join(open_, "deck_id").withColumn("written", F.sum("bytes").over(Window.partitionBy("deck_id")) * F.col("growth") + F.col("overhead"))
        written = checkpointed(written.withColumn("over", F.col("written") - F.col("budget")))
        again = (F.col("over") > 0) & F.col("kept_to") & F.lit(n + 1 < tries)
        done.append(written.where(~again).select("deck_id", "page", "version", "bytes", F.lit(n).alias("round"), (F.col("over") <= 0).alias("fits")))
        lower = F.col("target") - F.col("over") - F.col("budget") * FLATTEN_MARGIN
        open_ = written.where(again).select("deck_id", "budget", "overhead", "growth", lower.alias("target")).distinct()
        if n + 1 == tries or open_.isEmpty():
            break
    return reduce(DataFrame.unionByName, done)


def counted(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))


def notes(kind: Column, resized: Column, resaved: Column, untouched: Column, long_edge: Column, drawings: Column, pages: Column, credentials: Column) -> Column:
    """What was done to a deck, as an array of sentences."""
    original, lossless = kind == "original", (kind == "lossless") | ((kind == "split-needed") & long_edge.isNull())
    signed = F.when(F.coalesce(credentials, F.lit(False)), SAID["signed"])
    flat = F.array(
        F.concat(F.lit("Turned "), F.when(pages == 1, "the slide").otherwise(counted(pages, "slide")), F.lit(" into pictures"), F.when(long_edge.isNotNull(), F.concat(F.lit(", at least "), long_edge.cast("string"), F.lit(" pixels across"))).otherwise(""), F.lit(".")),
        F.lit(SAID["lost"]), signed,
    )
    images = F.array(
        F.when((resized > 0) & long_edge.isNotNull(), F.concat(F.lit("Resized "), counted(resized, "image"), F.lit(" for a "), long_edge.cast("string"), F.lit("-pixel-wide slide."))),
        F.when(resaved > 0, F.concat(F.lit("Re-saved "), counted(resaved, "photo"), F.lit(" a little lighter."))),
        F.when(untouched > 0, F.concat(counted(untouched, "image"), F.lit(" left exactly as they were."))),
        F.when(F.coalesce(drawings, F.lit(0)) > 0, SAID["drawings"]),
        F.lit(SAID["kept"]), signed,
    )
    tidy = F.array(F.lit(SAID["tidy"]), signed)
    return F.array_compact(F.when(original, F.array(F.lit(SAID["original"]))).when(kind == "flattened", flat).when(lossless, tidy).otherwise(images))


def outcome(kind: Column, size: Column, target: Column, resized: Column, resaved: Column, checks: Column) -> Column:
    """Engine, quality, message size, and whether the result fits and was verified."""
    rewrote, flat = resized + resaved > 0, kind == "flattened"
    engine = F.when(flat, "flattened").when(kind == "original", "original").when(rewrote, "images").otherwise("qpdf")
    quality = F.when(flat, "strong").when(~rewrote, "preserved").when(resized > 0, "strong").otherwise("optimized")
    return F.struct(engine.alias("engine"), quality.alias("quality"), message_bytes(size).alias("message"), (checks > 0).alias("verified"), ((kind != "split-needed") & (size <= target)).alias("fits"))


def services_for(services: DataFrame, facts: DataFrame, picks: DataFrame) -> DataFrame:
    """id, has, picks, ours: what each service offers (facts: id, need, yes), and what it is picked for (picks: id, for)."""
    has = facts.where("yes").groupBy("id").agg(F.sort_array(F.collect_set("need")).alias("has"))
    own = picks.groupBy("id").agg(F.sort_array(F.collect_set("for")).alias("picks"))
    none = F.array().cast("array<string>")
    out = services.select("id").join(has, "id", "left").join(own, "id", "left")
    return out.select("id", F.coalesce("has", none).alias("has"), F.coalesce("picks", none).alias("picks"), F.array_contains(F.coalesce("picks", none), "all").alias("ours"))


def settings_grid(cases: DataFrame, *parameters: DataFrame) -> DataFrame:
    """Every case with every combination of parameters (tables of a few settings, at most ``MOST_SETTINGS`` rows each), for measuring; a codec's name may join several by ``+``, each a row of its own in ``codecs``."""
    out = cases
    for p in parameters:
        if p.count() > MOST_SETTINGS:
            raise ValueError(f"more than {MOST_SETTINGS} settings")
        out = out.crossJoin(F.broadcast(p))
    return out.withColumn("codecs", F.split("codec", r"\+")) if "codec" in out.columns else out


def picked_tiles(tiles: DataFrame, count: int = 3, flat: float = 4.0) -> DataFrame:
    """image, tile, place: the tiles that judge an image: the most detailed, the smoothest that is not flat, then the next most detailed.

    tiles: image, tile, detail, spread. ``count`` tiles an image, or all if there are fewer; of equal ones the first.
    """
    busy = F.row_number().over(Window.partitionBy("image").orderBy(F.desc("detail"), "tile"))
    ranked = tiles.withColumn("busy", busy)
    smooth = F.when((F.col("busy") >= count) & (F.col("spread") > flat), F.struct("detail", "busy"))
    ranked = ranked.withColumn("s", F.min(smooth).over(Window.partitionBy("image"))["busy"])
    place = F.when(F.col("busy") < count, F.col("busy")).when(F.col("busy") == F.coalesce("s", F.lit(count)), F.lit(count))
    return ranked.withColumn("place", place).where("place IS NOT NULL").select("image", "tile", "place")


def worst_tiles(scores: DataFrame, keys: list[str]) -> DataFrame:
    """keys, score: the worst of a candidate's tiles counts."""
    return scores.groupBy(*keys).agg(F.min("score").alias("score"))


def split_plan_of(pages: DataFrame) -> DataFrame:
    """Decks (deck_id, sizes) that can be split at all: those with two pages or more."""
    return split.decks_of(pages).where(F.size("sizes") >= 2)
