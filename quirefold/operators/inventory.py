"""Image inventory: what each image is, and what it may become."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.sources.shared import as_table, checkpointed

# Filter names.
FLATE = ["/FlateDecode", "/Fl"]
JPEG = ["/DCTDecode", "/DCT"]
GENERAL = [*FLATE, "/LZWDecode", "/LZW", "/ASCII85Decode", "/A85", "/ASCIIHexDecode", "/AHx", "/RunLengthDecode", "/RL"]
LOSSY = [*JPEG, "/JPXDecode", "/JBIG2Decode", "/CCITTFaxDecode", "/CCF", "/RunLengthDecode", "/RL"]
MIN_PIXELS, MIN_BYTES = 128 * 128, 16 * 1024


def color_model(family: Column, components: Column) -> Column:
    """Of a colour space's name; an ICC profile's by its number of components."""
    return (
        F.when(family.isin("/DeviceRGB", "/RGB", "/CalRGB"), "rgb")
        .when(family.isin("/DeviceGray", "/G", "/CalGray"), "gray")
        .when(family.isin("/DeviceCMYK", "/CMYK"), "cmyk")
        .when(family == "/ICCBased", F.when(components == 3, "rgb").when(components == 1, "gray").when(components == 4, "cmyk").otherwise("other"))
        .otherwise("other")
    )


def skip_reason(width: Column, height: Column, bits: Column, model: Column, filters: Column, size: Column, stencil: Column, key_mask: Column) -> Column:
    """Why an image is kept as it is, or null; the first reason that holds."""
    last = F.try_element_at(filters, F.lit(-1))
    jpeg = last.isin(JPEG) & F.forall(F.slice(filters, 1, F.greatest(F.size(filters) - 1, F.lit(0))), lambda f: f.isin(FLATE))
    general = F.forall(filters, lambda f: f.isin(GENERAL))
    return (
        F.when(stencil, "stencil mask")
        .when(~bits.isin(8, 16), F.concat(bits.cast("string"), F.lit("-bit samples")))
        .when(~model.isin("rgb", "gray"), F.concat(model, F.lit(" colour")))
        .when(key_mask, "colour-key mask")
        .when((width * height < MIN_PIXELS) | (size < MIN_BYTES), "small")
        .when(F.coalesce(jpeg, F.lit(False)), F.when(bits != 8, F.concat(bits.cast("string"), F.lit("-bit JPEG"))))
        .when(general, None)
        .otherwise(F.concat(F.array_join(filters, " "), F.lit(" encoding")))
    )


def image_kind(reason: Column, filters: Column) -> Column:
    return F.when(reason.isNotNull(), None).when(F.try_element_at(filters, F.lit(-1)).isin(JPEG), "jpeg").otherwise("raw")


def protected_reason(features: DataFrame) -> DataFrame:
    """deck_id and the first of signature, forms, attachments, javascript that any of its dictionaries shows.

    features: deck_id and a boolean column of each name.
    """
    order = ["signature", "forms", "attachments", "javascript"]
    found = features.groupBy("deck_id").agg(*(F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in order))
    reason = F.coalesce(*(F.when(F.col(c), c) for c in order))
    return found.select("deck_id", reason.alias("reason"))


def restricted(encrypted: Column, capabilities: Column) -> Column:
    """Encrypted with any capability denied."""
    return encrypted & F.exists(F.map_values(capabilities), lambda allowed: allowed == F.lit(False))


def photographic(kind: Column, width: Column, height: Column, model: Column, size: Column) -> Column:
    samples = width * height * F.when(model == "gray", 1).otherwise(3)
    return (kind == "jpeg") | ((samples > 0) & (size / samples >= 0.3))


def accept_output(resized: Column, before: Column, after: Column) -> Column:
    """Whether a rewritten image replaces the old one: lighter if resized, else lighter by a tenth."""
    return F.when(resized, after < before).otherwise(after <= before * 0.9)


def saving_guess(streams: DataFrame, files: DataFrame) -> DataFrame:
    """deck_id, saving: what a lossless rewrite may save, from the streams' filters and what is no stream."""
    f = F.col("filters")
    share = (
        F.when(F.arrays_overlap(f, F.array(*map(F.lit, LOSSY))), 0.0)
        .when(F.size(f) == 0, 0.7)
        .when(F.arrays_overlap(f, F.array(F.lit("/ASCIIHexDecode"), F.lit("/AHx"))), 0.6)
        .when(F.arrays_overlap(f, F.array(F.lit("/ASCII85Decode"), F.lit("/A85"))), 0.3)
        .when(F.arrays_overlap(f, F.array(F.lit("/LZWDecode"), F.lit("/LZW"))), 0.2)
        .otherwise(0.05)
    )
    per = streams.groupBy("deck_id").agg(F.sum(F.col("bytes") * share).alias("s"), F.sum("bytes").alias("n"))
    rest = F.greatest(F.lit(0), F.col("file_bytes") - F.coalesce("n", F.lit(0))) * 0.5
    return files.join(per, "deck_id", "left").select("deck_id", (F.coalesce("s", F.lit(0.0)) + rest).alias("saving"))


def split_reason(kept: Column, other: Column, budget: Column) -> Column:
    return F.when(kept + other < budget * 0.9, "quality-floor").when(kept > other, "kept-images").otherwise("not-photos")


def with_masks(images: DataFrame, masks: DataFrame) -> DataFrame:
    """images (deck_id, ref, reach, has_matte) with what their soft masks inherit: masks (deck_id, ref, mask_ref, matte).

    A mask is drawn wherever its images are; it is listed if it was not; a matte holds for it too.
    """
    owners = masks.join(images, ["deck_id", "ref"]).select("deck_id", F.col("mask_ref").alias("ref"), F.col("ref").alias("owner"), "reach", "matte")
    own = owners.groupBy("deck_id", "ref").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("reach")))).alias("more"), F.sort_array(F.collect_set("owner")).alias("mask_of"), F.bool_or("matte").alias("m"))
    out = images.join(own, ["deck_id", "ref"], "full")
    none = F.array().cast("array<int>")
    reach = F.array_sort(F.array_union(F.coalesce("reach", none), F.coalesce("more", none)))
    return out.select("deck_id", "ref", reach.alias("reach"), (F.coalesce("has_matte", F.lit(False)) | F.coalesce("m", F.lit(False))).alias("has_matte"), "mask_of")


#: A plan reads so many tables of a closure at most.
MOST_TABLES = 16


def reachable(edges: DataFrame, roots: DataFrame, away: tuple[str, ...] = ()) -> DataFrame:
    """deck_id, root, ref: everything a root leads to over edges (deck_id, src, key, dst), but for keys that lead away.

    A frontier at a time, each a join and an anti-join by deck, so cycles end; it goes on until nothing new is reached.
    """
    usable = edges.where(~F.col("key").isin(*away)) if away else edges
    usable = as_table(usable.select(F.col("deck_id").alias("d"), "src", "dst").distinct(), "edges")
    seen = as_table(roots.select("deck_id", "root", F.col("root").alias("ref")).distinct(), "reached")
    frontier, tables = seen, 1
    while True:
        step = frontier.join(usable, (F.col("deck_id") == F.col("d")) & (F.col("ref") == F.col("src"))).select("deck_id", "root", F.col("dst").alias("ref")).distinct()
        # Every frontier is a table that is written once; all of them together are what was reached, put into one now and then.
        frontier = as_table(step.join(seen, ["deck_id", "root", "ref"], "left_anti"), "reached")
        if frontier.isEmpty():
            return seen
        seen, tables = seen.unionByName(frontier), tables + 1
        if tables == MOST_TABLES:
            seen, tables = as_table(seen, "reached"), 1


def inherited(nodes: DataFrame, most: int = 64) -> DataFrame:
    """deck_id, ref, value: the nearest value up the parents of nodes (deck_id, ref, parent, value)."""
    out = nodes.select("deck_id", "ref", "parent", "value")
    up = nodes.select(F.col("deck_id").alias("d"), F.col("ref").alias("r"), F.col("parent").alias("p"), F.col("value").alias("v"))
    open_, done = out.where("value IS NULL AND parent IS NOT NULL"), out.where("value IS NOT NULL OR parent IS NULL")
    for _ in range(most):
        step = open_.join(up, (F.col("deck_id") == F.col("d")) & (F.col("parent") == F.col("r")), "left")
        step = checkpointed(step.select("deck_id", "ref", F.col("p").alias("parent"), F.col("v").alias("value")))
        done = done.unionByName(step.where("value IS NOT NULL OR parent IS NULL"))
        open_ = step.where("value IS NULL AND parent IS NOT NULL")
        if open_.isEmpty():
            break
    return done.unionByName(open_).select("deck_id", "ref", "value")


def page_images(declared: DataFrame, reached: DataFrame, images: DataFrame) -> DataFrame:
    """deck_id, ref, pages, reach: each image with the pages that name it and those from which it can be reached, both sorted.

    declared, reached: deck_id, page, ref, as often as they come; images: deck_id, ref of what can be read as an image. An image that no page names but one reaches is listed too.
    """
    both = declared.select("deck_id", "page", "ref", F.lit(True).alias("named")).unionByName(reached.select("deck_id", "page", "ref", F.lit(False).alias("named")))
    pages = lambda c: F.sort_array(F.collect_set(F.when(c, F.col("page"))))
    found = both.join(images.select("deck_id", "ref").distinct(), ["deck_id", "ref"], "left_semi")
    return found.groupBy("deck_id", "ref").agg(pages(F.col("named")).alias("pages"), pages(~F.col("named")).alias("reach"))


def without_credentials(objects: DataFrame, manifests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """objects (deck_id, ref, kind) without a deck's manifests (deck_id, ref), and (deck_id, refused): whether any object of that kind is left, so that the deck is not rewritten."""
    left = objects.join(manifests, ["deck_id", "ref"], "left_anti")
    return left, left.groupBy("deck_id").agg(F.bool_or(F.col("kind") == "manifest").alias("refused"))


def untracked(resources: DataFrame, forms: DataFrame, roots: DataFrame) -> DataFrame:
    """deck_id, page, ref, kind: what pages draw without a tracked operator: images and forms of soft masks, patterns and glyphs; kind ``inherits`` (ref null) if some of it has no resources of its own.

    resources: deck_id, owner, key, ref, subtype: the entries of each owner's own dictionary, where owner is a page, form or font, key ``/XObject``, ``/SMask``, ``/Pattern`` or ``/Font``, subtype
    that of the object (``/Image``, ``/Form``, ``/Type3``, or null). forms: deck_id, ref of the streams and fonts that have resources of their own. roots: deck_id, page, owner.
    A closure over (object, whether it is tracked): an object can be met both ways, once each.
    """
    key, sub = F.col("key"), F.col("subtype")
    entries = checkpointed(resources.select(F.col("deck_id").alias("d"), F.col("owner").alias("o"), "key", "ref", "subtype").distinct())
    own = forms.select("deck_id", F.col("ref"), F.lit(True).alias("owns")).distinct()
    seen, found = None, None
    frontier = checkpointed(roots.select("deck_id", "page", F.col("owner").alias("at"), F.lit(True).alias("tracked")).distinct())
    kind = resources.schema["ref"].dataType.simpleString()
    while True:
        into = F.when((key == "/XObject") & (sub == "/Form"), F.col("tracked")).when(key.isin("/SMask", "/Pattern") | ((key == "/Font") & (sub == "/Type3")), F.lit(False))
        met = frontier.join(entries, (F.col("deck_id") == F.col("d")) & (F.col("at") == F.col("o"))).join(own, ["deck_id", "ref"], "left")
        met = checkpointed(met.select("deck_id", "page", "ref", "key", "subtype", "tracked", into.alias("into"), "owns").distinct())
        hidden = F.coalesce(~F.col("into"), F.lit(False))
        told = lambda when, name, ref: F.when(when, F.struct(ref.cast(kind).alias("ref"), F.lit(name).alias("kind")))
        seen_by = F.array(
            told((key == "/XObject") & (sub == "/Image") & ~F.col("tracked"), "image", F.col("ref")), told(hidden & (key != "/Font"), "form", F.col("ref")),
            told(hidden & F.col("owns").isNull(), "inherits", F.lit(None)),
        )
        new = checkpointed(met.select("deck_id", "page", F.explode(F.array_compact(seen_by)).alias("x")).select("deck_id", "page", "x.ref", "x.kind").distinct())
        found = new if found is None else found.unionByName(new)
        seen = frontier if seen is None else checkpointed(seen.unionByName(frontier).distinct())
        ahead = met.where(F.col("into").isNotNull() & F.col("owns").isNotNull()).select("deck_id", "page", F.col("ref").alias("at"), F.col("into").alias("tracked")).distinct()
        frontier = checkpointed(ahead.join(seen, ["deck_id", "page", "at", "tracked"], "left_anti"))
        if frontier.isEmpty():
            return found.distinct()
