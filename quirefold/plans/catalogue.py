"""All queries over the driver's tables, and their SQL.

The tables stand for decks: an order is a deck, a line number of it an image, placed on the page of that number. The same
SQL derives both sides' inputs; each operator is then DataFrame code on one side and plain SQL on the other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.functions import pixels, scalars
from quirefold.operators import content, evaluation, flatten, inventory, ladder, measures, split
from quirefold.sources import objects
from quirefold.streaming import progress

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

IMAGES = """SELECT l_orderkey AS deck_id, CAST(l_linenumber AS BIGINT) AS ref, CAST(floor(max(l_quantity) * 90) AS BIGINT) + 80 AS width,
    CAST(floor(max(l_quantity) * 55) AS BIGINT) + 60 AS height, CAST(floor(max(l_extendedprice) * 40) AS BIGINT) AS bytes,
    CASE max(l_suppkey) % 5 WHEN 0 THEN '/DeviceGray' WHEN 1 THEN '/DeviceCMYK' WHEN 2 THEN '/CalRGB' ELSE '/DeviceRGB' END AS space,
    CASE WHEN max(l_partkey) % 13 = 0 THEN 1 WHEN max(l_partkey) % 7 = 0 THEN 16 ELSE 8 END AS bits,
    CASE max(ascii(l_returnflag)) WHEN 65 THEN '/DCTDecode' WHEN 78 THEN '/FlateDecode' ELSE '/JPXDecode' END AS filter,
    max(l_partkey) % 17 = 0 AS stencil, max(l_partkey) % 19 = 0 AS key_mask, max(l_discount) > 0.09 AS has_matte, max(l_tax) > 0.07 AS is_mask
    FROM {lineitem} WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL GROUP BY l_orderkey, l_linenumber"""
PAGES = "SELECT DISTINCT l_orderkey AS deck_id, CAST(l_linenumber AS BIGINT) AS page, CASE WHEN l_orderkey % 3 = 0 THEN 595.0 ELSE 960.0 END AS page_width, CASE WHEN l_orderkey % 3 = 0 THEN 842.0 ELSE 540.0 END AS page_height FROM {lineitem}"
PLACED = "SELECT l_orderkey AS deck_id, CAST(l_linenumber AS BIGINT) AS ref, CAST(l_linenumber AS BIGINT) AS page, l_quantity * 18.0 AS width, l_quantity * 11.0 AS height FROM {lineitem} WHERE l_linestatus = 'F'"
FILES = "SELECT o_orderkey AS deck_id, CAST(floor(o_totalprice * 100) AS BIGINT) AS file_bytes FROM {orders}"
BUDGETS = "SELECT deck_id, sum(bytes) * 0.6 AS budget FROM ({images}) i GROUP BY deck_id"
KIND = """CASE WHEN reason IS NOT NULL THEN NULL WHEN filter = '/DCTDecode' THEN 'jpeg' ELSE 'raw' END"""
MODEL = "CASE space WHEN '/DeviceGray' THEN 'gray' WHEN '/DeviceCMYK' THEN 'cmyk' ELSE 'rgb' END"
REASON = """CASE WHEN stencil THEN 'stencil mask' WHEN bits NOT IN (8, 16) THEN bits || '-bit samples' WHEN model = 'cmyk' THEN 'cmyk colour' WHEN key_mask THEN 'colour-key mask'
    WHEN width * height < 16384 OR bytes < 16384 THEN 'small' WHEN filter = '/DCTDecode' THEN CASE WHEN bits <> 8 THEN bits || '-bit JPEG' END
    WHEN filter = '/FlateDecode' THEN NULL ELSE filter || ' encoding' END"""


def duck(text: str) -> str:
    for name in ("lineitem", "orders", "events", "part", "pages"):
        text = text.replace("{" + name + "}", name)
    return text.replace("{images}", duck(IMAGES)) if "{images}" in text else text


def base(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    text = text.replace("{images}", IMAGES)
    names = [n for n in ("lineitem", "orders", "events", "part", "pages") if "{" + n + "}" in text]
    return spark.sql(text, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = duck(sql)
        return f

    return register


def inventory_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = base(spark, sf_dir, IMAGES).withColumn("model", inventory.color_model(F.col("space"), F.lit(None).cast("int"))).withColumn("filters", F.array("filter"))
    i = i.withColumn("reason", inventory.skip_reason(*(F.col(c) for c in ("width", "height", "bits", "model", "filters", "bytes", "stencil", "key_mask"))))
    i = i.withColumn("kind", inventory.image_kind(F.col("reason"), F.col("filters")))
    return i.withColumn("photo", inventory.photographic(F.coalesce("kind", F.lit("")), F.col("width"), F.col("height"), F.col("model"), F.col("bytes")))


INVENTORY = f"""SELECT *, kind = 'jpeg' OR bytes / (width * height * CASE WHEN model = 'gray' THEN 1 ELSE 3 END) >= 0.3 AS photo0 FROM (SELECT *, {KIND} AS kind FROM (SELECT *, {REASON} AS reason FROM (SELECT *, {MODEL} AS model FROM ({{images}}) a) b) c) d"""


@query(f"SELECT deck_id, ref, model, reason, kind, coalesce(kind = 'jpeg', false) OR bytes / (width * height * CASE WHEN model = 'gray' THEN 1 ELSE 3 END) >= 0.3 AS photo FROM ({INVENTORY}) x")
def p1_image_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory_of(spark, sf_dir).select("deck_id", "ref", "model", "reason", "kind", "photo")


@query("""SELECT deck_id, greatest(0, file_bytes - coalesce(photos, 0) - coalesce(kept, 0)) AS other, coalesce(photos, 0) AS photos, coalesce(kept, 0) AS kept,
    CASE WHEN coalesce(kept, 0) + greatest(0, file_bytes - coalesce(photos, 0) - coalesce(kept, 0)) < file_bytes * 0.5 * 0.9 THEN 'quality-floor'
    WHEN coalesce(kept, 0) > greatest(0, file_bytes - coalesce(photos, 0) - coalesce(kept, 0)) THEN 'kept-images' ELSE 'not-photos' END AS reason
    FROM (""" + FILES + f""") f LEFT JOIN (SELECT deck_id, CAST(sum(CASE WHEN kind IS NOT NULL THEN bytes ELSE 0 END) AS BIGINT) AS photos, CAST(sum(CASE WHEN kind IS NULL THEN bytes ELSE 0 END) AS BIGINT) AS kept FROM ({INVENTORY}) x GROUP BY deck_id) w USING (deck_id)""")
def a11_p13_weight_and_split_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = base(spark, sf_dir, FILES)
    w = ladder.weight_of(inventory_of(spark, sf_dir), files).join(files, "deck_id")
    return w.select("deck_id", "other", "photos", "kept", inventory.split_reason(F.col("kept"), F.col("other"), F.col("file_bytes") * 0.5).alias("reason"))


RUNG_SQL = "(VALUES " + ", ".join(f"({i}, {r[1]}, {r[2]}::DOUBLE, {r[3]}::DOUBLE)" for i, r in enumerate(ladder.RUNGS)) + ") r(rung, long_edge, quality, default_share)"
SCALE = f"""(SELECT i.deck_id, i.ref, r.rung, CASE WHEN s.known AND s.share * r.long_edge > 0 AND s.share * r.long_edge < 0.85 THEN s.share * r.long_edge ELSE 1.0::DOUBLE END AS scale
    FROM ({{images}}) i CROSS JOIN {RUNG_SQL} LEFT JOIN (SELECT p.deck_id, p.ref, max(greatest(p.width / i.width, p.height / i.height) / greatest(g.page_width, g.page_height)::DOUBLE) AS share,
    bool_and(g.page IS NOT NULL) AS known FROM ({PLACED}) p JOIN ({{images}}) i USING (deck_id, ref) LEFT JOIN ({PAGES}) g ON g.deck_id = p.deck_id AND g.page = p.page GROUP BY 1, 2) s ON s.deck_id = i.deck_id AND s.ref = i.ref)"""


def scales_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ladder.needed_scale(base(spark, sf_dir, IMAGES), base(spark, sf_dir, PLACED), base(spark, sf_dir, PAGES), ladder.rungs(spark))


@query(f"SELECT * FROM {SCALE} z")
def a1_needed_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scales_of(spark, sf_dir)


PLANS = f"""(SELECT deck_id, ref, rung, CAST(CASE WHEN sc < 1 THEN greatest(16, floor(width * sc + 0.5)) ELSE width END AS BIGINT) AS target_width,
    CAST(CASE WHEN sc < 1 THEN greatest(16, floor(height * sc + 0.5)) ELSE height END AS BIGINT) AS target_height,
    CASE WHEN kind IS NULL THEN NULL WHEN model = 'gray' THEN CASE WHEN kind = 'jpeg' OR (photo AND NOT is_mask) THEN 'jpeg-gray' WHEN sc < 1 THEN 'flate-gray' END WHEN photo THEN 'jpeg' WHEN sc < 1 THEN 'flate-rgb' END AS format,
    quality AS q, sc < 1 AS resized, photo, bytes, default_share, width, height
    FROM (SELECT x.*, z.rung, CASE WHEN has_matte THEN 1.0::DOUBLE ELSE z.scale END AS sc, r.quality, r.default_share, coalesce(photo0, bytes / (x.width * x.height * CASE WHEN model = 'gray' THEN 1 ELSE 3 END) >= 0.3) AS photo
        FROM ({INVENTORY}) x JOIN {SCALE} z USING (deck_id, ref) JOIN {RUNG_SQL} ON r.rung = z.rung) y)"""


def plans_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = inventory_of(spark, sf_dir).withColumnRenamed("model", "color_model").select("deck_id", "ref", "width", "height", "bytes", "color_model", "kind", "photo", "has_matte", "is_mask")
    return ladder.plan_images(i, scales_of(spark, sf_dir), ladder.rungs(spark))


@query(f"SELECT deck_id, ref, rung, target_width, target_height, format, CASE WHEN format LIKE 'jpeg%' THEN q END AS quality, resized FROM {PLANS} p")
def o6_plan_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans_of(spark, sf_dir).select("deck_id", "ref", "rung", "target_width", "target_height", "format", "quality", "resized")


@query(f"SELECT deck_id, ref, target_width, target_height, format, q AS quality, array_to_string(list_sort(list(rung)), ',') AS rungs FROM (SELECT deck_id, ref, rung, target_width, target_height, format, CASE WHEN format LIKE 'jpeg%' THEN q END AS q FROM {PLANS} p WHERE format IS NOT NULL) t GROUP BY 1, 2, 3, 4, 5, 6")
def d3_distinct_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ladder.distinct_targets(plans_of(spark, sf_dir)).withColumn("rungs", F.array_join(F.transform("rungs", lambda x: x.cast("string")), ","))


def totals_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = plans_of(spark, sf_dir)
    none = spark.createDataFrame([], "deck_id long, photo boolean, rung int, cal_base double, cal_after double")
    return ladder.deck_totals(ladder.predict(plans, none))


PREDICTED = f"""(SELECT *, CASE WHEN format IS NOT NULL AND CASE WHEN resized THEN size < bytes ELSE size <= bytes * 0.9::DOUBLE END THEN size ELSE bytes::DOUBLE END AS predicted
    FROM (SELECT *, bytes * pow(target_width * target_height / (width * height), 0.85) * CASE WHEN photo THEN default_share ELSE 1 END AS size FROM {PLANS} p) q)"""


#: Sizes are added as whole thousandths of a byte, which come to the same in any order.
TOTAL = "CAST(sum(CAST(floor(predicted * 1000 + 0.5) AS BIGINT)) AS DOUBLE) / 1000::DOUBLE"


@query(f"SELECT deck_id, rung, round({TOTAL}, 3) AS total FROM {PREDICTED} p GROUP BY 1, 2")
def a5_predicted_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals_of(spark, sf_dir).select("deck_id", "rung", F.round("total", 3).alias("total"))


@query(f"""SELECT deck_id, CAST(coalesce(best, -1) AS INT) AS expected, CASE WHEN best IS NOT NULL THEN array_to_string(list_filter([best - 1, best, best + 1], lambda x: x BETWEEN 0 AND 5), ',')
    WHEN spl = 5 THEN '5' ELSE spl || ',5' END AS encode FROM (SELECT deck_id, min(CASE WHEN total <= budget * 0.97::DOUBLE THEN rung END) AS best, min(CASE WHEN ceil(total / (budget * 0.92::DOUBLE)) <= ceil(lastt / (budget * 0.92::DOUBLE)) THEN rung END) AS spl
    FROM (SELECT t.*, b.budget::DOUBLE AS budget, last_value(total) OVER (PARTITION BY t.deck_id ORDER BY rung ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lastt FROM (SELECT deck_id, rung, {TOTAL} AS total FROM {PREDICTED} p GROUP BY 1, 2) t JOIN ({BUDGETS}) b USING (deck_id)) u GROUP BY deck_id) v""")
def t6_t7_choose_rungs(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = ladder.choose_rungs(totals_of(spark, sf_dir), base(spark, sf_dir, BUDGETS).withColumn("budget", F.col("budget").cast("double")))
    return chosen.na.fill(-1, ["expected"]).withColumn("encode", F.array_join(F.transform("encode", lambda x: x.cast("string")), ","))


@query("""SELECT deck_id, ref, bytes, n FROM (SELECT *, coalesce(min(CASE WHEN run >= al * 0.15::DOUBLE THEN n END) OVER (PARTITION BY deck_id), count(*) OVER (PARTITION BY deck_id)) AS enough FROM
    (SELECT deck_id, ref, bytes, CAST(row_number() OVER w AS INT) AS n, sum(bytes) OVER (PARTITION BY deck_id ORDER BY bytes DESC, ref ROWS UNBOUNDED PRECEDING) AS run, sum(bytes) OVER (PARTITION BY deck_id) AS al FROM ({images}) i WINDOW w AS (PARTITION BY deck_id ORDER BY bytes DESC, ref)) a) b
    WHERE n <= least(8, greatest(3, 4, enough))""")
def t9_first_wave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ladder.first_wave(base(spark, sf_dir, IMAGES))


@query(f"""SELECT i.deck_id, i.ref, round(greatest(0.01::DOUBLE, coalesce(c, 1.0::DOUBLE)), 9) AS coverage FROM ({{images}}) i LEFT JOIN (SELECT p.deck_id, p.ref, sum(least(1.0::DOUBLE, p.width * p.height / (g.page_width * g.page_height)::DOUBLE)) AS c
    FROM ({PLACED}) p JOIN ({PAGES}) g ON g.deck_id = p.deck_id AND g.page = p.page GROUP BY 1, 2) s USING (deck_id, ref)""")
def a8_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ladder.coverage(base(spark, sf_dir, PLACED), base(spark, sf_dir, PAGES), base(spark, sf_dir, IMAGES))
    return out.withColumn("coverage", F.round("coverage", 9))


#: Objects of a page: its image, a font that all pages of a deck use, and a logo on its first three pages.
USES = """SELECT deck_id, ref AS page, ref AS ref, bytes FROM ({images}) i UNION ALL SELECT deck_id, ref, 1000, deck_id % 50000 FROM ({images}) i UNION ALL SELECT deck_id, ref, 1001, deck_id % 9000 FROM ({images}) i WHERE ref <= 3"""
SPLIT = f"""WITH u AS ({USES}), n AS (SELECT deck_id, count(DISTINCT page) AS n FROM u GROUP BY 1), r AS (SELECT deck_id, ref, count(DISTINCT page) AS c, max(bytes) + 24 AS w FROM u GROUP BY 1, 2),
    s AS (SELECT n.deck_id, CAST(floor((16384 + coalesce(sum(CASE WHEN c = n THEN w END), 0)) * 1.015::DOUBLE + 0.5) AS BIGINT) AS shared FROM n JOIN r USING (deck_id) GROUP BY n.deck_id),
    g AS (SELECT u.deck_id, u.page, CAST(floor((24 + coalesce(sum(CASE WHEN c < n THEN w / c::DOUBLE END), 0)) * 1.015::DOUBLE + 0.5) AS BIGINT) AS bytes FROM u JOIN r USING (deck_id, ref) JOIN n USING (deck_id) GROUP BY 1, 2)"""


def split_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    uses = base(spark, sf_dir, USES)
    return split.split_plan(uses, uses.select("deck_id", "page"))


@query(SPLIT + " SELECT deck_id, page, bytes, shared FROM g JOIN s USING (deck_id)")
def a6_split_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared, pages = split_of(spark, sf_dir)
    return pages.join(shared, "deck_id").select("deck_id", "page", "bytes", "shared")


PACK = (
    SPLIT.replace("WITH u", "WITH RECURSIVE u")
    + """, e AS (SELECT deck_id, bytes, row_number() OVER (PARTITION BY deck_id ORDER BY page) AS k, shared, 1000000.0::DOUBLE AS budget FROM g JOIN s USING (deck_id)),
    f AS (SELECT deck_id, k, 1 AS part, bytes::DOUBLE AS run FROM e WHERE k = 1 UNION ALL SELECT e.deck_id, e.k, CASE WHEN shared + run + bytes > budget THEN part + 1 ELSE part END, CASE WHEN shared + run + bytes > budget THEN bytes ELSE run + bytes END::DOUBLE FROM f JOIN e ON e.deck_id = f.deck_id AND e.k = f.k + 1)"""
)


def decks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared, pages = split_of(spark, sf_dir)
    return split.decks_of(pages).withColumn("sizes", F.transform("sizes", lambda x: x.cast("double"))).join(shared, "deck_id")


@query(PACK + " SELECT deck_id, CAST(greatest(2, max(part)) AS INT) AS parts FROM f GROUP BY 1")
def w7_fewest_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decks_of(spark, sf_dir).select("deck_id", split.fewest_parts(F.col("sizes"), F.col("shared"), F.lit(1_000_000.0)).alias("parts"))


@query(SPLIT.replace("WITH u", "WITH RECURSIVE u") + """, e AS (SELECT deck_id, row_number() OVER (PARTITION BY deck_id ORDER BY page) AS k, sum(bytes) OVER (PARTITION BY deck_id ORDER BY page) AS run FROM g),
    t AS (SELECT deck_id, max(k) AS pages, max(run)::DOUBLE / 3 AS share, list(run ORDER BY k) AS s FROM e GROUP BY 1 HAVING max(k) >= 3),
    w AS (SELECT deck_id, 0 AS k, []::BIGINT[] AS b, 0::BIGINT AS reached, false AS stop FROM t UNION ALL
        SELECT deck_id, k, CASE WHEN use THEN list_append(b, least(CASE WHEN share * k - coalesce(s[q - 1], 0) < s[q] - share * k AND q - 1 > coalesce(b[len(b)], 0) THEN q - 1 ELSE q END, pages - (3 - k))) ELSE b END, CASE WHEN use THEN q ELSE reached END, NOT use
        FROM (SELECT w.deck_id, w.k + 1 AS k, w.b, w.reached, t.s, t.share, t.pages, list_filter(range(w.reached + 1, t.pages), lambda p: t.s[p] >= t.share * (w.k + 1))[1] AS q, NOT w.stop AND q IS NOT NULL AS use FROM w JOIN t USING (deck_id) WHERE w.k < 2) x),
    f AS (SELECT w.deck_id, w.b, pages FROM w JOIN t USING (deck_id) WHERE k = 2), f1 AS (SELECT deck_id, pages, CASE WHEN len(b) < 1 THEN list_append(b, least(pages - 1, 1)) ELSE b END AS b FROM f),
    f2 AS (SELECT deck_id, pages, CASE WHEN len(b) < 2 THEN list_append(b, least(pages - 1, b[1] + 1)) ELSE b END AS b FROM f1)
    SELECT deck_id, array_to_string(b, ',') AS breaks, b[1] >= 1 AND b[2] > b[1] AND b[2] < pages AS valid FROM f2""")
def w6_even_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    decks = decks_of(spark, sf_dir).where(F.size("sizes") >= 3).select("deck_id", F.size("sizes").alias("pages"), split.even_breaks(F.col("sizes"), F.lit(3)).alias("b"))
    return decks.select("deck_id", F.array_join(F.transform("b", lambda x: x.cast("string")), ",").alias("breaks"), split.valid_breaks(F.col("b"), F.col("pages")).alias("valid"))


@query(SPLIT + ", e AS (SELECT deck_id, bytes, row_number() OVER (PARTITION BY deck_id ORDER BY page) AS k, count(*) OVER (PARTITION BY deck_id) AS m, shared FROM g JOIN s USING (deck_id)) SELECT deck_id, CAST(CASE WHEN k <= 2 THEN 1 ELSE 2 END AS INT) AS part, CAST(min(k) AS INT) AS start_page, CAST(max(k) AS INT) AS end_page, sum(bytes) + max(shared)::DOUBLE AS bytes, sum(bytes) + max(shared) <= 2000000 AS fits FROM e WHERE m > 2 GROUP BY 1, 2")
def o9_explicit_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    decks = decks_of(spark, sf_dir).where(F.size("sizes") > 2)
    return split.parts_of(decks, F.array(F.lit(2), F.size("sizes")), F.col("shared"), F.lit(2_000_000.0))


@query(f"""WITH u AS ({USES}), h AS (SELECT DISTINCT deck_id, CASE WHEN page <= 3 THEN 1 ELSE 2 END AS part, ref, bytes FROM u), p AS (SELECT DISTINCT deck_id, page FROM u)
    SELECT p.deck_id, CAST(CASE WHEN page <= 3 THEN 1 ELSE 2 END AS INT) AS part, CAST(count(*) * 100 + max(i.b) AS BIGINT) AS bytes FROM p JOIN (SELECT deck_id, part, sum(bytes) AS b FROM h GROUP BY 1, 2) i ON i.deck_id = p.deck_id AND i.part = CASE WHEN page <= 3 THEN 1 ELSE 2 END GROUP BY 1, 2""")
def a7_part_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = base(spark, sf_dir, USES)
    pages = uses.select("deck_id", "page").distinct()
    part = F.when(F.col("page") <= 3, 1).otherwise(2)
    ranges = pages.groupBy("deck_id", part.alias("part")).agg(F.min("page").alias("start_page"), F.max("page").alias("end_page"))
    out = split.part_estimates(ranges, uses, pages.withColumn("bytes", F.lit(100)), pages.select("deck_id").distinct().withColumn("shared", F.lit(0)))
    # Pages that a range spans but the deck lacks carry nothing.
    return out.select("deck_id", "part", F.col("bytes").cast("long").alias("bytes"))


@query("""WITH RECURSIVE e AS (SELECT deck_id, ref, bytes, row_number() OVER (PARTITION BY deck_id ORDER BY ref) AS k FROM ({images}) i),
    f AS (SELECT deck_id, k, 1 AS batch, bytes::DOUBLE AS run FROM e WHERE k = 1 UNION ALL SELECT e.deck_id, e.k, CASE WHEN run + bytes > 3000000 THEN batch + 1 ELSE batch END, CASE WHEN run + bytes > 3000000 THEN bytes ELSE run + bytes END::DOUBLE FROM f JOIN e ON e.deck_id = f.deck_id AND e.k = f.k + 1)
    SELECT deck_id, CAST(k AS INT) AS k, CAST(batch AS INT) AS batch FROM f""")
def s6_byte_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    decks = split.decks_of(base(spark, sf_dir, IMAGES).withColumnRenamed("ref", "page"))
    each = split.byte_batches(F.transform("sizes", lambda x: x.cast("double")), F.lit(3_000_000.0))
    return decks.select("deck_id", F.posexplode(each).alias("k", "batch")).select("deck_id", (F.col("k") + 1).alias("k"), "batch")


@query("SELECT deck_id, seq, length, CAST(\"offset\" AS BIGINT) AS \"offset\", lpad(CAST(\"offset\" AS VARCHAR), 10, '0') || ' 00000 n ' AS entry FROM (SELECT deck_id, ref AS seq, bytes AS length, 9 + coalesce(sum(bytes) OVER (PARTITION BY deck_id ORDER BY ref ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM ({images}) i) o")
def w9_byte_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.byte_offsets(base(spark, sf_dir, IMAGES).select("deck_id", F.col("ref").alias("seq"), F.col("bytes").alias("length")))


VERSIONS = """SELECT deck_id, ref AS page, CAST(v AS INT) AS version, CAST(floor(bytes * (1.0 - v * 0.11) + (deck_id * 7 + ref * 13 + v * 29) % 97 * 50) AS BIGINT) AS bytes,
    1.0 - v * 0.045 - ((deck_id + ref * 3 + v * 11) % 13) * 0.004 AS clarity FROM ({images}) i CROSS JOIN (SELECT 0 AS v UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7) x"""


def versions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir, VERSIONS).withColumn("clarity", F.col("clarity").cast("double"))


HULL = f"""WITH v AS (SELECT deck_id, page, version, bytes, clarity::DOUBLE AS clarity FROM ({VERSIONS}) x WHERE version = 0 OR clarity >= {flatten.CLARITY_FLOOR}),
    k AS (SELECT * FROM v p WHERE NOT EXISTS (SELECT 1 FROM v q WHERE q.deck_id = p.deck_id AND q.page = p.page AND q.clarity >= p.clarity
        AND (q.bytes < p.bytes OR q.bytes = p.bytes AND (q.clarity > p.clarity OR q.version < p.version)))),
    u AS (SELECT DISTINCT p.deck_id, p.page, p.version FROM k p JOIN k a ON a.deck_id = p.deck_id AND a.page = p.page JOIN k c ON c.deck_id = p.deck_id AND c.page = p.page
        WHERE a.bytes < p.bytes AND c.bytes > p.bytes AND (p.bytes - a.bytes) * (c.clarity - a.clarity) >= (p.clarity - a.clarity) * (c.bytes - a.bytes)),
    h AS (SELECT deck_id, page, version, bytes FROM k ANTI JOIN u USING (deck_id, page, version))"""


@query(HULL + " SELECT deck_id, page, string_agg(version::VARCHAR, ',' ORDER BY bytes DESC) AS hull FROM h GROUP BY 1, 2")
def o11_usable_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten.usable_versions(versions_of(spark, sf_dir)).select("deck_id", "page", F.array_join(F.transform("hull", lambda x: x["version"].cast("string")), ",").alias("hull"))


@query()
def o12_lagrangian_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten.choose_versions(versions_of(spark, sf_dir), base(spark, sf_dir, BUDGETS).withColumn("budget", F.col("budget").cast("double")))


def fixed_sql(x: str, places: int) -> str:
    """The nearest decimal by the exact binary value; where two are as near, which only eighths can be, the larger."""
    k = 10**places
    tie = f"({x}) * 8 = floor(({x}) * 8) AND ({x}) * {2 * k} = floor(({x}) * {2 * k}) AND CAST(({x}) * {2 * k} AS BIGINT) % 2 = 1"
    return f"format('{{:.{places}f}}', CASE WHEN {tie} THEN (floor(({x}) * {k}) + 1) / {k} ELSE ({x})::DOUBLE END)"


SHOWN = "CASE WHEN v >= 100 THEN " + fixed_sql("v", 0) + " WHEN v >= 10 THEN " + fixed_sql("v", 1) + " ELSE " + fixed_sql("v", 2) + " END"
#: Numbers of bytes of every size, many of them near the middle between two texts.
SIZES = "SELECT event_id, CAST(floor(abs(value) * 997) AS BIGINT) * CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 1005 WHEN 2 THEN 1000125 ELSE 31 END + event_id % 7 * 5 AS n FROM {events} WHERE value IS NOT NULL"


@query(f"""SELECT event_id, CASE WHEN n < 1000 THEN n || ' B' ELSE {SHOWN} || unit END AS shown, CAST(CASE WHEN n <= 0 OR n // 3 >= n THEN 0 ELSE floor((1 - (n // 3)::DOUBLE / n) * 100 + 0.5) END AS INT) AS lighter,
    (n // 60000) || ':' || lpad(CAST((n // 1000) % 60 AS VARCHAR), 2, '0') AS elapsed, CAST(ceil(n * 1.3684::DOUBLE + 524288) AS BIGINT) AS message,
    CAST(greatest(1, floor((round(least(70, greatest(5, n % 90)) * 1000000)::BIGINT - 524288) / 1.3684::DOUBLE)) AS BIGINT) AS budget, (77 * (n % 256) + 150 * (n % 199) + 29 * (n % 97) + 128) >> 8 AS luma
    FROM (SELECT event_id, n, CASE WHEN n < 1000000 THEN n / 1000.0::DOUBLE WHEN n < 1000000000 THEN n / 1000.0::DOUBLE / 1000 ELSE n / 1000.0::DOUBLE / 1000 / 1000 END AS v, CASE WHEN n < 1000000 THEN ' KB' WHEN n < 1000000000 THEN ' MB' ELSE ' GB' END AS unit FROM ({SIZES}) e) f""")
def f1_f27_formats_and_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = base(spark, sf_dir, SIZES), F.col("n")
    return e.select(
        "event_id", scalars.format_bytes(n).alias("shown"), scalars.percent_lighter(n, F.floor(n / 3)).alias("lighter"), scalars.format_elapsed(n).alias("elapsed"),
        scalars.message_bytes(n).alias("message"), scalars.custom_budget(n % 90).alias("budget"), scalars.luminance(n % 256, n % 199, n % 97).alias("luma"),
    )


@query(r"""SELECT page_id, CASE WHEN trim(stem) = '' THEN 'deck' ELSE trim(stem) END || '-part-' || lpad(CAST(page_id % 9 + 1 AS VARCHAR), 2, '0') || '-of-12.pdf' AS name
    FROM (SELECT page_id, regexp_replace(regexp_replace(url, '[\\/:*?"<>|]+', '-', 'g'), '\s+', ' ', 'g') AS stem FROM {pages}) p""")
def s12_output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = base(spark, sf_dir, "SELECT page_id, url FROM {pages}")
    return p.select("page_id", scalars.email_version_name(F.concat("url", F.lit(".pdf")), F.col("page_id") % 9 + 1, F.lit(12)).alias("name"))


@query("SELECT page_id, page_id % 1100 <= 1024 AS is_pdf FROM {pages}")
def s1_magic_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = base(spark, sf_dir, "SELECT page_id, CAST(concat(repeat(' ', CAST(page_id % 1100 AS INT)), '%PDF-1.7', html) AS BINARY) AS content FROM {pages}")
    return p.select("page_id", scalars.magic_within(F.col("content")).alias("is_pdf"))


LOOKS_SQL = "CASE WHEN q <= 0.66 THEN 63.9::DOUBLE " + " ".join(f"WHEN q <= {b[0]}::DOUBLE THEN {a[1]}::DOUBLE + (q - {a[0]}::DOUBLE) / ({b[0]}::DOUBLE - {a[0]}::DOUBLE) * ({b[1]}::DOUBLE - {a[1]}::DOUBLE)" for a, b in zip(scalars.LOOKS, scalars.LOOKS[1:], strict=False)) + " ELSE 85.0::DOUBLE END"


@query(f"SELECT event_id, round({LOOKS_SQL}, 6) AS target FROM (SELECT event_id, 0.6::DOUBLE + (event_id % 31)::DOUBLE / 100 AS q FROM {{events}}) e")
def f20_looks_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = base(spark, sf_dir, "SELECT event_id, CAST(0.6 AS DOUBLE) + CAST(event_id % 31 AS DOUBLE) / 100 AS q FROM {events}")
    return e.select("event_id", F.round(scalars.looks_target(F.col("q")), 6).alias("target"))


POINTS = "SELECT p_partkey % 40 AS image, CASE p_partkey % 3 WHEN 0 THEN 'canvas q' WHEN 1 THEN 'jpegli d' ELSE 'mozjpeg q' END AS family, CAST(p_size AS DOUBLE) AS setting, 40.0 + CAST(p_size AS DOUBLE) + CAST(p_partkey % 7 AS DOUBLE) / 10 AS score, max(CAST(floor(p_retailprice * 100) AS BIGINT)) AS bytes FROM {part} GROUP BY 1, 2, 3, 4"


@query(f"""WITH p AS ({POINTS}), t AS (SELECT image, family, 62.0::DOUBLE AS target FROM p GROUP BY 1, 2), s AS (SELECT *, lead(score) OVER w AS s1, lead(bytes) OVER w AS b1, row_number() OVER w AS n FROM p WINDOW w AS (PARTITION BY image, family ORDER BY score, bytes))
    SELECT image, family, target, round(coalesce(max(CASE WHEN n = 1 AND target <= score THEN bytes::DOUBLE END), min_by(CASE WHEN score <= target AND target <= s1 THEN exp(ln(bytes) + CASE WHEN s1 = score THEN 0 ELSE (target - score) / (s1 - score) END * (ln(b1) - ln(bytes))) END, CASE WHEN score <= target AND target <= s1 THEN n END)), 3) AS bytes_at FROM t JOIN s USING (image, family) GROUP BY 1, 2, 3""")
def f28_bytes_at_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = base(spark, sf_dir, POINTS).withColumn("score", F.col("score").cast("double"))
    out = evaluation.bytes_at(p, p.select("image", "family").distinct().withColumn("target", F.lit(62.0)), ["image", "family"])
    return out.withColumn("bytes_at", F.round("bytes_at", 3))


@query("SELECT event_type, list_sort(list(value))[count(value) // 2 + 1] AS median FROM {events} WHERE value IS NOT NULL GROUP BY 1")
def a15_upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.upper_median(base(spark, sf_dir, "SELECT event_type, value FROM {events}"), ["event_type"], "value")


@query("SELECT l_suppkey FROM {lineitem} GROUP BY 1 HAVING count(DISTINCT l_returnflag) = (SELECT count(DISTINCT l_returnflag) FROM {lineitem})")
def j13_complete_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.complete_cases(base(spark, sf_dir, "SELECT l_suppkey, l_returnflag FROM {lineitem}"), ["l_suppkey"], "l_returnflag")


EVENTS = "SELECT user_id AS job_id, CAST(floor(value * 10) AS BIGINT) + event_id * 40 AS ts_ms, event_id AS seq, CASE event_type WHEN 'click' THEN 'inspect' WHEN 'view' THEN 'photos' WHEN 'error' THEN 'verify' ELSE 'split' END AS stage, CAST(event_id % 101 AS DOUBLE) / 100 AS within, CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 20 AS INT) END AS page FROM {events} WHERE user_id IS NOT NULL AND value IS NOT NULL"
FRACTION = "CASE stage " + " ".join(f"WHEN '{s}' THEN {a}::DOUBLE + ({b}::DOUBLE - {a}::DOUBLE) * within" for s, (a, b) in progress.BANDS.items()) + " END"


@query(f"""WITH e AS (SELECT *, stage IS DISTINCT FROM lag(stage) OVER (PARTITION BY job_id ORDER BY ts_ms, seq) AS forced FROM ({EVENTS}) x), r AS (SELECT *, max({FRACTION}) OVER w AS v, CAST(sum(forced::INT) OVER w AS BIGINT) AS epoch FROM e WINDOW w AS (PARTITION BY job_id ORDER BY ts_ms, seq ROWS UNBOUNDED PRECEDING))
    SELECT job_id, ts_ms, seq, stage, CAST(floor(v * 1000 + 0.5) AS BIGINT) AS permille, epoch, coalesce(last_value(page IGNORE NULLS) OVER (PARTITION BY job_id, epoch ORDER BY ts_ms, seq ROWS UNBOUNDED PRECEDING), 0) AS page, forced FROM r""")
def w1_w4_monotone_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.monotone(base(spark, sf_dir, EVENTS)).na.fill(0, ["page"])


@query(f"""WITH RECURSIVE e AS (SELECT *, stage IS DISTINCT FROM lag(stage) OVER (PARTITION BY job_id ORDER BY ts_ms, seq) AS forced, row_number() OVER (PARTITION BY job_id ORDER BY ts_ms, seq) AS k FROM ({EVENTS}) x),
    r AS (SELECT job_id, ts_ms, seq, k, forced, CAST(floor(max({FRACTION}) OVER (PARTITION BY job_id ORDER BY k ROWS UNBOUNDED PRECEDING) * 1000 + 0.5) AS BIGINT) AS permille FROM e),
    w AS (SELECT job_id, k, ts_ms, seq, permille, true AS sent, ts_ms AS last FROM r WHERE k = 1 UNION ALL
        SELECT r.job_id, r.k, r.ts_ms, r.seq, r.permille, r.forced OR r.ts_ms - w.last >= 80, CASE WHEN r.forced OR r.ts_ms - w.last >= 80 THEN r.ts_ms ELSE w.last END FROM w JOIN r ON r.job_id = w.job_id AND r.k = w.k + 1)
    SELECT job_id, ts_ms, seq, permille FROM w WHERE sent""")
def w2_throttled_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.throttled(progress.monotone(base(spark, sf_dir, EVENTS)))


@query(f"SELECT job_id, after_ms, gap FROM (SELECT job_id, lag(ts_ms) OVER (PARTITION BY job_id ORDER BY ts_ms, seq) AS after_ms, ts_ms - lag(ts_ms) OVER (PARTITION BY job_id ORDER BY ts_ms, seq) AS gap FROM ({EVENTS}) e) g WHERE gap > 3000")
def r4_stalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.stalls(base(spark, sf_dir, EVENTS), 3000)


#: Pages' trees with shared nodes, cycles through keys that lead away, and loops.
EDGES = """SELECT deck_id, src, "key", CASE WHEN "key" IN ('/Parent', '/Popup') THEN CAST(floor(src / 2) AS BIGINT) WHEN "key" = '/Font' THEN src * 7 % 300 ELSE least(299, src * 2 + n) END AS dst
    FROM (SELECT l_suppkey % 50 AS deck_id, l_partkey % 300 AS src, l_linenumber AS n, CASE l_linenumber WHEN 7 THEN '/Parent' WHEN 6 THEN '/Popup' WHEN 5 THEN '/Font' ELSE '/XObject' END AS "key" FROM {lineitem}) e"""


@query(f"""WITH RECURSIVE e AS (SELECT DISTINCT deck_id, src, dst FROM ({EDGES}) x WHERE "key" NOT IN ('/Parent', '/Popup')), w AS (SELECT DISTINCT deck_id, src AS root, src AS ref FROM e WHERE src < 10 UNION SELECT w.deck_id, root, dst FROM w JOIN e ON e.deck_id = w.deck_id AND e.src = w.ref) SELECT * FROM w""")
def g3_g6_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = base(spark, sf_dir, EDGES.replace('"key"', "key"))
    roots = edges.where((F.col("src") < 10) & ~F.col("key").isin(*split.AWAY)).select("deck_id", F.col("src").alias("root"))
    return inventory.reachable(edges, roots, split.AWAY)


@query(f"SELECT deck_id, round(coalesce(s, 0) + greatest(0, file_bytes - coalesce(n, 0)) * 0.5::DOUBLE, 3) AS saving FROM ({FILES}) f LEFT JOIN (SELECT deck_id, sum(bytes * CASE WHEN filter = '/FlateDecode' THEN 0.05::DOUBLE ELSE 0 END) AS s, sum(bytes) AS n FROM ({{images}}) i GROUP BY 1) x USING (deck_id)")
def p19_saving_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    streams = base(spark, sf_dir, IMAGES).withColumn("filters", F.array("filter"))
    return inventory.saving_guess(streams, base(spark, sf_dir, FILES)).withColumn("saving", F.round("saving", 3))


@query("SELECT deck_id, CASE WHEN bool_or(stencil) THEN 'signature' WHEN bool_or(key_mask) THEN 'forms' WHEN bool_or(has_matte) THEN 'attachments' WHEN bool_or(is_mask) THEN 'javascript' END AS reason FROM ({images}) i GROUP BY 1")
def p3_protected_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = base(spark, sf_dir, IMAGES)
    return inventory.protected_reason(i.select("deck_id", F.col("stencil").alias("signature"), F.col("key_mask").alias("forms"), F.col("has_matte").alias("attachments"), F.col("is_mask").alias("javascript")))



@query("""WITH o AS (SELECT deck_id, ref, ref + 1 AS mask_ref, has_matte FROM ({images}) i WHERE is_mask), a AS (SELECT deck_id, ref, ref AS page, has_matte AS m FROM ({images}) i UNION ALL SELECT deck_id, mask_ref, ref, has_matte FROM o)
    SELECT deck_id, ref, array_to_string(list_sort(list(DISTINCT page)), ',') AS reach, bool_or(m) AS has_matte FROM a GROUP BY 1, 2""")
def j2_soft_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = base(spark, sf_dir, IMAGES)
    images = i.select("deck_id", "ref", F.array(F.col("ref").cast("int")).alias("reach"), "has_matte")
    masks = i.where("is_mask").select("deck_id", "ref", (F.col("ref") + 1).alias("mask_ref"), F.col("has_matte").alias("matte"))
    out = inventory.with_masks(images, masks)
    return out.select("deck_id", "ref", F.array_join(F.transform("reach", lambda x: x.cast("string")), ",").alias("reach"), "has_matte")


NODES = "SELECT DISTINCT l_suppkey % 20 AS deck_id, l_partkey % 200 AS ref, CASE WHEN l_partkey % 200 >= 2 THEN CAST(floor((l_partkey % 200) / 2) AS BIGINT) END AS parent, CASE WHEN l_partkey % 200 < 3 OR l_partkey % 200 % 9 = 0 THEN l_partkey % 200 * 10 END AS value FROM {lineitem}"


@query(f"""WITH RECURSIVE n AS ({NODES}), w AS (SELECT deck_id, ref, parent, value FROM n UNION ALL SELECT w.deck_id, w.ref, n.parent, n.value FROM w LEFT JOIN n ON n.deck_id = w.deck_id AND n.ref = w.parent WHERE w.value IS NULL AND w.parent IS NOT NULL)
    SELECT deck_id, ref, coalesce(max(value), -1) AS value FROM w GROUP BY 1, 2""")
def g2_inherited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.inherited(base(spark, sf_dir, NODES)).select("deck_id", "ref", F.coalesce("value", F.lit(-1)).alias("value"))


#: Every image at each of twelve settings of three encoders, some of which serve nine in ten.
SERVED = """SELECT image, CASE f WHEN 0 THEN 'canvas q' WHEN 1 THEN 'jpegli d' ELSE 'mozjpeg q' END AS family, CAST(s AS DOUBLE) AS setting,
    CAST(50 + CASE WHEN f = 1 THEN 13 - s ELSE s END * 1.5 + image * 7 % 11 * 0.5 - f AS DOUBLE) AS score
    FROM (SELECT DISTINCT p_partkey % 40 AS image FROM {part}) p CROSS JOIN (SELECT 0 AS f UNION ALL SELECT 1 UNION ALL SELECT 2) g
    CROSS JOIN (SELECT 1 AS s UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7 UNION ALL SELECT 8 UNION ALL SELECT 9 UNION ALL SELECT 10 UNION ALL SELECT 11 UNION ALL SELECT 12) h"""


@query(f"""WITH p AS (SELECT image, family, setting, max(score) AS score FROM ({SERVED}) x GROUP BY 1, 2, 3), t AS (SELECT DISTINCT image, 60.0::DOUBLE AS target FROM p), m AS (SELECT family, setting, sum((score >= target)::INT) AS ok, count(*) AS have, avg(score - target) AS mean, min(score - target) AS worst FROM p JOIN t USING (image) GROUP BY 1, 2),
    o AS (SELECT *, CASE WHEN family LIKE '% d' THEN -setting ELSE setting END AS o, (SELECT count(*) FROM t) AS n FROM m) SELECT family, coalesce(abs(min(CASE WHEN ok >= 0.9 * n THEN o END)), -1) AS fixed, coalesce(abs(min(CASE WHEN have = n AND mean >= 0 AND worst >= -3 THEN o END)), -1) AS even FROM o GROUP BY 1""")
def a16_a17_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = base(spark, sf_dir, SERVED).groupBy("image", "family", "setting").agg(F.max("score").alias("score"))
    out = evaluation.settings_that_serve(p, p.select("image").distinct().withColumn("target", F.lit(60.0)), ["image"])
    return out.select("family", F.coalesce("fixed", F.lit(-1.0)).alias("fixed"), F.coalesce("even", F.lit(-1.0)).alias("even"))


SERVICES = "SELECT p_partkey AS id, p_size AS rank, p_partkey % 2 AS a, p_partkey % 3 AS b, p_partkey % 5 AS c FROM {part}"


@query(f"SELECT id, rank, hits, boost, CAST(row_number() OVER (ORDER BY hits DESC, boost DESC, rank, id) AS INT) AS place FROM (SELECT id, rank, (a = 0)::INT + (b = 0)::INT AS hits, (c = 0)::INT AS boost FROM ({SERVICES}) s) x")
def t2_rank_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = base(spark, sf_dir, SERVICES).withColumn("picks", F.array_compact(F.array(*(F.when(F.col(c) == 0, c) for c in "abc"))))
    return evaluation.rank_services(s, ["a", "b"], ["c"])


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(sqrt((s + sqrt(greatest(0, s * s - 4 * det * det))) / 2), 6) AS scale FROM (SELECT *, a * a + b * b + c * c + d * d AS s, a * d - b * c AS det FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS a, l_discount AS b, l_tax AS c, l_quantity / 2 AS d FROM {lineitem}) m) x")
def f14_matrix_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = base(spark, sf_dir, "SELECT l_orderkey, l_linenumber, l_partkey, struct(l_quantity AS a, l_discount AS b, l_tax AS c, l_quantity / 2 AS d, 0D AS e, 0D AS f) AS m FROM {lineitem}")
    return l.select("l_orderkey", "l_linenumber", "l_partkey", F.round(scalars.matrix_scale(F.col("m")), 6).alias("scale"))


@query("SELECT event_id, (event_id % 90 + 1) || '.1 ' || (event_id % 70 + 1) || '.2 m S' AS path FROM {events}")
def o3_round_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = base(spark, sf_dir, "SELECT event_id, CAST((event_id % 90 + 1) || '.1000 ' || (event_id % 70 + 1) || '.2000 m S' AS BINARY) AS content FROM {events}")
    return e.select("event_id", content.round_paths_column(F.col("content"), 1.0).cast("string").alias("path"))


@query()
def i1_clarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = base(spark, sf_dir, "SELECT event_id, transform(sequence(0, 255), i -> CAST((i * 37 + event_id * 11) % 256 AS INT)) AS a FROM {events}")
    raw = lambda f: F.unhex(F.array_join(F.transform("a", lambda x: F.lpad(F.hex(f(x)), 2, "0")), ""))
    return e.select("event_id", F.round(pixels.clarity_column(raw(lambda x: x), raw(lambda x: (F.floor(x / 16) * 16).cast("int")), 16), 6).alias("clarity"))


@query("SELECT l_suppkey % 40 AS deck_id, CAST(l_partkey AS VARCHAR) || ' 0 R' AS src, '/XObject' AS \"key\", CAST(l_partkey + l_linenumber AS VARCHAR) || ' 0 R' AS dst FROM {lineitem} WHERE l_partkey IS NOT NULL GROUP BY 1, 2, 3, 4")
def s2_object_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base(spark, sf_dir, "SELECT l_suppkey % 40 AS deck_id, l_partkey, collect_set(concat('\"', l_partkey + l_linenumber, ' 0 R\"')) AS refs FROM {lineitem} WHERE l_partkey IS NOT NULL GROUP BY 1, 2")
    entry = F.concat(F.lit('"obj:'), F.col("l_partkey").cast("string"), F.lit(' 0 R": {"value": {"/Type": "/Page", "/XObject": ['), F.array_join("refs", ","), F.lit("]}}"))
    docs = rows.groupBy("deck_id").agg(F.concat(F.lit('{"qpdf": [{}, {'), F.array_join(F.collect_list(entry), ","), F.lit("}]}")).alias("json"))
    return objects.references(objects.pdf_objects(docs))


@query(f"SELECT deck_id, count(*) = count(CASE WHEN page <> 7 THEN 1 END) AS same_count, bool_and(page <> 7 AND page <> 6) AS same_sizes FROM ({PAGES}) p WHERE deck_id IS NOT NULL GROUP BY 1")
def p11_verify_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = base(spark, sf_dir, PAGES).select("deck_id", "page", F.col("page_width").cast("double").alias("width"), F.col("page_height").cast("double").alias("height"))
    after = before.where("page <> 7").withColumn("width", F.col("width") + F.when(F.col("page") == 6, 0.75).otherwise(0.25))
    return measures.verify_pages(before, after)


@query("""SELECT event_type, round((m + w) / 2, 9) AS clarity FROM (SELECT event_type, sum(value * wt) / sum(wt) AS m, sum(CASE WHEN run < al * 0.05::DOUBLE THEN value * wt END) / sum(CASE WHEN run < al * 0.05::DOUBLE THEN wt END) AS w FROM
    (SELECT *, coalesce(sum(wt) OVER (PARTITION BY event_type ORDER BY value, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run, sum(wt) OVER (PARTITION BY event_type) AS al FROM (SELECT event_type, event_id, value, CAST(event_id % 17 + 1 AS DOUBLE) AS wt FROM {events} WHERE value IS NOT NULL) e) x GROUP BY 1) y""")
def a12_weighted_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir, "SELECT event_type, event_id AS n, value AS score, CAST(event_id % 17 + 1 AS DOUBLE) AS weight FROM {events} WHERE value IS NOT NULL")
    return measures.weighted_worst(b, ["event_type"]).withColumn("clarity", F.round("clarity", 9))


@query("SELECT deck_id, ref, after AS bytes FROM (SELECT deck_id, ref, bytes - bytes % 50000 AS after, sum(bytes % 50000) OVER (PARTITION BY deck_id) AS saved, bytes FROM ({images}) i) s WHERE after < bytes AND saved >= 65536")
def p20_keep_shorter(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = base(spark, sf_dir, IMAGES)
    return measures.keep_shorter(i.select("deck_id", "ref", F.col("bytes").alias("before"), (F.col("bytes") - F.col("bytes") % 50000).alias("after")))


@query("SELECT deck_id, min(bytes) AS bytes, arg_min(p, (bytes, ref)) AS predicted, coalesce(min(CASE WHEN NOT p THEN bytes END), -1) AS measured FROM (SELECT *, ref % 2 = 0 AS p FROM ({images}) i WHERE bytes > 0) a GROUP BY 1")
def a10_lightest(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = base(spark, sf_dir, IMAGES).select("deck_id", F.col("ref").alias("seq"), "bytes", (F.col("ref") % 2 == 0).alias("predicted"))
    return measures.lightest(i).withColumn("measured", F.coalesce("measured", F.lit(-1)))


@query("""WITH RECURSIVE e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id, value) AS k FROM {events} WHERE value IS NOT NULL),
    w AS (SELECT user_id, k, value::DOUBLE AS speed FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.k, w.speed * 0.7::DOUBLE + e.value * 0.3::DOUBLE FROM w JOIN e ON e.user_id IS NOT DISTINCT FROM w.user_id AND e.k = w.k + 1)
    SELECT user_id, round(arg_max(speed, k), 6) AS speed FROM w GROUP BY 1""")
def a21_running_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = base(spark, sf_dir, "SELECT user_id, event_id, value FROM {events} WHERE value IS NOT NULL")
    return measures.running_speed(e, ["user_id"], "event_id", "value").withColumn("speed", F.round("speed", 6))
