"""More queries over the driver's tables: predicates, look-ups, set operations and scalar functions. Register beside the catalogue's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirefold.functions import containers, scalars, wording
from quirefold.operators import drivers, evaluation, flatten, inventory, ladder, measures, placing, split
from quirefold.plans.catalogue import BUDGETS, HULL, IMAGES, PAGES, PLACED, PLANS, POINTS, PREDICTED, SIZES, TOTAL, VERSIONS, base, fixed_sql, plans_of, query, totals_of, versions_of
from quirefold.streaming import progress

EVENTS = "SELECT event_id, user_id, event_type, value, CAST(floor(abs(value) * 997) AS BIGINT) AS n FROM {events} WHERE value IS NOT NULL"


@query(f"""SELECT event_id, CASE WHEN n < 1000 THEN greatest(1, n) || ' ms' ELSE {fixed_sql("n / 1000.0::DOUBLE", 1)} || ' s' END AS duration,
    CASE WHEN n < 1000 THEN n || chr(160) || 'B' WHEN n < 1000000 THEN greatest(1, floor(n / 1000.0::DOUBLE + 0.5)::BIGINT) || chr(160) || 'KB'
        WHEN n >= 100000000 THEN floor(n / 1000000.0::DOUBLE + 0.5)::BIGINT || chr(160) || 'MB' ELSE regexp_replace({fixed_sql("n / 1000000.0::DOUBLE", 1)}, '\\.0$', '') || chr(160) || 'MB' END AS size
    FROM ({SIZES}) e""")
def f2_f3_duration_and_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = base(spark, sf_dir, SIZES)
    return e.select("event_id", scalars.format_duration(F.col("n")).alias("duration"), scalars.format_size(F.col("n")).alias("size"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'my deck' ELSE p_name || CASE WHEN p_partkey % 3 = 1 THEN '' ELSE '.pdf.x' END END AS deck, CASE WHEN p_partkey % 2 = 0 THEN p_partkey END AS ref,
    replace(p_name, ' ', '#') || chr(CAST(33 + p_partkey % 90 AS INT)) AS shown, p_name || chr(CAST(161 + p_partkey % 90 AS INT)) AS plain FROM {part}""")
def f6_f12_names_and_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names with and without an ending, references and what is none, names whose signs are all escaped, in both cases, and Latin-1 text."""
    p = base(spark, sf_dir, "SELECT p_partkey, p_name FROM {part}")
    name, k = F.col("p_name"), F.col("p_partkey")
    file = F.when(k % 3 == 0, " .PDF").when(k % 3 == 1, F.concat(name, F.lit(" .Pdf"))).otherwise(F.concat(name, F.lit(".pdf.x")))
    sign = F.lower(F.lpad(F.hex(33 + k % 90), 2, "0"))
    escaped = F.concat(F.array_join(F.transform(F.split(name, " "), lambda w: F.regexp_replace(w, "e", "#65")), "#23"), F.lit("#"), F.when(k % 2 == 0, F.upper(sign)).otherwise(sign))
    latin = F.concat(F.lit("b:"), F.hex(name.cast("binary")), F.hex(161 + k % 90))
    return p.select(
        "p_partkey", scalars.deck_name(file).alias("deck"), scalars.ref_number(F.concat(k.cast("string"), F.when(k % 2 == 0, " 0 R").otherwise(" 0 obj"))).alias("ref"),
        containers.decode_name(escaped).alias("shown"), scalars.decode_pdf_string(latin).alias("plain"),
    )


@query("""SELECT DISTINCT l_orderkey, l_linenumber, CASE WHEN w > 0 AND h > 0 THEN w ELSE 500 END AS width, CASE WHEN w > 0 AND h > 0 THEN h ELSE 700 END AS height
    FROM (SELECT DISTINCT l_orderkey, l_linenumber, least(500, greatest(x, n)) - least(x, n) AS w, 700 - y AS h FROM (SELECT l_orderkey, l_linenumber, l_partkey::DOUBLE AS x, l_linenumber::DOUBLE AS n, (l_suppkey * 90 % 800)::DOUBLE AS y FROM {lineitem}) a) b""")
def f17_page_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = base(spark, sf_dir, "SELECT DISTINCT l_orderkey, l_linenumber, CAST(l_partkey AS DOUBLE) AS x, CAST(l_suppkey * 90 % 800 AS DOUBLE) AS y, CAST(l_linenumber AS DOUBLE) AS n FROM {lineitem}")
    zero = F.lit(0.0)
    box = containers.page_box(F.array(F.lit(500.0), F.lit(700.0), zero, zero), F.array(F.col("n"), F.col("y"), F.col("x"), F.lit(900.0)))
    return p.select("l_orderkey", "l_linenumber", box.alias("b")).select("l_orderkey", "l_linenumber", "b.width", "b.height").distinct()


@query("SELECT event_id, round(0.1::DOUBLE + (100 - event_id % 101)::DOUBLE * 0.09::DOUBLE, 6) AS distance, array_to_string(list_transform([{cells}], lambda v: CAST(least(255, greatest(1, floor((v * CASE WHEN q < 50 THEN 5000.0::DOUBLE / q ELSE 200.0::DOUBLE - q * 2 END + 50) / 100))) AS INT)), ',') AS cells FROM (SELECT event_id, greatest(1, event_id % 101) AS q FROM {events}) e".replace("{cells}", ", ".join(map(str, containers.LUMINANCE))))
def f22_f23_distance_and_quantisers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = base(spark, sf_dir, "SELECT event_id, CAST(event_id % 101 AS DOUBLE) / 100 AS q FROM {events}")
    return e.select("event_id", F.round(containers.distance_of(F.col("q")), 6).alias("distance"), F.array_join(F.transform(containers.gray_quantisers(F.col("q")), lambda v: v.cast("string")), ",").alias("cells"))


@query("SELECT page_id, 8 + page_id % 60000 AS width, 16 + page_id % 900 AS height, true AS lighter, true AS alike FROM {pages}")
def f24_f25_jpeg_header_and_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = base(spark, sf_dir, "SELECT page_id FROM {pages}")
    short = lambda x: F.lpad(F.hex(x), 4, "0")
    frame = F.concat(F.lit("FFC0000B08"), short(16 + F.col("page_id") % 900), short(8 + F.col("page_id") % 60000), F.lit("01011100"))
    file = lambda meta: F.unhex(F.concat(F.lit("FFD8"), F.lit(meta), frame, F.lit("FFDA0003010011FFD9")))
    full, bare = file("FFE1000645786966FFE200040000"), file("")
    out = p.select("page_id", containers.jpeg_info(full).alias("i"), full.alias("full"), bare.alias("bare")).withColumn("less", containers.stripped(F.col("full")))
    return out.select("page_id", F.col("i.width").cast("long").alias("width"), F.col("i.height").cast("long").alias("height"), (F.length("less") < F.length("full")).alias("lighter"), (F.col("less") == F.col("bare")).alias("alike"))


@query("SELECT page_id, sha1(coalesce(html, '')) AS digest, true AS refused FROM {pages}")
def s4_f26_compressed_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = base(spark, sf_dir, "SELECT page_id, CAST(coalesce(html, '') AS BINARY) AS content FROM {pages}")
    return p.select("page_id", F.sha1(containers.inflated(containers.deflated(F.col("content")))).alias("digest"), containers.inflated(F.encode(F.lit("plain"), "UTF-8")).isNull().alias("refused"))


@query("""SELECT deck_id, ref, '/FlateDecode' AS filter, CAST(width AS VARCHAR) AS width, '8' AS bits, space, 5 AS entries FROM ({images}) i""")
def s9_rewritten_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = base(spark, sf_dir, IMAGES)
    entries = F.create_map(*(x for k, v in (("/Filter", "filter"), ("/Width", "height"), ("/BitsPerComponent", "bits"), ("/ColorSpace", "space"), ("/Length", "bytes")) for x in (F.lit(k), F.col(v).cast("string"))))
    d = i.select("deck_id", "ref", containers.rewritten_dict(entries, F.col("width"), F.col("height"), F.lit(False)).alias("d"))
    return d.select("deck_id", "ref", *(F.col("d")[k].alias(n) for k, n in (("/Filter", "filter"), ("/Width", "width"), ("/BitsPerComponent", "bits"), ("/ColorSpace", "space"))), F.size("d").alias("entries"))


@query(f"SELECT event_id, CASE WHEN value % 2 < 1 THEN 'enc d' ELSE 'enc d fast' END AS family, CAST(floor(abs(value)) AS DOUBLE) AS setting FROM ({EVENTS}) e")
def f29_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = base(spark, sf_dir, EVENTS)
    label = F.concat(F.lit("enc d"), F.floor(F.abs("value")).cast("string"), F.when(F.col("value") % 2 < 1, "").otherwise(" fast"))
    return e.select("event_id", evaluation.family(label).alias("family"), evaluation.setting(label).alias("setting"))


@query(r"SELECT page_id, regexp_replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '\*\*(.+?)\*\*', '<strong>\1</strong>', 'g') AS shown FROM (SELECT page_id, '**' || url || '** ' || html AS html FROM {pages} WHERE html IS NOT NULL AND url IS NOT NULL) p".replace('\\"', '"'))
def f30_inline_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = base(spark, sf_dir, "SELECT page_id, url, html FROM {pages} WHERE html IS NOT NULL AND url IS NOT NULL")
    return p.select("page_id", wording.inline(F.concat(F.lit("**"), F.col("url"), F.lit("** "), F.col("html"))).alias("shown"))


@query("""SELECT event_id, CASE WHEN k = 11 OR k = 18 OR k // 10 = 8 OR k = 8 THEN 'an ' ELSE 'a ' END || k || chr(160) || 'MB limit' AS mailbox, k || CASE WHEN k = 1 THEN ' photo' ELSE ' photos' END AS photos,
    CASE k WHEN 0 THEN 'none' WHEN 1 THEN 'one' WHEN 2 THEN 'two' WHEN 3 THEN 'three' WHEN 4 THEN 'four' WHEN 5 THEN 'five' WHEN 6 THEN 'six' ELSE CAST(k AS VARCHAR) END AS word,
    CASE WHEN k % 3 = 0 THEN 'a' WHEN k % 3 = 1 THEN 'a and b' ELSE 'a, b and c' END AS items FROM (SELECT event_id, event_id % 90 + 1 AS k FROM {events}) e""")
def f31_wording(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = base(spark, sf_dir, "SELECT event_id, event_id % 90 + 1 AS k FROM {events}")
    k = F.col("k")
    items = F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 1, (k % 3 + 1).cast("int"))
    return e.select("event_id", wording.mailbox_name(F.lit("custom"), k * 1_000_000).alias("mailbox"), wording.plural(k, "photo", "photos").alias("photos"), wording.number_word(k).alias("word"), wording.listed(items).alias("items"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'password' WHEN 1 THEN 'page-too-large' WHEN 2 THEN 'timeout' WHEN 3 THEN 'unknown' ELSE 'read' END AS kind,
    CASE WHEN event_id % 3 = 0 THEN 'photos' WHEN event_id % 3 = 1 THEN 'verify' ELSE 'any' END AS comment,
    CASE WHEN n >= 600000 THEN 5 WHEN n >= 300000 THEN 4 WHEN n >= 150000 THEN 3 WHEN n >= 75000 THEN 2 WHEN n >= 25000 THEN 1 ELSE 0 END AS wait,
    CASE WHEN n <= 200000 THEN 'fits' WHEN event_id % 2 = 0 AND n < 280000 THEN 'looks-like-it-fits' ELSE 'over' END AS weighed,
    CASE WHEN event_id % 7 = 0 THEN 'too-big' ELSE 'engine' END AS error FROM (""" + EVENTS + ") e")
def f34_p14_p17_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = base(spark, sf_dir, EVENTS)
    n, i = F.col("n"), F.col("event_id")
    pick = lambda words, m: F.get(F.array(*map(F.lit, words)), (i % m).cast("int"))
    message = pick(["Needs a Password", "Page 12 is too large", "It took too long", "Odd", "It could not be read"], 5)
    return e.select(
        "event_id", wording.error_kind(message, F.lit("odd")).alias("kind"), wording.commentary_key(pick(["sharpen", "verify", "inspect"], 3)).alias("comment"), wording.wait_step(n).alias("wait"),
        wording.weigh_in(n, F.lit(280_000), F.lit(200_000), i % 2 == 1).alias("weighed"), scalars.error_code(F.when(i % 7 == 0, "RangeError: Array buffer").otherwise("x")).alias("error"),
    )


@query("""SELECT deck_id, ref, key_mask AND stencil AS restricted, CASE WHEN is_mask THEN width < height ELSE width <= height * 0.9::DOUBLE END AS accepted, width = height AS same,
    CASE WHEN stencil THEN 'unreadable' WHEN width <= height THEN 'original' ELSE 'rewrite' END AS decision FROM ({images}) i""")
def p4_p7_p10_p21_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = base(spark, sf_dir, IMAGES)
    target = lambda w: F.struct(F.col(w).alias("width"), F.lit(None).cast("int").alias("height"), F.lit("jpeg").alias("format"), F.lit(0.8).alias("quality"))
    return i.select(
        "deck_id", "ref", inventory.restricted(F.col("key_mask"), F.create_map(F.lit("print"), ~F.col("stencil"), F.lit("copy"), F.lit(True))).alias("restricted"),
        inventory.accept_output(F.col("is_mask"), F.col("height"), F.col("width")).alias("accepted"), ladder.same_target(target("width"), target("height")).alias("same"),
        measures.fit_decision(F.col("width"), F.col("height"), ~F.col("stencil")).alias("decision"),
    )


OUTPUTS = "SELECT deck_id, ref, CAST(ref % 6 AS INT) AS rung, CAST(floor(bytes * 0.4) AS BIGINT) AS bytes FROM ({images}) i WHERE ref % 3 <> 0"


@query(f"SELECT p.deck_id, p.photo, p.rung, round(sum(p.bytes * pow(target_width * target_height / (width * height), 0.85)), 3) AS cal_base, CAST(sum(o.bytes) AS BIGINT) AS cal_after FROM {PLANS} p JOIN ({OUTPUTS}) o USING (deck_id, ref, rung) WHERE format IS NOT NULL GROUP BY 1, 2, 3")
def a3_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ladder.calibrate(plans_of(spark, sf_dir), base(spark, sf_dir, OUTPUTS)).withColumn("cal_base", F.round("cal_base", 3))


@query(f"SELECT p.deck_id, p.rung, CAST(sum(coalesce(o.bytes, p.bytes)) AS BIGINT) AS bytes FROM {PLANS} p LEFT JOIN ({OUTPUTS}) o USING (deck_id, ref, rung) GROUP BY 1, 2")
def j9_chosen_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placing.chosen_bytes(plans_of(spark, sf_dir), base(spark, sf_dir, OUTPUTS))


USES = "SELECT l_suppkey AS deck_id, l_partkey % 50 AS ref, CASE WHEN l_orderkey % 3 = 0 THEN 595 ELSE 960 END AS page_width, 540 AS page_height, CAST(l_linenumber AS DOUBLE) / 4 AS scale FROM {lineitem}"


@query(f"SELECT deck_id, ref, round(max({ladder.RUNGS[0][1]}::DOUBLE / greatest(page_width, page_height) * scale), 6) AS pixels_per_unit FROM ({USES}) u GROUP BY 1, 2")
def a9_widest_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placing.widest(base(spark, sf_dir, USES)).withColumn("pixels_per_unit", F.round("pixels_per_unit", 6))


UNKNOWN = "SELECT deck_id, ref FROM ({images}) u WHERE stencil"
HIDDEN = "SELECT DISTINCT deck_id, CAST(ref AS BIGINT) AS page FROM ({images}) h WHERE key_mask OR has_matte"
MASKS = "SELECT deck_id, ref, CASE WHEN ref > 1 THEN ref - 1 ELSE ref + 1 END AS parent FROM ({images}) m WHERE is_mask AND ref % 2 = 0"


@query(f"""WITH k0 AS (SELECT * FROM ({PLACED}) p WHERE NOT EXISTS (SELECT 1 FROM ({UNKNOWN}) u WHERE u.deck_id = p.deck_id AND u.ref = p.ref)),
    reach AS (SELECT deck_id, ref, unnest([ref, ref + 1]) AS page FROM ({{images}}) i),
    gone AS (SELECT DISTINCT r.deck_id, r.ref FROM reach r JOIN ({HIDDEN}) h ON h.deck_id = r.deck_id AND h.page = r.page WHERE NOT EXISTS (SELECT 1 FROM k0 WHERE k0.deck_id = r.deck_id AND k0.ref = r.ref AND k0.page = r.page)),
    k1 AS (SELECT * FROM k0 WHERE (deck_id, ref) NOT IN (SELECT deck_id, ref FROM gone)), m AS ({MASKS}),
    bad AS (SELECT deck_id, ref FROM m WHERE NOT EXISTS (SELECT 1 FROM k1 WHERE k1.deck_id = m.deck_id AND k1.ref = m.parent) OR EXISTS (SELECT 1 FROM ({UNKNOWN}) u WHERE u.deck_id = m.deck_id AND u.ref = m.ref))
    SELECT deck_id, ref, page, width::DOUBLE AS width, height::DOUBLE AS height FROM k1 WHERE (deck_id, ref) NOT IN (SELECT deck_id, ref FROM bad)
    UNION ALL SELECT m.deck_id, m.ref, k1.page, k1.width::DOUBLE, k1.height::DOUBLE FROM m JOIN k1 ON k1.deck_id = m.deck_id AND k1.ref = m.parent WHERE (m.deck_id, m.ref) NOT IN (SELECT deck_id, ref FROM bad)""")
def j6_j8_settled_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = base(spark, sf_dir, IMAGES).select("deck_id", "ref", F.array(F.col("ref"), F.col("ref") + 1).alias("reach"))
    placed = base(spark, sf_dir, PLACED).withColumns({c: F.col(c).cast("double") for c in ("width", "height")})
    return placing.settled_placements(placed, images, base(spark, sf_dir, UNKNOWN), base(spark, sf_dir, HIDDEN), base(spark, sf_dir, MASKS))


PARTS = "SELECT l_orderkey AS deck_id, 1 AS part, 1 AS first, 3 AS last FROM {lineitem} GROUP BY l_orderkey UNION ALL SELECT l_orderkey, 2, 4, 7 FROM {lineitem} GROUP BY l_orderkey"


@query(f"SELECT p.deck_id, p.part, CAST(sum(i.bytes) AS BIGINT) AS bytes FROM ({PARTS}) p JOIN ({{images}}) i ON i.deck_id = p.deck_id AND i.ref BETWEEN p.first AND p.last GROUP BY 1, 2")
def j10_range_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = base(spark, sf_dir, PARTS).select("deck_id", "part", F.explode(F.sequence(F.col("first").cast("long"), F.col("last").cast("long"))).alias("ref"))
    return pages.join(base(spark, sf_dir, IMAGES).select("deck_id", "ref", "bytes"), ["deck_id", "ref"]).groupBy("deck_id", "part").agg(F.sum("bytes").alias("bytes"))


@query(f"SELECT a.event_id, b.event_id AS current FROM ({EVENTS}) a JOIN (SELECT user_id, max(event_id) AS event_id FROM ({EVENTS}) x GROUP BY 1) b ON a.user_id = b.user_id WHERE a.event_id % 4 = b.event_id % 4")
def j14_stale_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = base(spark, sf_dir, EVENTS)
    current = e.groupBy("user_id").agg(F.max("event_id").alias("current"))
    return e.join(current, "user_id").where(F.col("event_id") % 4 == F.col("current") % 4).select("event_id", "current")


REFERENCES = "SELECT DISTINCT l_suppkey % 20 AS deck_id, l_partkey % 200 AS ref, CASE WHEN l_partkey % 200 % 8 > 0 THEN l_partkey % 200 - 1 END AS parent, CASE WHEN l_partkey % 200 % 8 = 0 THEN l_partkey % 200 * 10 END AS value FROM {lineitem}"


@query(f"""WITH RECURSIVE n AS ({REFERENCES}), w AS (SELECT deck_id, ref, parent, value FROM n UNION ALL SELECT w.deck_id, w.ref, n.parent, n.value FROM w JOIN n ON n.deck_id = w.deck_id AND n.ref = w.parent WHERE w.value IS NULL)
    SELECT deck_id, ref, max(value) AS value FROM w GROUP BY 1, 2""")
def j15_resolved_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.inherited(base(spark, sf_dir, REFERENCES))


@query("SELECT deck_id, min(ref) AS first, CAST(min(bytes) AS BIGINT) AS least, CAST(max(bytes) AS BIGINT) AS most, max_by(ref, bytes * 100 - ref) AS heaviest, coalesce(avg(CASE WHEN is_mask THEN bytes END), 2000.0) AS pace FROM ({images}) i GROUP BY 1")
def a2_a14_a22_t4_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = base(spark, sf_dir, IMAGES)
    return i.groupBy("deck_id").agg(
        F.min("ref").alias("first"), F.min("bytes").alias("least"), F.max("bytes").alias("most"), F.max_by("ref", F.struct("bytes", -F.col("ref"))).alias("heaviest"),
        F.coalesce(F.avg(F.when(F.col("is_mask"), F.col("bytes"))), F.lit(2000.0)).alias("pace"),
    )


@query("""SELECT deck_id, coalesce(min(CASE WHEN run >= 0.5 * total THEN n END), max(n)) AS enough FROM (
    SELECT deck_id, row_number() OVER o AS n, sum(bytes) OVER o AS run, sum(bytes) OVER (PARTITION BY deck_id) AS total FROM ({images}) i WINDOW o AS (PARTITION BY deck_id ORDER BY ref ROWS UNBOUNDED PRECEDING)) x GROUP BY 1""")
def a19_count_for_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = base(spark, sf_dir, IMAGES).groupBy("deck_id").agg(F.sort_array(F.collect_list(F.struct("ref", "bytes"))).alias("p"), F.sum("bytes").alias("total"))
    return per.select("deck_id", placing.count_for_share(F.transform("p", lambda x: x["bytes"].cast("double")), F.col("total") * 0.5).alias("enough"))


ATTEMPTS = "SELECT l_orderkey AS deck_id, l_linenumber AS seq, max(l_quantity) AS score, CAST(max(l_extendedprice) AS BIGINT) AS bytes, 30.0 AS target FROM {lineitem} GROUP BY 1, 2"


@query(f"SELECT deck_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY deck_id ORDER BY score < target, CASE WHEN score >= target THEN bytes ELSE -score END, seq) AS r FROM ({ATTEMPTS}) a) x WHERE r = 1")
def t8_best_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    # SQL's cast rounds to the nearest whole number, the even one of two as near; Spark's own cuts.
    own = ATTEMPTS.replace("GROUP BY 1, 2", "GROUP BY l_orderkey, l_linenumber").replace("CAST(max(l_extendedprice) AS BIGINT)", "CAST(rint(max(l_extendedprice)) AS BIGINT)")
    return placing.best_attempt(base(spark, sf_dir, own), ["deck_id"])


@query("SELECT event_id, CASE WHEN k <= 100 THEN 100 WHEN k <= 300 THEN 300 WHEN k <= 700 THEN 700 ELSE 900 END AS width FROM (SELECT event_id, event_id % 1000 AS k FROM {events}) e")
def t5_smallest_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = base(spark, sf_dir, "SELECT event_id, event_id % 1000 AS k FROM {events}")
    surfaces = F.array(*(F.struct(F.lit(w).alias("width"), F.lit(w).alias("height")) for w in (900, 300, 700, 100)))
    return e.select("event_id", placing.smallest_surface(surfaces, F.col("k"), F.col("k"))["width"].alias("width"))


@query(f"SELECT i.deck_id, i.ref, CAST(row_number() OVER (PARTITION BY i.deck_id ORDER BY coalesce(f.page, i.ref), i.ref) AS INT) AS place FROM ({{images}}) i LEFT JOIN (SELECT deck_id, ref, min(page) AS page FROM ({PLACED}) p GROUP BY 1, 2) f USING (deck_id, ref)")
def t1_plan_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = base(spark, sf_dir, PLACED).groupBy("deck_id", "ref").agg(F.min("page").alias("page"))
    i = base(spark, sf_dir, IMAGES).select("deck_id", "ref").join(first, ["deck_id", "ref"], "left")
    return i.select("deck_id", "ref", F.row_number().over(Window.partitionBy("deck_id").orderBy(F.coalesce("page", "ref"), "ref")).alias("place"))


@query(f"SELECT deck_id, ref FROM (SELECT DISTINCT deck_id, ref FROM ({{images}}) a EXCEPT SELECT deck_id, ref FROM ({PLACED}) b) x")
def d1_d4_d6_not_yet_tried(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir, IMAGES).select("deck_id", "ref").distinct().join(base(spark, sf_dir, PLACED), ["deck_id", "ref"], "left_anti")


@query("""SELECT o_orderkey AS deck_id, array_to_string(list_sort(list_distinct([k % 6, (k + 1) % 6, 5])), ',') AS encode, array_to_string(list_sort(list_distinct(list_concat(list_filter([k % 6, (k + 1) % 6], lambda x: x >= 2), [5]))), ',') AS tried
    FROM (SELECT o_orderkey, o_orderkey % 11 AS k FROM {orders}) o""")
def d5_d7_rung_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = base(spark, sf_dir, "SELECT o_orderkey AS deck_id, o_orderkey % 11 AS k FROM {orders}")
    chosen, floor = F.array(F.col("k") % 6, (F.col("k") + 1) % 6), F.array(F.lit(5).cast("long"))
    text = lambda x: F.array_join(F.transform(F.array_sort(x), lambda v: v.cast("string")), ",")
    plausible = F.sequence(F.lit(2).cast("long"), F.lit(5).cast("long"))
    return o.select("deck_id", text(F.array_union(chosen, floor)).alias("encode"), text(F.array_union(F.array_intersect(chosen, plausible), floor)).alias("tried"))


@query("SELECT o_orderkey AS deck_id, part, CASE part WHEN 1 THEN 1 WHEN 2 THEN k + 1 ELSE k + 4 END AS start_page, CASE part WHEN 1 THEN k WHEN 2 THEN k + 3 ELSE k + 9 END AS end_page, k > 0 AS valid FROM (SELECT o_orderkey, o_orderkey % 5 AS k, unnest([1, 2, 3]) AS part FROM {orders}) o")
def w8_p12_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = base(spark, sf_dir, "SELECT o_orderkey AS deck_id, o_orderkey % 5 AS k FROM {orders}")
    k = F.col("k")
    out = o.select("deck_id", split.valid_breaks(F.array(k, k + 3), k + 9).alias("valid"), F.explode(split.ranges(F.array(k, k + 3, k + 9))).alias("r"))
    return out.select("deck_id", "r.part", "r.start_page", "r.end_page", "valid")


@query("""SELECT event_id, round(CASE event_id % 3 WHEN 0 THEN 0.16 + 0.62 * w WHEN 1 THEN 0.78 + 0.12 * w ELSE w END, 6) AS fraction, round(1 - exp(-w * 3), 6) AS creep
    FROM (SELECT event_id, (event_id % 101)::DOUBLE / 100 AS w FROM {events}) e""")
def r1_r8_bands_and_creep(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = base(spark, sf_dir, "SELECT event_id, CAST(event_id % 101 AS DOUBLE) / 100 AS w FROM {events}")
    stage = F.get(F.array(F.lit("photos"), F.lit("verify"), F.lit("other")), (F.col("event_id") % 3).cast("int"))
    return e.select("event_id", F.round(progress.fraction(stage, F.col("w")), 6).alias("fraction"), F.round(progress.creep(F.col("w") * 3000, F.lit(1000.0)), 6).alias("creep"))


@query(f"SELECT deck_id, count(*) FILTER (WHERE resized) AS resized, count(*) FILTER (WHERE NOT resized AND format IS NOT NULL) AS resaved, count(*) FILTER (WHERE NOT resized AND format IS NULL) AS untouched FROM {PLANS} p WHERE rung = 2 GROUP BY 1")
def p18_image_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    resized, saved = F.col("resized"), F.col("format").isNotNull()
    return plans_of(spark, sf_dir).where("rung = 2").groupBy("deck_id").agg(F.count_if(resized).alias("resized"), F.count_if(~resized & saved).alias("resaved"), F.count_if(~resized & ~saved).alias("untouched"))


@query(f"SELECT deck_id, page, page_width::DOUBLE AS page_width FROM (SELECT deck_id, page, page_width FROM ({PAGES}) p) x")
def s13_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A round trip through JSON lines, blank lines among them skipped."""
    rows = base(spark, sf_dir, PAGES)
    lines = rows.select(F.to_json(F.struct("deck_id", "page", F.col("page_width").cast("double").alias("page_width"))).alias("line")).withColumn("line", F.explode(F.array("line", F.lit(""))))
    kept = lines.where(F.trim("line") != "")
    return kept.select(F.from_json("line", "deck_id long, page long, page_width double").alias("j")).select("j.*")


@query(f"SELECT t.deck_id, rung, round(total, 3) AS total FROM (SELECT deck_id, rung, {TOTAL} AS total FROM {PREDICTED} p GROUP BY 1, 2) t JOIN ({BUDGETS}) b USING (deck_id) WHERE rung = {len(ladder.RUNGS) - 1} OR total <= budget * {ladder.PLAUSIBLE}")
def p8_plausible_rungs(spark: SparkSession, sf_dir: str) -> DataFrame:
    budgets = base(spark, sf_dir, BUDGETS).withColumn("budget", F.col("budget").cast("double"))
    return ladder.plausible_rungs(totals_of(spark, sf_dir), budgets).select("deck_id", "rung", F.round("total", 3).alias("total"))


@query(f"SELECT family, round(coalesce(sum(b), 0) / (SELECT sum(CASE WHEN image % 5 > 0 THEN bytes END) FROM ({POINTS}) y WHERE family = 'canvas q')::DOUBLE, 6) AS ratio, count(*) - count(b) AS missing FROM (SELECT family, CASE WHEN image % 5 > 0 THEN bytes END AS b FROM ({POINTS}) x) z GROUP BY 1")
def a18_relative_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = base(spark, sf_dir, POINTS).withColumn("bytes", F.when(F.col("image") % 5 > 0, F.col("bytes")))
    return evaluation.relative_totals(p, "canvas q").withColumn("ratio", F.round("ratio", 6))


@query(f"SELECT image, family, setting, score::DOUBLE AS score FROM ({POINTS}) p WHERE setting = 10 + image % 30")
def j12_setting_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = base(spark, sf_dir, POINTS).withColumn("score", F.col("score").cast("double"))
    wanted = p.select("image", "family").distinct().withColumn("wanted", F.col("image") % 30 + 10.0000004)
    return evaluation.setting_near(p, wanted.withColumn("wanted", F.col("wanted").cast("double")), ["image", "family"]).select("image", "family", "setting", "score")


@query(f"""{HULL} SELECT x.deck_id, x.page, x.version, CASE WHEN h.version IS NULL THEN 0 ELSE x.bytes END AS bytes, x.clarity::DOUBLE AS clarity, h.version IS NOT NULL AS usable
    FROM ({VERSIONS}) x LEFT JOIN h USING (deck_id, page, version)""")
def o13_keep_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten.keep_usable(versions_of(spark, sf_dir))


#: Images with the pages that name them and those that lead to them, some with neither.
PAGED = "SELECT deck_id, ref, CASE WHEN ref % 3 = 0 THEN ref + 1 END AS own, CASE WHEN ref % 2 = 0 THEN ref + 2 END AS far FROM ({images}) i"


@query(f"""SELECT deck_id, ref, CAST(first_page AS INT) AS first_page, CAST(row_number() OVER (PARTITION BY deck_id ORDER BY first_page, ref) AS INT) AS place
    FROM (SELECT p.deck_id, p.ref, coalesce(least(d.page, coalesce(own, far)), 1) AS first_page FROM ({PAGED}) p LEFT JOIN (SELECT deck_id, ref, min(page) AS page FROM ({PLACED}) q GROUP BY 1, 2) d USING (deck_id, ref)) x""")
def a2_t1_first_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<int>")
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(F.col(c).cast("int"))).otherwise(none)
    i = base(spark, sf_dir, PAGED).select("deck_id", "ref", one("own").alias("pages"), one("far").alias("reach"))
    return ladder.first_pages(i, base(spark, sf_dir, PLACED))


@query(f"""SELECT deck_id, count(*) FILTER (WHERE resized) AS resized, count(*) FILTER (WHERE NOT resized) AS resaved, count(*) FILTER (WHERE resized IS NULL) AS untouched
    FROM (SELECT i.deck_id, i.ref, p.resized FROM ({{images}}) i LEFT JOIN {PLANS} p ON p.deck_id = i.deck_id AND p.ref = i.ref AND p.rung = i.ref % 6 AND p.format IS NOT NULL AND (i.deck_id + i.ref) % 3 > 0) x GROUP BY 1""")
def p18_chosen_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = plans_of(spark, sf_dir)
    choice = base(spark, sf_dir, "SELECT deck_id, ref, CAST(ref % 6 AS INT) AS rung FROM ({images}) i")
    return ladder.image_stats(choice, plans.where("format IS NOT NULL AND (deck_id + ref) % 3 > 0").select("deck_id", "ref", "rung", "resized"), choice)


@query(f"SELECT deck_id, count(*) AS pages, min(clarity)::DOUBLE AS clarity, max(version) AS rung FROM ({VERSIONS}) v WHERE version = (deck_id + page) % 8 GROUP BY 1")
def a14_choice_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = versions_of(spark, sf_dir).where("version = (deck_id + page) % 8").withColumn("rung", F.col("version"))
    return flatten.choice_summary(chosen).withColumn("clarity", F.col("clarity").cast("double"))


@query("SELECT deck_id, round(coalesce(avg(CASE WHEN is_mask THEN bytes END), 2000.0)::DOUBLE, 6) AS pace FROM ({images}) i GROUP BY 1")
def a22_page_pace(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = base(spark, sf_dir, IMAGES)
    return flatten.page_pace(i, i.where("is_mask").select("deck_id", F.col("bytes").alias("ms"))).withColumn("pace", F.round("pace", 6))


@query("SELECT deck_id, string_agg(ref::VARCHAR, ',' ORDER BY -(width * height), ref) AS refs FROM ({images}) i GROUP BY 1")
def t4_output_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = base(spark, sf_dir, IMAGES).groupBy("deck_id").agg(F.sort_array(F.collect_list(F.struct("ref", "width", "height"))).alias("t"))
    return per.select("deck_id", F.array_join(F.transform(ladder.largest_first(F.col("t")), lambda x: x["ref"].cast("string")), ",").alias("refs"))


@query(f"""SELECT o_orderkey AS deck_id, array_to_string(list_sort(list_distinct(list_filter([k % 6, (k + 1) % 6], lambda x: x >= 2 OR x = 5))), ',') AS rungs, family FROM (SELECT o_orderkey, o_orderkey % 11 AS k FROM {{orders}}) o
    CROSS JOIN (SELECT DISTINCT family FROM ({POINTS}) p WHERE family <> 'canvas q') f""")
def d6_d7_rungs_and_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = base(spark, sf_dir, "SELECT o_orderkey AS deck_id, CAST(o_orderkey % 11 AS INT) AS k FROM {orders}")
    rungs = ladder.worth_measuring(F.array(F.col("k") % 6, (F.col("k") + 1) % 6), F.sequence(F.lit(2), F.lit(5)), 5)
    families = evaluation.other_families(base(spark, sf_dir, POINTS), "canvas q")
    return drivers.settings_grid(o.select("deck_id", F.array_join(F.transform(rungs, lambda x: x.cast("string")), ",").alias("rungs")), families)


@query(f"SELECT deck_id, ref, rung FROM (SELECT DISTINCT deck_id, ref, CAST(ref % 3 AS INT) AS rung FROM ({{images}}) a EXCEPT SELECT deck_id, ref, 1 FROM ({PLACED}) b) x")
def d4_untried(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = base(spark, sf_dir, "SELECT deck_id, ref, CAST(ref % 3 AS INT) AS rung FROM ({images}) i")
    return ladder.untried(wanted.unionByName(wanted), base(spark, sf_dir, PLACED).withColumn("rung", F.lit(1)), ["deck_id", "ref", "rung"])
