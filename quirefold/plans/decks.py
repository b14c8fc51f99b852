"""Queries of whole decks: filling a budget, splitting, placements, closures, drivers. Register beside the catalogue's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.functions import containers, scalars
from quirefold.operators import compressing, content, drivers, inventory, ladder, split
from quirefold.plans.catalogue import BUDGETS, EVENTS, IMAGES, PAGES, PLACED, PREDICTED, SPLIT, TOTAL, USES, base, inventory_of, plans_of, query, totals_of, versions_of
from quirefold.sources import objects
from quirefold.streaming import progress

#: A rung that fits, and what the file weighs with it; every seventh deck's files come out larger than their parts.
STARTS = "SELECT deck_id, CAST(3 + deck_id % 3 AS INT) AS at, CAST(sum(bytes) * 0.45 + 5000 AS DOUBLE) AS fitted_bytes, CAST(sum(bytes) * 0.6 AS DOUBLE) AS budget, CAST(CASE WHEN deck_id % 7 = 0 THEN sum(bytes) * 0.02 ELSE 0 END AS DOUBLE) AS drift FROM ({images}) i GROUP BY deck_id"
#: Versions of rungs: some missing, some the same as the next, some lighter though sharper.
STORED = """SELECT deck_id, ref, rung, CAST(floor(bytes * (0.95 - rung * 0.12) + (deck_id + ref * 5 + rung * 3) % 11 * 300) AS BIGINT) AS bytes, CASE WHEN (ref + rung) % 5 = 0 THEN 'v' || (rung - 1) ELSE 'v' || rung END AS version
    FROM ({images}) i CROSS JOIN (SELECT 0 AS rung UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5) r WHERE (deck_id + ref * 3 + rung) % 4 > 0"""
COVER = "SELECT deck_id, ref, bytes, CAST(1 + ref % 3 AS DOUBLE) / 2 AS coverage FROM ({images}) i"


@query(f"""WITH RECURSIVE s AS ({STARTS}), v AS ({STORED}), c AS ({COVER}),
    h AS (SELECT c.deck_id, c.ref, s.at AS rung, coalesce(v.bytes, c.bytes)::DOUBLE AS bytes, v.version, coverage, 0 AS step, CAST('-infinity' AS DOUBLE) AS top, 0::DOUBLE AS extra, s.at AS "from" FROM c JOIN s USING (deck_id) LEFT JOIN v ON v.deck_id = c.deck_id AND v.ref = c.ref AND v.rung = s.at),
    m AS (SELECT * FROM h UNION ALL SELECT deck_id, ref, rung, bytes, version, coverage, step, top, extra, "from" FROM (
        SELECT m.deck_id, m.ref, v.rung, v.bytes::DOUBLE AS bytes, v.version, m.coverage, m.step + 1 AS step, greatest(m.top, (v.bytes - m.bytes) / ((m.rung - v.rung) * m.coverage)) AS top, v.bytes - m.bytes AS extra, m.rung AS "from",
            row_number() OVER (PARTITION BY m.deck_id, m.ref ORDER BY v.rung DESC) AS r FROM m JOIN v ON v.deck_id = m.deck_id AND v.ref = m.ref AND v.rung < m.rung AND v.version IS DISTINCT FROM m.version) x WHERE r = 1),
    o AS (SELECT deck_id, ref, rung, extra, row_number() OVER (PARTITION BY deck_id ORDER BY top, ref, step) AS k FROM m WHERE step > 0),
    t AS (SELECT deck_id, round, budget * 0.985::DOUBLE - CASE round WHEN 1 THEN 0 ELSE drift END AS target, fitted_bytes FROM s CROSS JOIN (VALUES (1), (2)) g(round)),
    w AS (SELECT deck_id, round, 0::BIGINT AS k, fitted_bytes AS total, []::BIGINT[] AS stuck, [-1]::BIGINT[] AS taken FROM t UNION ALL
        SELECT w.deck_id, w.round, o.k, CASE WHEN list_contains(stuck, o.ref) OR total + extra > target THEN total ELSE total + extra END, CASE WHEN list_contains(stuck, o.ref) OR total + extra <= target THEN stuck ELSE list_append(stuck, o.ref) END,
            CASE WHEN list_contains(stuck, o.ref) OR total + extra > target THEN taken ELSE list_append(taken, o.k) END FROM w JOIN o ON o.deck_id = w.deck_id AND o.k = w.k + 1 JOIN t ON t.deck_id = w.deck_id AND t.round = w.round),
    e AS (SELECT deck_id, round, arg_max(total, k) AS total, arg_max(taken, k) AS taken FROM w GROUP BY 1, 2),
    u AS (SELECT s.*, CASE WHEN len(a.taken) = 1 OR a.total + drift <= budget THEN a.taken ELSE b.taken END AS taken, CASE WHEN len(a.taken) = 1 OR a.total + drift <= budget THEN a.total ELSE b.total END AS total FROM s JOIN e a ON a.deck_id = s.deck_id AND a.round = 1 JOIN e b ON b.deck_id = s.deck_id AND b.round = 2),
    f AS (SELECT *, len(taken) > 1 AND total + drift <= budget AS good FROM u)
    SELECT c.deck_id, c.ref, CAST(coalesce((SELECT min(o.rung) FROM o WHERE f.good AND o.deck_id = c.deck_id AND o.ref = c.ref AND list_contains(f.taken, o.k)), f.at) AS INT) AS rung,
        CAST(CASE WHEN good THEN len(taken) - 1 ELSE 0 END AS INT) AS moved, round(CASE WHEN good THEN total + drift ELSE fitted_bytes END, 3) AS bytes FROM c JOIN f USING (deck_id)""")
def o10_fill_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ladder.fill_budget(base(spark, sf_dir, STORED), base(spark, sf_dir, COVER), base(spark, sf_dir, STARTS)).withColumn("bytes", F.round("bytes", 3))


#: Content of pages, images that several pages draw, and budgets that some pages do not fit.
CONTENT = "SELECT deck_id, ref AS page, bytes % 40000 AS bytes FROM ({images}) i"
DRAWS = "SELECT deck_id, ref AS page, 100 + ref % 3 AS ref, 50000 + deck_id % 40000 + ref % 3 * 1000 AS bytes FROM ({images}) i UNION ALL SELECT deck_id, ref, ref, bytes % 90000 FROM ({images}) j WHERE ref % 2 = 0"
LIMITS = "SELECT deck_id, 10000 AS shared, CASE WHEN deck_id % 5 = 0 THEN 190000 ELSE 300000 END AS budget FROM ({images}) i GROUP BY deck_id"


@query(f"""WITH RECURSIVE p AS (SELECT deck_id, page, bytes, row_number() OVER (PARTITION BY deck_id ORDER BY page) AS k FROM ({CONTENT}) c), d AS (SELECT deck_id, page, list(DISTINCT ref) AS refs FROM ({DRAWS}) x GROUP BY 1, 2),
    z AS (SELECT DISTINCT deck_id, ref, bytes FROM ({DRAWS}) y), e AS (SELECT p.*, coalesce(refs, []) AS refs, shared, budget, shared + p.bytes + coalesce((SELECT sum(z.bytes) FROM z WHERE z.deck_id = p.deck_id AND list_contains(d.refs, z.ref)), 0) AS alone FROM p JOIN ({LIMITS}) l USING (deck_id) LEFT JOIN d ON d.deck_id = p.deck_id AND d.page = p.page),
    w AS (SELECT deck_id, 1::BIGINT AS k, 1 AS part, page, alone AS total, refs AS held, alone > budget AS bad FROM e WHERE k = 1 UNION ALL
        SELECT deck_id, k, CASE WHEN grown <= budget THEN part ELSE part + 1 END, page, CASE WHEN grown <= budget THEN grown ELSE alone END, CASE WHEN grown <= budget THEN list_distinct(list_concat(held, refs)) ELSE refs END, bad OR (grown > budget AND alone > budget)
        FROM (SELECT e.deck_id, e.k, w.part, e.page, e.alone, e.budget, e.refs, w.held, w.bad, w.total + e.bytes + coalesce((SELECT sum(z.bytes) FROM z WHERE z.deck_id = e.deck_id AND list_contains(e.refs, z.ref) AND NOT list_contains(w.held, z.ref)), 0) AS grown FROM w JOIN e ON e.deck_id = w.deck_id AND e.k = w.k + 1) g),
    b AS (SELECT deck_id, min(page) AS too_large FROM w WHERE bad GROUP BY 1)
    SELECT w.deck_id, CAST(part AS INT) AS part, min(w.page) AS start_page, max(w.page) AS end_page, max(total)::DOUBLE AS bytes, CAST(NULL AS BIGINT) AS too_large FROM w WHERE deck_id NOT IN (SELECT deck_id FROM b) GROUP BY 1, 2
    UNION ALL SELECT deck_id, NULL, NULL, NULL, NULL, too_large FROM b""")
def o8_split_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_document(base(spark, sf_dir, CONTENT), base(spark, sf_dir, DRAWS), base(spark, sf_dir, LIMITS))


@query(f"SELECT t.deck_id, rung, CAST(floor(total + 0.5) AS BIGINT) AS bytes, total <= budget * 1.04::DOUBLE AS built FROM (SELECT deck_id, rung, {TOTAL} AS total FROM {PREDICTED} p GROUP BY 1, 2) t JOIN ({BUDGETS}) b USING (deck_id)")
def p9_try_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ladder.try_gate(totals_of(spark, sf_dir), base(spark, sf_dir, BUDGETS).withColumn("budget", F.col("budget").cast("double")))


@query(f"""WITH r AS (SELECT o_orderkey AS deck_id, o_orderkey % 5 AS k, o_orderkey % 4 AS resized, o_orderkey % 3 AS resaved, o_orderkey % 2 AS untouched, CASE WHEN o_orderkey % 6 > 0 THEN 1440 + o_orderkey % 3 * 240 END AS edge, o_orderkey % 7 AS pages, CAST(floor(o_totalprice * 100) AS BIGINT) AS size FROM {{orders}}),
    x AS (SELECT *, CASE k WHEN 0 THEN 'original' WHEN 1 THEN 'lossless' WHEN 2 THEN 'flattened' WHEN 3 THEN 'images' ELSE 'split-needed' END AS kind, deck_id % 8 = 0 AS signed FROM r)
    SELECT deck_id, CASE WHEN kind = 'flattened' THEN 'flattened' WHEN kind = 'original' THEN 'original' WHEN resized + resaved > 0 THEN 'images' ELSE 'qpdf' END AS engine,
        CASE WHEN kind = 'flattened' THEN 'strong' WHEN resized + resaved = 0 THEN 'preserved' WHEN resized > 0 THEN 'strong' ELSE 'optimized' END AS quality, CAST(ceil(size * 1.3684::DOUBLE + 524288) AS BIGINT) AS message, kind <> 'split-needed' AND size <= 15000000 AS fits,
        CASE WHEN kind = 'original' THEN '{drivers.SAID['original']}' ELSE concat_ws('|', CASE WHEN kind = 'flattened' THEN 'Turned ' || CASE WHEN pages = 1 THEN 'the slide' ELSE pages || ' slides' END || ' into pictures' || CASE WHEN edge IS NULL THEN '' ELSE ', at least ' || edge || ' pixels across' END || '.|{drivers.SAID['lost']}'
            WHEN kind = 'lossless' OR (kind = 'split-needed' AND edge IS NULL) THEN '{drivers.SAID['tidy']}'
            ELSE concat_ws('|', CASE WHEN resized > 0 AND edge IS NOT NULL THEN 'Resized ' || resized || CASE WHEN resized = 1 THEN ' image' ELSE ' images' END || ' for a ' || edge || '-pixel-wide slide.' END, CASE WHEN resaved > 0 THEN 'Re-saved ' || resaved || CASE WHEN resaved = 1 THEN ' photo' ELSE ' photos' END || ' a little lighter.' END,
                CASE WHEN untouched > 0 THEN untouched || ' image left exactly as they were.' END, CASE WHEN pages > 3 THEN '{drivers.SAID['drawings']}' END, '{drivers.SAID['kept']}') END,
            CASE WHEN signed THEN '{drivers.SAID['signed']}' END) END AS notes FROM x""")
def p15_p16_outcome_and_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = base(spark, sf_dir, "SELECT o_orderkey AS deck_id, CAST(floor(o_totalprice * 100) AS BIGINT) AS size FROM {orders}")
    k = F.col("deck_id")
    kind = F.get(F.array(*map(F.lit, ("original", "lossless", "flattened", "images", "split-needed"))), (k % 5).cast("int"))
    resized, resaved, pages = k % 4, k % 3, k % 7
    said = drivers.notes(kind, resized, resaved, k % 2, F.when(k % 6 > 0, 1440 + k % 3 * 240), F.greatest(pages - 3, F.lit(0)), pages, k % 8 == 0)
    out = r.select("deck_id", drivers.outcome(kind, F.col("size"), F.lit(15_000_000), resized, resaved, F.lit(1)).alias("o"), F.array_join(said, "|").alias("notes"))
    return out.select("deck_id", "o.engine", "o.quality", "o.message", "o.fits", "notes")


NAMED = "SELECT deck_id, ref % 3 AS page, ref FROM ({images}) i WHERE ref % 2 = 0 UNION ALL SELECT deck_id, ref % 3, ref FROM ({images}) j WHERE ref % 4 = 0"
REACHED = "SELECT deck_id, page, ref + page AS ref FROM ({images}) i CROSS JOIN (SELECT 0 AS page UNION ALL SELECT 1 UNION ALL SELECT 2) p WHERE (ref + page) % 3 > 0"
READABLE = "SELECT deck_id, ref FROM ({images}) i WHERE NOT stencil"


@query(f"""SELECT deck_id, ref, array_to_string(list_sort(list_distinct(list(CASE WHEN named THEN page END))), ',') AS pages, array_to_string(list_sort(list_distinct(list(CASE WHEN NOT named THEN page END))), ',') AS reach
    FROM (SELECT *, true AS named FROM ({NAMED}) n UNION ALL SELECT *, false FROM ({REACHED}) r) b JOIN ({READABLE}) i USING (deck_id, ref) GROUP BY 1, 2""")
def j1_page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = inventory.page_images(base(spark, sf_dir, NAMED), base(spark, sf_dir, REACHED), base(spark, sf_dir, READABLE))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return out.select("deck_id", "ref", text("pages"), text("reach"))


FACTS = "SELECT p_partkey AS id, need, (p_partkey + length(need)) % 3 = 0 AS yes FROM {part} CROSS JOIN (SELECT 'private' AS need UNION ALL SELECT 'free' UNION ALL SELECT 'expiry') n"
PICKS = "SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'all' ELSE 'free' END AS \"for\" FROM {part} WHERE p_size % 4 > 0"


@query(f"SELECT p_partkey AS id, coalesce(has, '') AS has, coalesce(picks, '') AS picks, coalesce(picks = 'all', false) AS ours FROM {{part}} LEFT JOIN (SELECT id, string_agg(need, ' ' ORDER BY need) AS has FROM ({FACTS}) f WHERE yes GROUP BY 1) a ON a.id = p_partkey LEFT JOIN (SELECT id, \"for\" AS picks FROM ({PICKS}) q) b ON b.id = p_partkey")
def j11_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    services = base(spark, sf_dir, "SELECT p_partkey AS id FROM {part}")
    out = drivers.services_for(services, base(spark, sf_dir, FACTS), base(spark, sf_dir, PICKS.replace('"for"', "`for`")))
    return out.select("id", F.array_join("has", " ").alias("has"), F.array_join("picks", " ").alias("picks"), "ours")


TILES = "SELECT user_id AS image, event_id AS tile, CAST(event_id * 7 % 23 AS DOUBLE) AS detail, CAST(event_id % 11 AS DOUBLE) AS spread, value AS score FROM {events} WHERE user_id IS NOT NULL AND value IS NOT NULL"


@query(f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY detail DESC, tile) AS b FROM ({TILES}) x), s AS (SELECT image, arg_min(b, (detail, b)) AS s FROM t WHERE b >= 3 AND spread > 4 GROUP BY 1),
    p AS (SELECT t.*, CASE WHEN b < 3 THEN b WHEN b = coalesce(s, 3) THEN 3 END AS place FROM t LEFT JOIN s USING (image)) SELECT image, string_agg(tile::VARCHAR, ',' ORDER BY place) AS tiles, min(score) AS score FROM p WHERE place IS NOT NULL GROUP BY 1""")
def t3_a13_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = base(spark, sf_dir, TILES)
    picked = drivers.picked_tiles(t.select("image", "tile", "detail", "spread"))
    tiles = picked.groupBy("image").agg(F.sort_array(F.collect_list(F.struct("place", "tile"))).alias("p")).select("image", F.array_join(F.transform("p", lambda x: x["tile"].cast("string")), ",").alias("tiles"))
    return tiles.join(drivers.worst_tiles(picked.join(t, ["image", "tile"]), ["image"]), "image")


@query("""SELECT event_id, CASE WHEN k = 0 THEN '' WHEN k = 1 THEN '/DCTDecode' WHEN k = 2 THEN '/FlateDecode /DCTDecode' WHEN k = 3 THEN '/LZWDecode' ELSE '' END AS names, CASE WHEN event_id % 3 > 0 THEN event_id % 3 END AS positive,
    event_id % 2 = 1 AS fixed_id, 100 * event_id % 977 AS deck, CAST(ceil((100 * event_id % 977) * 1.3684::DOUBLE + 524288) AS BIGINT) AS email FROM (SELECT event_id, event_id % 5 AS k FROM {events}) e""")
def f18_f19_f32_h1_names_and_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = base(spark, sf_dir, "SELECT event_id FROM {events}")
    k = F.col("event_id")
    filters = F.get(F.array(*map(F.lit, ("null", '"/DCTDecode"', '["/FlateDecode", null, "/DCTDecode"]', '["/LZWDecode", 7, {}]', "12"))), (k % 5).cast("int"))
    value = F.when(k % 5 == 4, F.parse_json(F.lit("{}"))).otherwise(F.parse_json(filters))
    weight = scalars.weights_for(k * 100 % 977, F.lit(25_000_000), F.lit(17_000_000))
    out = e.select("event_id", F.array_join(F.filter(scalars.name_list(value), lambda x: x.startswith("/")), " ").alias("names"), scalars.positive(k % 3).alias("positive"), (F.size(scalars.id_arguments(k % 2 == 0)) > 0).alias("fixed_id"), weight.alias("w"))
    return out.select("event_id", "names", "positive", "fixed_id", F.col("w.deck").alias("deck"), F.col("w.email").alias("email"))


@query("SELECT deck_id, n, page, coalesce(lag(page) OVER w, 0) + 1 AS least, coalesce(lead(page) OVER w, 30) - 1 AS most FROM (SELECT deck_id, ref AS n, ref * 3 + deck_id % 2 AS page FROM ({images}) i) b WINDOW w AS (PARTITION BY deck_id ORDER BY n)")
def w12_break_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir, "SELECT deck_id, ref AS n, ref * 3 + deck_id % 2 AS page FROM ({images}) i")
    return split.break_bounds(b, b.select("deck_id").distinct().withColumn("pages", F.lit(30).cast("long")))


@query("""WITH e AS (SELECT event_id, event_id % 5 + 1 AS a, event_id % 3 + 1 AS d, event_id % 2 + 1 AS m, event_id % 4 + 1 AS b, event_id % 6 = 0 AS own, event_id % 11 = 0 AS lost FROM {events})
    SELECT event_id, false AS known, NULL AS ref, NULL AS width, NULL AS height FROM e WHERE lost UNION ALL SELECT event_id, true, CASE WHEN own THEN '9 0 R' ELSE '8 0 R' END, (a * m * b)::DOUBLE, (d * m)::DOUBLE FROM e WHERE NOT lost
    UNION ALL SELECT event_id, true, CASE WHEN own THEN '9 0 R' ELSE '8 0 R' END, (2 * a * m * b)::DOUBLE, (3 * d * m)::DOUBLE FROM e WHERE NOT lost UNION ALL SELECT event_id, true, '8 0 R', 5, 7 FROM e WHERE NOT lost""")
def g7_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms with matrices, with resources of their own or none, inside of each other and of themselves; a Q too many; streams that are missing."""
    e, k = base(spark, sf_dir, "SELECT event_id FROM {events}"), F.col("event_id")
    text = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v.cast("string") for v in x)).cast("binary")
    names = lambda image: F.create_map(*map(F.lit, ("/I", image, "/F1", "5 0 R", "/F2", "6 0 R", "/Nothing", "7 0 R")))
    thing = lambda ref, kind, matrix, own, stream: F.struct(F.lit(ref).alias("ref"), F.lit(kind).alias("subtype"), matrix.alias("matrix"), own.alias("names"), stream.alias("content"))
    none, no_names, no_stream = F.lit(None).cast("array<double>"), F.lit(None).cast("map<string,string>"), F.lit(None).cast("binary")
    m, zero = (k % 2 + 1).cast("double"), F.lit(0.0)
    first = text("q Q Q ", k % 4 + 1, " 0 0 1 0 0 cm (/I Do) Tj /I Do /F2 Do")
    reached = F.array(
        thing("5 0 R", "/Form", F.array(m, zero, zero, m, zero, zero), F.when(k % 6 == 0, names("9 0 R")), F.when(k % 11 > 0, first)), thing("6 0 R", "/Form", none, no_names, text("2 0 0 3 4 5 cm /I Do /F1 Do /Nothing Do")),
        thing("8 0 R", "/Image", none, no_names, no_stream), thing("9 0 R", "/Image", none, no_names, no_stream),
    )
    pages = e.select("event_id", content.placements_column(F.array(text("q ", k % 5 + 1, " 0 0 ", k % 3 + 1, " 10 20 cm /F1"), text("Do Q 0 5 -7 0 1 1 cm /I Do")), names("8 0 R"), reached).alias("p"))
    return pages.select("event_id", "p.known", F.explode_outer("p.drawn").alias("d")).select("event_id", "known", "d.ref", "d.width", "d.height")


RESOURCES = """SELECT l_suppkey % 20 AS deck_id, l_partkey % 60 AS owner, CASE l_linenumber WHEN 1 THEN '/SMask' WHEN 2 THEN '/Pattern' WHEN 3 THEN '/Font' ELSE '/XObject' END AS "key", l_partkey % 60 * 2 % 61 + l_linenumber AS ref,
    CASE WHEN l_linenumber = 3 THEN CASE WHEN l_partkey % 2 = 0 THEN '/Type3' ELSE '/Type1' END WHEN l_linenumber < 3 THEN '/Form' WHEN l_partkey % 3 = 0 THEN '/Image' ELSE '/Form' END AS subtype FROM {lineitem} WHERE l_partkey % 60 IS NOT NULL"""
OWNING = "SELECT DISTINCT deck_id, ref FROM ({resources}) r WHERE ref % 4 > 0"
ROOTS = "SELECT DISTINCT deck_id, owner AS page, owner FROM ({resources}) r WHERE owner < 6"


@query(f"""WITH RECURSIVE e AS (SELECT DISTINCT * FROM ({RESOURCES}) x), o AS ({OWNING.replace("{resources}", RESOURCES)}), w AS ({ROOTS.replace("{resources}", RESOURCES).replace("owner FROM", "owner AS at, true AS tracked FROM")} UNION
        SELECT w.deck_id, w.page, e.ref, CASE WHEN e."key" = '/XObject' THEN w.tracked ELSE false END FROM w JOIN e ON e.deck_id = w.deck_id AND e.owner = w.at JOIN o ON o.deck_id = e.deck_id AND o.ref = e.ref
        WHERE (e."key" = '/XObject' AND subtype = '/Form') OR e."key" IN ('/SMask', '/Pattern') OR (e."key" = '/Font' AND subtype = '/Type3')),
    h AS (SELECT w.deck_id, w.page, e.ref, e."key", subtype, w.tracked, CASE WHEN e."key" = '/XObject' AND subtype = '/Form' THEN w.tracked WHEN e."key" IN ('/SMask', '/Pattern') OR (e."key" = '/Font' AND subtype = '/Type3') THEN false END AS into_ FROM w JOIN e ON e.deck_id = w.deck_id AND e.owner = w.at)
    SELECT deck_id, page, ref, 'image' AS kind FROM h WHERE "key" = '/XObject' AND subtype = '/Image' AND NOT tracked UNION SELECT deck_id, page, ref, 'form' FROM h WHERE NOT into_ AND "key" <> '/Font'
    UNION SELECT deck_id, page, NULL, 'inherits' FROM h WHERE NOT into_ AND NOT EXISTS (SELECT 1 FROM o WHERE o.deck_id = h.deck_id AND o.ref = h.ref)""")
def g5_untracked_drawing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = RESOURCES.replace('"key"', "key")
    rows = base(spark, sf_dir, plain)
    owning, roots = (base(spark, sf_dir, x.replace("{resources}", plain)) for x in (OWNING, ROOTS))
    return inventory.untracked(rows, owning, roots)


@query("SELECT deck_id, CAST(l AS INT) AS depth, count(*) AS dictionaries FROM (SELECT l_suppkey % 40 AS deck_id, unnest(CASE WHEN l_partkey % 3 = 0 THEN [0, 1, 2, 3, 3] WHEN l_partkey % 3 = 1 THEN [0] ELSE [0, 2] END) AS l FROM (SELECT DISTINCT l_suppkey, l_partkey FROM (SELECT l_suppkey % 40 AS l_suppkey, l_partkey FROM {lineitem}) a) b) c GROUP BY 1, 2")
def g1_dictionaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base(spark, sf_dir, "SELECT DISTINCT l_suppkey % 40 AS deck_id, l_partkey FROM {lineitem}")
    shapes = ('{"/A": {"/B": {"/C": {}, "/D": {"/E": [1, "x"]}}}}', '{"/Type": "/Page"}', '{"/Kids": [{"/K": 1}]}')
    body = F.get(F.array(*map(F.lit, shapes)), (F.col("l_partkey") % 3).cast("int"))
    entry = F.concat(F.lit('"obj:'), F.col("l_partkey").cast("string"), F.lit(' 0 R": {"value": '), body, F.lit("}"))
    docs = rows.groupBy("deck_id").agg(F.concat(F.lit('{"qpdf": [{}, {'), F.array_join(F.collect_list(entry), ","), F.lit("}]}")).alias("json"))
    return objects.dictionaries(objects.pdf_objects(docs)).groupBy("deck_id", "depth").agg(F.count("*").alias("dictionaries"))


@query("""WITH c AS (SELECT deck_id, edge, codec FROM (SELECT DISTINCT l_orderkey AS deck_id FROM {lineitem}) d CROSS JOIN (VALUES (1440), (1920)) e(edge) CROSS JOIN (VALUES ('jpeg+flate'), ('jpeg')) f(codec)) SELECT deck_id, edge, codec, CAST(len(string_split(codec, '+')) AS INT) AS writers FROM c""")
def h10_h12_settings_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    decks = base(spark, sf_dir, "SELECT DISTINCT l_orderkey AS deck_id FROM {lineitem}")
    grid = drivers.settings_grid(decks, spark.createDataFrame([(1440,), (1920,)], "edge int"), spark.createDataFrame([("jpeg+flate",), ("jpeg",)], "codec string"))
    return grid.select("deck_id", "edge", "codec", F.size("codecs").alias("writers"))


#: What an image comes to at a rung: mostly less than predicted, in some decks far less.
OUT = "CAST(floor(base * (0.25D + deck_id % 4 * 0.2D - rung * 0.03D + ref % 3 * 0.05D)) AS DOUBLE)"


@query()
def o7_compress_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    cover = ladder.coverage(base(spark, sf_dir, PLACED), base(spark, sf_dir, PAGES), base(spark, sf_dir, IMAGES))
    i = inventory_of(spark, sf_dir).withColumn("first_page", F.col("ref")).join(cover, ["deck_id", "ref"])
    files = base(spark, sf_dir, """SELECT deck_id, CAST(sum(bytes) AS BIGINT) + 20000 AS file_bytes, CAST(sum(bytes) * (0.15 + deck_id % 9 * 0.11) AS DOUBLE) AS budget, CASE WHEN deck_id % 4 > 0 THEN CAST(floor(sum(bytes) * 0.94) AS BIGINT) END AS tidy_bytes,
        CAST(CASE WHEN deck_id % 7 = 0 THEN sum(bytes) * 0.002 ELSE 0 END AS DOUBLE) AS drift FROM ({images}) i GROUP BY deck_id""")
    streams = i.select("deck_id", "filters", "bytes")
    return compressing.compress_decks(files, i.select("deck_id", "ref", "bytes", "kind", "first_page", "coverage"), plans_of(spark, sf_dir), streams, lambda rows: rows.withColumn("out", F.expr(OUT)))[0]


@query()
def o14_flatten_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    decks = base(spark, sf_dir, "SELECT deck_id, CAST(sum(bytes) * 0.6 AS DOUBLE) AS budget, 2000D AS overhead, CASE WHEN deck_id % 3 = 0 THEN 1.05D ELSE 1.0D END AS growth FROM ({images}) i GROUP BY deck_id")
    return drivers.flatten_plan(versions_of(spark, sf_dir), decks)


@query("""SELECT event_id, CASE WHEN k IN (0, 1, 4) THEN 'ok' ELSE 'none' END AS jpeg, CASE WHEN k = 2 THEN 'none' WHEN k % 2 = 0 THEN '0103' ELSE '01020304' END AS raw, 50 AS quality FROM (SELECT event_id, event_id % 5 AS k FROM {events}) e""")
def s5_f24_readable_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JPEGs as they are, inside of Flate, of another size, under a filter that cannot be undone; samples of 8 and 16 bits, and too few of them."""
    e, k = base(spark, sf_dir, "SELECT event_id FROM {events}"), F.col("event_id") % 5
    table = "FFDB004300" + "".join(f"{containers.LUMINANCE[i]:02X}" for i in containers.ZIGZAG)
    plain = F.unhex(F.concat(F.lit(f"FFD8{table}FFC0000B080002"), F.lpad(F.hex(F.when(k == 2, 3).otherwise(1)), 4, "0"), F.lit("01011100FFDA0003010011FFD9")))
    name = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    data = F.when(k == 1, containers.deflated(plain)).otherwise(plain)
    filters = F.when(k == 1, name("/FlateDecode", "/DCTDecode")).when(k == 3, name("/LZWDecode", "/DCTDecode")).otherwise(name("/DCTDecode"))
    one, jpeg, raw = F.lit(1), F.lit("jpeg"), F.lit("raw")
    samples = F.unhex(F.when(k == 2, "010203").otherwise("01020304"))
    wide = k % 2 == 0
    got = containers.readable_image(samples, name(), raw, F.when(wide, 1).otherwise(2), F.lit(2), one, F.when(wide, 16).otherwise(8))
    found = containers.readable_image(data, filters, jpeg, one, F.lit(2), one, F.lit(8))
    return e.select("event_id", F.when(found == plain, "ok").when(found.isNull(), "none").otherwise("changed").alias("jpeg"), F.coalesce(F.lower(F.hex(got)), F.lit("none")).alias("raw"), containers.jpeg_quality(plain).alias("quality"))


@query()
def s10_picture_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = base(spark, sf_dir, "SELECT deck_id, ref AS page, CAST(concat('JPEG', repeat('x', CAST(bytes % 500 AS INT))) AS BINARY) AS jpeg, width, height, CASE WHEN space = '/DeviceGray' THEN 1 ELSE 3 END AS components, 960.0D AS page_width, 540.5D AS page_height FROM ({images}) i")
    return split.picture_document(pages).select("deck_id", F.length("content").alias("bytes"), F.sha1("content").alias("digest"))


HIDDEN = f"SELECT job_id, min(ts_ms) + 1000 AS from_ms, min(ts_ms) + 90000 AS to_ms FROM ({EVENTS}) h GROUP BY job_id"


@query(f"""WITH g AS (SELECT job_id, seq, lag(ts_ms) OVER w AS after_ms, ts_ms - lag(ts_ms) OVER w AS gap FROM ({EVENTS}) e WINDOW w AS (PARTITION BY job_id ORDER BY ts_ms, seq))
    SELECT job_id, after_ms, gap - away AS gap FROM (SELECT g.*, greatest(0, coalesce(least(to_ms, after_ms + gap) - greatest(from_ms, after_ms), 0)) AS away FROM g LEFT JOIN ({HIDDEN}) h USING (job_id) WHERE gap > 3000) x WHERE gap - away > 3000""")
def r4_seen_stalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.stalls(base(spark, sf_dir, EVENTS), 3000, base(spark, sf_dir, HIDDEN))


JOBS = "SELECT user_id, event_id, event_id % 4 AS version, CAST(event_id % 101 AS DOUBLE) / 100 AS w FROM {events} WHERE user_id IS NOT NULL"


@query(f"SELECT j.user_id, j.event_id, round(greatest(0.4::DOUBLE, 0.4::DOUBLE + 0.6::DOUBLE * w), 6) AS fraction FROM ({JOBS}) j JOIN (SELECT user_id, max(event_id) % 4 AS version FROM ({JOBS}) k GROUP BY 1) c ON c.user_id = j.user_id AND c.version = j.version")
def r5_r7_current_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = base(spark, sf_dir, JOBS)
    current = j.groupBy("user_id").agg((F.max("event_id") % 4).alias("version"))
    return progress.current_only(j, current, ["user_id"]).select("user_id", "event_id", F.round(progress.continued(F.col("w"), F.lit(0.4)), 6).alias("fraction"))


@query("""WITH p AS (SELECT deck_id, ref AS page, CAST(100 + width % 500 AS DOUBLE) AS w, CAST(50 + height % 300 AS DOUBLE) AS h, ref % 3 = 0 AS lost FROM ({images}) i),
    bad AS (SELECT deck_id, page AS ref FROM p WHERE deck_id % 5 = 0 AND page = 2 UNION SELECT a.deck_id, a.page FROM p a JOIN p b ON b.deck_id = a.deck_id AND b.lost AND b.page IN (a.page, a.page + 1)),
    known AS (SELECT p.* FROM p WHERE NOT lost AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.deck_id = p.deck_id AND bad.ref = p.page)),
    seen AS (SELECT k.* FROM known k WHERE NOT EXISTS (SELECT 1 FROM p h WHERE h.deck_id = k.deck_id AND h.page = k.page + 1 AND h.deck_id % 7 = 0 AND h.page % 2 = 0))
    SELECT deck_id, page || ' 0 R' AS ref, page, w * CASE WHEN page % 2 = 0 THEN 2 ELSE 1 END AS width, h * CASE WHEN page % 2 = 0 THEN 2 ELSE 1 END AS height FROM seen
    UNION ALL SELECT deck_id, (page + 50) || ' 0 R', page, w * CASE WHEN page % 2 = 0 THEN 2 ELSE 1 END, h * CASE WHEN page % 2 = 0 THEN 2 ELSE 1 END FROM seen WHERE page % 4 = 1""")
def o4_found_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that draw their image, every second one through a form twice as large; pages that cannot be read, images that are also drawn unseen, pages whose drawing inherits its resources, and masks."""
    i = base(spark, sf_dir, "SELECT deck_id, ref, CAST(100 + width % 500 AS STRING) AS w, CAST(50 + height % 300 AS STRING) AS h FROM ({images}) i")
    n = F.col("ref")
    text = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v.cast("string") for v in x))
    image, form = text(n, " 0 R"), text(n + 100, " 0 R")
    names = F.create_map(F.lit("/I"), image, F.lit("/F"), form)
    thing = lambda ref, kind, matrix, own, stream: F.struct(ref.alias("ref"), F.lit(kind).alias("subtype"), matrix.alias("matrix"), own.alias("names"), stream.alias("content"))
    none = F.lit(None)
    objects_ = F.array(
        thing(form, "/Form", F.array(*map(F.lit, (2.0, 0.0, 0.0, 2.0, 0.0, 0.0))), none.cast("map<string,string>"), F.lit("/I Do").cast("binary")), thing(image, "/Image", none.cast("array<double>"), none.cast("map<string,string>"), none.cast("binary")),
    )
    stream = F.when(n % 3 > 0, text("q ", F.col("w"), " 0 0 ", F.col("h"), " 5 6 cm ", F.when(n % 2 == 0, "/F").otherwise("/I"), " Do Q").cast("binary"))
    page = n.cast("int")
    pages = i.select("deck_id", page.alias("page"), F.array(stream).alias("contents"), names.alias("names"), objects_.alias("objects"))
    images = i.select("deck_id", image.alias("ref"), F.array(page, page + 1).alias("reach"))
    hidden = i.where("deck_id % 5 = 0 AND ref = 2").select("deck_id", page.alias("page"), image.alias("ref"), F.lit("image").alias("kind")).unionByName(
        i.where("deck_id % 7 = 0 AND ref % 2 = 0").select("deck_id", page.alias("page"), none.cast("string").alias("ref"), F.lit("inherits").alias("kind"))
    )
    masks = i.where("ref % 4 = 1").select("deck_id", text(n + 50, " 0 R").alias("ref"), image.alias("parent"))
    return content.find_placements(pages, images, hidden, masks)


@query("SELECT deck_id, count(*) AS pages, CAST(sum(bytes) AS BIGINT) AS bytes FROM ({images}) i GROUP BY 1 HAVING count(*) >= 2")
def h2_decks_to_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drivers.split_plan_of(base(spark, sf_dir, "SELECT deck_id, ref AS page, bytes FROM ({images}) i"))
    return found.select("deck_id", F.size("sizes").cast("long").alias("pages"), F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("bytes"))


@query("""SELECT deck_id, count(*) FILTER (WHERE NOT (ref = 4 AND deck_id % 3 > 0)) AS objects, coalesce(bool_or(ref = 4 AND deck_id % 3 = 0), false) AS refused FROM ({images}) i GROUP BY 1 HAVING count(*) FILTER (WHERE NOT (ref = 4 AND deck_id % 3 > 0)) > 0""")
def o20_without_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fourth object of a deck is its manifest; in every third deck it is not listed as one, and stays."""
    o = base(spark, sf_dir, "SELECT deck_id, ref, CASE WHEN ref = 4 THEN 'manifest' ELSE 'image' END AS kind FROM ({images}) i")
    left, refused = inventory.without_credentials(o, o.where("ref = 4 AND deck_id % 3 > 0").select("deck_id", "ref"))
    return left.groupBy("deck_id").agg(F.count("*").alias("objects")).join(refused, "deck_id")


@query("""SELECT deck_id, ref, CASE WHEN ceil(log10(px * 0.5::DOUBLE / 0.1::DOUBLE)) > 6 THEN NULL ELSE CAST(greatest(0, ceil(log10(px * 0.5::DOUBLE / 0.1::DOUBLE))) AS INT) END AS decimals, CASE WHEN ref % 2 = 0 THEN 2.45::DOUBLE ELSE 3.25::DOUBLE END AS distance, true AS halved
    FROM (SELECT deck_id, ref, pow(10::DOUBLE, CAST(ref AS DOUBLE) - 2) * (1 + deck_id % 7) AS px FROM ({images}) i) x""")
def f16_f21_decimals_and_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = base(spark, sf_dir, "SELECT deck_id, ref, pow(10D, CAST(ref AS DOUBLE) - 2) * (1 + deck_id % 7) AS px FROM ({images}) i")
    settings = scalars.encoder_settings(F.lit(0.72), F.when(F.col("ref") % 2 == 1, 3.25))
    return i.select("deck_id", "ref", scalars.path_decimals(F.col("px")).alias("decimals"), settings.alias("s")).select("deck_id", "ref", "decimals", "s.distance", (F.col("s.subsample420") & F.col("s.progressive")).alias("halved"))


#: Pages of a deck that share one dictionary, which names all of the deck's images; each draws its own, and of some it cannot be told.
IN_USE = "SELECT a.deck_id, a.ref AS page, b.ref, b.bytes FROM ({images}) a JOIN ({images}) b ON b.deck_id = a.deck_id WHERE b.ref = a.ref OR a.ref % 5 = 0"


@query(SPLIT.replace(USES, IN_USE) + " SELECT deck_id, page, bytes, shared FROM g JOIN s USING (deck_id)")
def o19_split_plan_in_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = base(spark, sf_dir, "SELECT deck_id, ref AS page, bytes FROM ({images}) i")
    name = lambda c: F.concat(F.lit("/I"), c.cast("string"))
    entries = i.select("deck_id", "page").join(i.select("deck_id", name(F.col("page")).alias("name"), F.col("page").alias("ref"), "bytes"), "deck_id")
    streams = F.array(F.lit("q 1 0 0 1 0 0 cm").cast("binary"), F.when(F.col("page") % 5 > 0, F.concat(F.lit("("), name(F.col("page") + 1), F.lit(" Do) Tj "), name(F.col("page")), F.lit(" Do Q")).cast("binary")))
    uses = content.named_in_use(i.select("deck_id", "page", streams.alias("contents")), entries)
    shared, pages = split.split_plan(uses.select("deck_id", "page", "ref", "bytes"), uses.select("deck_id", "page"))
    return pages.join(shared, "deck_id").select("deck_id", "page", "bytes", "shared")
