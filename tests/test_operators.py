import random

from helpers import heap_fill
from pyspark.sql import functions as F

from quirefold.functions import pixels, scalars
from quirefold.operators import content, flatten, ladder, split
from quirefold.streaming import progress


def greedy(pages, budget, floor=0.7):
    """Brute force: the step of least slope, one at a time, then back by the greatest."""
    ladders = []
    for sizes, clear in pages:
        keep = sorted((i for i in range(len(sizes)) if i == 0 or clear[i] >= floor), key=lambda i: (sizes[i], -clear[i]))
        chain = []
        for i in keep:
            if chain and clear[i] <= clear[chain[-1]]:
                continue
            while len(chain) > 1:
                a, b = chain[-2:]
                if (sizes[b] - sizes[a]) * (clear[i] - clear[a]) < (clear[b] - clear[a]) * (sizes[i] - sizes[a]):
                    break
                chain.pop()
            chain.append(i)
        ladders.append(chain[::-1])
    at = [0] * len(pages)

    def edge(p, k):
        (sizes, clear), (a, b) = pages[p], ladders[p][k : k + 2]
        return (clear[a] - clear[b]) / max(1, sizes[a] - sizes[b]), sizes[a] - sizes[b]

    total = sum(pages[p][0][ladders[p][0]] for p in range(len(pages)))
    while total > budget:
        ways = [(edge(p, at[p])[0], p) for p in range(len(pages)) if at[p] + 1 < len(ladders[p])]
        if not ways:
            break
        p = min(ways)[1]
        total -= edge(p, at[p])[1]
        at[p] += 1
    while total <= budget:
        ways = [(-edge(p, at[p] - 1)[0], p) for p in range(len(pages)) if at[p] and edge(p, at[p] - 1)[1] <= budget - total]
        if not ways:
            break
        p = min(ways)[1]
        at[p] -= 1
        total += edge(p, at[p])[1]
    return [ladders[p][k] for p, k in enumerate(at)]


def test_choice_equals_greedy_loop(spark):
    rng, rows, budgets, expected = random.Random(5), [], [], {}
    for deck in range(60):
        pages = []
        for page in range(rng.randint(1, 6)):
            n = rng.randint(2, 8)
            sizes = sorted((rng.randint(100, 10_000) for _ in range(n)), reverse=True)
            clear = sorted((rng.random() * 0.5 + 0.5 for _ in range(n)), reverse=True)
            pages.append((sizes, clear))
            rows += [(deck, page, v, sizes[v], clear[v]) for v in range(n)]
        budget = sum(p[0][0] for p in pages) * rng.uniform(0.2, 1.1)
        budgets.append((deck, budget))
        expected[deck] = greedy(pages, budget)
    versions = spark.createDataFrame(rows, "deck_id long, page int, version int, bytes long, clarity double")
    found = flatten.choose_versions(versions, spark.createDataFrame(budgets, "deck_id long, budget double")).collect()
    got = {}
    for r in found:
        got.setdefault(r["deck_id"], {})[r["page"]] = r["version"]
    assert {d: [v[p] for p in sorted(v)] for d, v in got.items()} == expected


def test_even_breaks(spark):
    def run(sizes, parts):
        return spark.range(1).select(split.even_breaks(F.array(*map(lambda x: F.lit(float(x)), sizes)), F.lit(parts)).alias("b")).first()["b"]

    assert run([10, 10, 10, 10], 2) == [2]
    assert run([40, 1, 1, 1], 3) == [1, 2]
    # The total is reached on the last page only, so the break that is missing comes right after the first.
    assert run([1, 1, 1, 40], 2) == [1]
    assert run([5, 5, 5], 3) == [1, 2]


def test_break_lists(spark):
    rows = spark.createDataFrame([([1, 3],), ([],), ([3, 1],), ([5],)], "b array<int>")
    assert [r["v"] for r in rows.select(split.valid_breaks(F.col("b"), F.lit(5)).alias("v")).collect()] == [True, False, False, False]


def test_formats(spark):
    def one(c):
        return spark.range(1).select(c.alias("x")).first()["x"]

    assert one(scalars.format_bytes(F.lit(999))) == "999 B"
    assert one(scalars.format_bytes(F.lit(999_999))) == "1000 KB"
    assert one(scalars.format_bytes(F.lit(12_340_000))) == "12.3 MB"
    assert one(scalars.format_duration(F.lit(0.2))) == "1 ms"
    assert one(scalars.format_size(F.lit(35_000_000))) == "35 MB"
    assert one(scalars.deck_name(F.lit("A.PDF"))) == "A"
    assert one(scalars.decode_pdf_string(F.lit("b:e9"))) == "é"
    assert one(scalars.decode_pdf_string(F.lit("u:x"))) == "x"
    assert one(scalars.email_version_name(F.lit('a:b"c.pdf'))) == "a-b-c-email.pdf"
    assert abs(one(scalars.looks_distance(F.lit(0.7))) - (2.45 / 3.0) ** ((0.7 - 0.66) / 0.06) * 3.0) < 1e-12


def test_content():
    image, names = {"subtype": "/Image"}, {"/F": "f", "/I": "i", "/J": "j"}
    form = lambda content, matrix=None, own=None: {"subtype": "/Form", "matrix": matrix, "names": own, "content": content}
    run = lambda page, f: content.placements([page], names, {"f": f, "i": image, "j": image})
    assert run(b"q 2 0 0 3 0 0 cm /F Do Q /I Do", form(b"10 0 0 10 0 0 cm /J Do /F Do")) == ([("j", 20.0, 30.0), ("i", 1.0, 1.0)], {"f": 3.0})
    assert run(b"2 0 0 2 0 0 cm /F Do", form(b"Q /J Do"))[0] == [("j", 2.0, 2.0)]  # a Q too many leads back to where the form began
    assert run(b"2 0 0 2 0 0 cm /F Do", form(b"/J Do", [3, 0, 0, 5, 0, 0], {"/J": "i"})) == ([("i", 6.0, 10.0)], {"f": 10.0})
    assert run(b"/F Do", form(None)) is None and content.placements([None], names, {}) is None and run(b"/X Do", form(None)) == ([], {})
    chain = {str(n): form(b"/N Do", None, {"/N": str(n + 1)}) for n in range(30)}
    assert content.placements([b"/N Do"], {"/N": "0"}, chain) is None and content.placements([b"/N Do"], {"/N": "0"}, {k: v for k, v in chain.items() if int(k) < 10}) is not None
    assert content.events(b"BI /W 1 ID q Q \x00 EI q (a\\) Do) Tj") == [("q", None, None)]
    assert content.round_paths(b"1.2345 0.5000 m 1 2 3 l", 1.0) == b"1.2 .5 m 1 2 3 l"
    assert content.round_paths(b"1 2 m", 1.0) is None
    assert [content.short_number(*x) for x in ((-0.5, 2), (12.0, 3), (0.004, 2), (100.0, 0))] == ["-.5", "12", "0", "100"]


def test_clarity():
    import numpy as np

    flat, busy = np.full((16, 16), 9, np.uint8), (np.arange(256).reshape(16, 16) * 37 % 256).astype(np.uint8)
    assert pixels.clarity(flat, busy) == 1.0
    assert abs(pixels.clarity(busy, busy) - 1) < 1e-12
    assert pixels.clarity(busy, flat) < 0.3
    assert np.allclose(pixels.resample(busy, 16, 16), busy)


def test_prediction_follows_calibration(spark):
    plans = spark.createDataFrame([(1, 1, 0, "jpeg", True, True, 1000, 0.75, 800.0), (1, 2, 0, "jpeg", True, True, 1000, 0.75, 400.0)], "deck_id long, ref long, rung int, format string, resized boolean, photo boolean, bytes long, default_share double, base double")
    outputs = spark.createDataFrame([(1, 1, 0, 400)], "deck_id long, ref long, rung int, bytes long")
    found = {r["ref"]: r["predicted"] for r in ladder.predict(plans, ladder.calibrate(plans, outputs)).collect()}
    assert found == {1: 400.0, 2: 200.0}


def test_stream_never_falls(spark, tmp_path):
    rows = [(1, t, s, w) for t, s, w in [(0, "inspect", 0.5), (10, "inspect", 0.6), (100, "inspect", 1.0), (120, "photos", 0.5), (300, "photos", 0.2)]]
    spark.createDataFrame(rows, "job_id long, ts_ms long, stage string, within double").coalesce(1).write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema("job_id long, ts_ms long, stage string, within double").parquet(str(tmp_path / "in"))
    q = progress.stream(events).writeStream.format("memory").queryName("sent").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["ts_ms"], r["permille"]) for r in spark.sql("SELECT * FROM sent ORDER BY ts_ms").collect()] == [(0, 40), (100, 60), (120, 470), (300, 470)]


def test_filling_equals_one_move_at_a_time(spark):
    rng, versions, images, decks, expected = random.Random(8), [], [], [], {}
    for deck in range(80):
        own, at = {}, rng.randint(1, 5)
        for ref in range(rng.randint(1, 6)):
            stored = {k: (rng.randint(100, 4000) if rng.random() < 0.3 else 4000 - k * 500 + rng.randint(0, 400), rng.choice("abcdef")) for k in range(6) if rng.random() < 0.75}
            own[ref] = (rng.randint(2000, 5000), rng.choice((0.01, 0.5, 1.0, 3.0)), stored)
            images.append((deck, ref, *own[ref][:2]))
            versions += [(deck, ref, k, *v) for k, v in stored.items()]
        fitted = float(sum(v[2].get(at, (v[0],))[0] for v in own.values()) + 100)
        budget, drift = fitted * rng.uniform(1.0, 2.5), rng.choice((0.0, 0.0, fitted * 0.05, fitted))
        decks.append((deck, at, fitted, budget, drift))
        expected[deck] = heap_fill(own, at, fitted, budget, drift)
    found = ladder.fill_budget(
        spark.createDataFrame(versions, "deck_id long, ref long, rung int, bytes long, version string"), spark.createDataFrame(images, "deck_id long, ref long, bytes long, coverage double"),
        spark.createDataFrame(decks, "deck_id long, at int, fitted_bytes double, budget double, drift double"),
    ).collect()
    got = {}
    for r in found:
        got.setdefault(r["deck_id"], ({}, r["moved"], round(r["bytes"], 6)))[0][r["ref"]] = r["rung"]
    assert got == {d: (n, m, round(b, 6)) for d, (n, m, b) in expected.items()}
    assert sum(m > 0 for _, m, _ in got.values()) > 20


def test_formats_of_exact_halves(spark):
    rows = spark.createDataFrame([(1_005_000,), (1_045,), (1_125,), (12_250,), (2_675,), (999_999,), (100_500,), (5_000_000_000,)], "n long")
    assert [r[0] for r in rows.select(scalars.format_bytes(F.col("n"))).collect()] == ["1.00 MB", "1.04 KB", "1.13 KB", "12.3 KB", "2.67 KB", "1000 KB", "101 KB", "5.00 GB"]


def test_flattening_tries_again_with_a_lower_target(spark):
    from quirefold.operators import drivers

    rng, rows, decks, expected = random.Random(12), [], [], {}
    for deck in range(60):
        pages = []
        for page in range(rng.randint(1, 5)):
            sizes, clear = sorted((rng.randint(100, 10_000) for _ in range(6)), reverse=True), sorted((rng.random() * 0.3 + 0.7 for _ in range(6)), reverse=True)
            pages.append((sizes, clear))
            rows += [(deck, page, v, sizes[v], clear[v]) for v in range(6)]
        budget, growth = sum(p[0][0] + 300 for p in pages) * rng.uniform(0.1, 1.1), rng.choice((1.0, 1.03, 1.2, 1.4))
        decks.append((deck, budget, 50.0, growth))
        # Three files at most; a page takes 400 bytes besides its picture; half a hundredth of the budget more than what a file is over comes off.
        target, heavier = budget * 0.985, [([s + 400 for s in sizes], clear) for sizes, clear in pages]
        for n in range(3):
            picked = greedy(heavier, target)
            over = sum(pages[p][0][v] for p, v in enumerate(picked)) * growth + 50 - budget
            if over <= 0 or n == 2 or sum(heavier[p][0][v] for p, v in enumerate(picked)) > target:
                expected[deck] = (picked, n, over <= 0)
                break
            target -= over + budget * 0.005
    found = drivers.flatten_plan(spark.createDataFrame(rows, "deck_id long, page int, version int, bytes long, clarity double"), spark.createDataFrame(decks, "deck_id long, budget double, overhead double, growth double"))
    got = {}
    for r in found.collect():
        got.setdefault(r["deck_id"], ({}, r["round"], r["fits"]))[0][r["page"]] = r["version"]
    assert {d: ([v[p] for p in sorted(v)], n, fits) for d, (v, n, fits) in got.items()} == expected and {(n, fits) for _, n, fits in got.values()} >= {(0, True), (0, False), (1, True), (2, True)}


def test_picture_document_can_be_found_by_its_offsets(spark):
    import re

    pages = [(1, p, bytes(f"jpeg{p}" * p, "ascii"), 10 * p, 20, 3 if p % 2 else 1, 595.0, 841.89) for p in (1, 2, 3)] + [(2, 7, b"x", 1, 1, 1, 100.5, 50.0)]
    df = spark.createDataFrame(pages, "deck_id long, page int, jpeg binary, width int, height int, components int, page_width double, page_height double")
    for deck, content in split.picture_document(df).collect():
        content = bytes(content)
        start = int(re.search(rb"startxref\n(\d+)\n%%EOF\n$", content)[1])
        table = content[start:].split(b"\n")
        count = int(table[1].split()[1])
        assert table[0] == b"xref" and count == 3 * sum(p[0] == deck for p in pages) + 3
        for n in range(1, count):
            at = int(table[2 + n].split()[0])
            assert content[at:].startswith(b"%d 0 obj\n" % n) and len(table[2 + n]) == 19
        for found in re.finditer(rb"/Length (\d+) >>\nstream\n", content):
            assert content[found.end() + int(found[1]) :].startswith(b"\nendstream")
        own = [p for p in pages if p[0] == deck]
        assert content.count(b"/Type /Page ") == len(own) and all(p[2] in content for p in own) and re.search(rb"/MediaBox \[0 0 (595 841\.89|100\.5 50)\]", content)


def test_tiles_and_lanczos():
    import numpy as np

    rng = np.random.default_rng(13)
    image = rng.integers(0, 256, (50, 61)).astype(np.uint8)
    found = pixels.tile_stats(image, 16)
    assert [f[:2] for f in found] == [(x, y) for y in (1, 17, 33) for x in (6, 22, 38)]
    for x, y, detail, spread in found:
        own = [(i, j) for j in range(y, y + 12, 4) for i in range(x, x + 12, 4)]
        v = image.astype(int)
        assert abs(detail - np.mean([abs(v[j, i] - v[j, i + 4]) + abs(v[j, i] - v[j + 4, i]) for i, j in own])) < 1e-9
        assert abs(spread - np.std([v[j, i] for i, j in own])) < 1e-9
    colour = np.stack([image] * 3, axis=2)
    assert pixels.tile_stats(colour, 16) == found and pixels.crop(image, 6, 1, 16).shape == (16, 16)
    flat = np.full((40, 30, 3), 77, np.uint8)
    assert (pixels.lanczos(flat, 13, 50) == 77).all() and pixels.lanczos(flat, 13, 50).shape == (13, 50, 3)
    assert (pixels.lanczos(image, 50, 61) == image).all()
    ramp = np.tile(np.arange(0, 200, 2, dtype=np.uint8), (4, 1))
    assert np.abs(pixels.lanczos(ramp, 4, 50)[:, 5:45].astype(int) - (np.arange(50) * 4 + 1)[5:45]).max() <= 1


def test_drawings_are_rounded_where_it_pays(spark):
    import zlib

    rng = random.Random(14)
    long = b"\n".join(b"%.9f %.9f l" % (rng.random() * 500, rng.random() * 500) for _ in range(12_000))
    rows = [(1, "a", zlib.compress(long), 1.0), (1, "b", zlib.compress(b"1 2 m"), 1.0), (1, "c", zlib.compress(long), None), (2, "a", zlib.compress(b"1.23456 2 m"), 1.0), (3, "a", b"no stream", 1.0)]
    found = content.round_drawings(spark.createDataFrame(rows, "deck_id long, ref string, content binary, pixels_per_unit double")).collect()
    assert [(r["deck_id"], r["ref"]) for r in found] == [(1, "a")] and zlib.decompress(found[0]["content"]) == content.round_paths(long, 1.0)


def test_clarity_equals_a_plain_version():
    import numpy as np

    rng = random.Random(15)
    for case in range(6):
        h, w = rng.choice((16, 20, 33)), rng.choice((16, 24, 41))
        x = [[rng.randrange(256) if (i // 8 + j // 8) % 3 else 90 for j in range(w)] for i in range(h)]
        y = [[min(255, max(0, v + rng.randint(-40, 40) * (case > 0))) for v in row] for row in x]
        blocks = []
        for top in range(0, h - 7, 8):
            for left in range(0, w - 7, 8):
                a, b = ([m[i][j] for i in range(top, top + 8) for j in range(left, left + 8)] for m in (x, y))
                ma, mb = sum(a) / 64, sum(b) / 64
                va, vb, cov = sum(v * v for v in a) / 64 - ma * ma, sum(v * v for v in b) / 64 - mb * mb, sum(v * u for v, u in zip(a, b)) / 64 - ma * mb
                if va >= 16:
                    blocks.append(((2 * ma * mb + 6.5025) * (2 * cov + 58.5225) / ((ma * ma + mb * mb + 6.5025) * (va + vb + 58.5225)), va))
        total, worst, run = sum(v for _, v in blocks), [], 0.0
        for s, v in sorted(blocks, key=lambda b: b[0]):
            if run < total * 0.05:
                worst.append((s, v))
            run += v
        mean = lambda rows: sum(s * v for s, v in rows) / sum(v for _, v in rows)
        assert abs(pixels.clarity(np.array(x, np.uint8), np.array(y, np.uint8)) - (mean(blocks) + mean(worst)) / 2) < 1e-9
