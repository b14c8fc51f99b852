"""The corpus operators against brute force, on small fixtures with nulls, ties, repeats, empty tables and foreign columns."""

import os
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from helpers import compare
from pyspark.sql import functions as F

from quirefold.llm import ann, common, hamming, langid, licences, mixing, packing, passages, resampling, simhash, warc
from quirefold.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def words():
    rng = random.Random(1)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]


def prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def odd_documents(words):
    """Nulls in any column, empty and blank texts, a long text, ties and repeated rows."""
    rng = random.Random(2)
    base = [prose(rng, words, 120) for _ in range(12)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(base)]
    rows += [(20, None, None, None, None), (21, "", "en", "s0", 0), (22, " \n\t ", "en", "s0", 4), (None, base[3], "en", None, 5), (23, base[3], None, "s1", 5), (23, base[3], None, "s1", 5)]
    near = base[5].split()
    near[60] = "changed"
    rows += [(24, " ".join(near), "en", "s2", 1), (25, prose(rng, words, 20_000), "en", "s2", 1), (26, base[7].upper(), "en", "s2", 1), (27, "x", "en", "s2", 1), (28, "same " * 3000, "en", "s2", 1)]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 7) for r in rows], DOCS + ", fp string, component long")


def test_sql_where_there_is_some(spark):
    for name, sql in ORACLES.items():
        compare(QUERIES[name], sql, spark, SF)


def union(pairs, nodes):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(150)] + [(7, 7), (500, i := 501), (i, 500)]
    found = common.connected_components(spark.createDataFrame([*edges, (None, 1)], "a long, b long"))
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    assert {r["node"]: r["component"] for r in found.collect()} == union([e for e in edges if e[0] != e[1]], nodes)
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_kth_largest(spark):
    values = [5, 9, 9, 9, 1 << 40, 0, 3]
    df = spark.createDataFrame([(v,) for v in values], "k long")
    for k in (1, 2, 5, 6, 7):  # the edge of equal values is met at their last
        low = common.kth_largest(df, ["k"], k)
        assert sum((v,) >= tuple(low) for v in values) == (4 if k == 2 else k)
    assert common.kth_largest(df, ["k"], 8) is None
    two = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "k long, i long")
    for k in range(1, 8):
        edge = common.kth_largest(two, ["k", "i"], k)
        top = sorted(((v, i) for i, v in enumerate(values)), reverse=True)[:k]
        assert sorted(map(tuple, two.where(common.no_smaller(["k", "i"], edge)).collect()), reverse=True) == top


def slow_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


@pytest.mark.parametrize("block", [1 << 20, 3])
def test_simhash_equals_brute_force(spark, words, block):
    rows = odd_documents(words)
    fps = [slow_fingerprint(r[1]) for r in rows]
    distinct = sorted(set(fps))
    label = union([(a, b) for i, a in enumerate(distinct) for b in distinct[:i] if (a ^ b).bit_count() <= 3], distinct)
    least = {}
    for r, f in zip(rows, fps, strict=True):
        if r[0] is not None:
            least[label[f]] = min(least.get(label[f], 1 << 60), r[0])
    expected = Counter((r[0], f, least.get(label[f])) for r, f in zip(rows, fps, strict=True))
    found = simhash.simhash_components(table(spark, rows), block=block)
    assert Counter((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in found.collect()) == expected
    assert simhash.simhash_components(table(spark, [])).count() == 0


def test_simhash_links_dense_and_crowded_fingerprints(spark):
    rng = random.Random(4)
    centre = [rng.getrandbits(64) for _ in range(4)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centre for _ in range(150)} | {(0xABCD << 48) | rng.getrandbits(48) for _ in range(300)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    n, both = simhash.bit_counts(df)
    assert n == len(fps)
    label = union([(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3], signed)
    expected = Counter(Counter(label.values()).values())
    for parts, block in ((None, 1 << 20), (3, 1 << 20), (None, 20)):
        found = common.connected_components(simhash.fingerprint_links(df, n, both, parts=parts, block=block)).collect()
        got = {r["node"]: r["component"] for r in found}
        assert Counter(Counter(got.get(f, f) for f in signed).values()) == expected
        assert all(got.get(a, a) == got.get(b, b) for a, b in label.items())


def test_keep_one(spark, words):
    rows = odd_documents(words)
    kept = simhash.keep_one(table(spark, rows))
    assert kept.columns == table(spark, rows).columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 3 in ids and 23 not in ids and None not in ids and len(ids) == len(set(ids))
    assert 26 not in ids and 7 in ids


def test_passages_equal_brute_force(spark, words):
    rng = random.Random(6)
    many = [f"{w}{i}" for i in range(40) for w in words]  # so many that texts share no word by chance where a passage ends
    shared = [prose(rng, many, n) for n in (50, 60, 90, 49)]
    rows = []
    for i in range(60):
        t = [prose(rng, many, rng.randint(5, 120))]
        for s in rng.sample(shared, rng.randint(0, 2)):
            t += [s, prose(rng, many, rng.randint(1, 60))]
        rows.append((i, "\n".join(t), "en", "s", 1))
    # The document with the smallest id has less of a passage than two others share.
    for at, n in ((200, 45), (210, 45)):
        p = prose(rng, many, 65).split()
        part = p[:n] if at == 200 else p[-n:]
        rows += [(at, " ".join([prose(rng, many, 20), *part, prose(rng, many, 20)]), "en", "s", 1)]
        rows += [(at + k, " ".join([prose(rng, many, 20), *p, prose(rng, many, 20)]), "en", "s", 1) for k in (1, 2, 3)]
    rows += odd_documents(words)[12:] and [(100 + (r[0] or 0) if r[0] is not None else None, *r[1:]) for r in odd_documents(words)]
    split = {}
    for r in rows:
        if r[0] is not None and r[1] is not None:
            split.setdefault(r[0], r[1].encode().lower().split())
    first, need = {}, defaultdict(set)
    for i in sorted(split):
        for a in range(len(split[i]) - 49):
            k = tuple(split[i][a : a + 50])
            if first.setdefault(k, i) != i:
                need[i].update(range(a, a + 50))
    found = passages.duplicate_passages(table(spark, rows)).collect()
    cover = defaultdict(set)
    for r in found:
        cover[r["doc_id"]].update(range(r["start_word"], r["start_word"] + r["n_words"]))
        a = split[r["doc_id"]][r["start_word"] : r["start_word"] + r["n_words"]]
        b = split[r["source_doc_id"]][r["source_start"] : r["source_start"] + r["source_words"]]
        x, y = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a, b))
        assert len(a) == r["n_words"] >= 50 <= len(b) and r["source_doc_id"] < r["doc_id"]
        assert abs(len(x & y) / len(x | y) - r["similarity"]) < 1e-9 and r["similarity"] >= 0.8
    assert not [i for i in need if need[i] - cover[i]]
    assert {124} <= set(cover)  # one changed word
    assert passages.duplicate_passages(table(spark, [])).count() == 0


def test_cut_passages(spark, words):
    rng = random.Random(7)
    p, tail = prose(rng, words, 60), prose(rng, words, 30)
    rows = [(1, p, "en", "s", 1), (2, f"Head.  \n{p}  {tail}", "en", "s", 1), (3, p, "en", "s", 1), (4, None, "en", "s", 0), (5, "", "en", "s", 0)]
    found = {r["doc_id"]: (r["text"], r["n_chars"]) for r in passages.cut_passages(table(spark, rows)).collect()}
    assert found[1][0] == p and 3 not in found and found[4][0] is None and found[5][0] == ""
    assert found[2] == (f"Head.  \n{tail}", len(f"Head.  \n{tail}"))


def test_compact_windows_are_the_cartesian_tree():
    rng = np.random.default_rng(8)
    for n, least in ((1, 1), (40, 5), (60, 1), (30, 31)):
        tokens = rng.integers(0, 12, n).astype(np.uint64)
        found = sorted(zip(*(x.tolist() for x in passages.compact_windows(tokens, np.array([0]), np.array([n]), least, 0)), strict=True))
        rank = common.mix(tokens ^ np.uint64(0x9E3779B97F4A7C15)) & ~np.uint64((1 << 28) - 1)
        for i in range(n):
            for j in range(i + least - 1, n):
                holds = [(l, c, r) for l, c, r in found if l <= i <= c <= j <= r]
                assert len(holds) == 1 and rank[holds[0][1]] == rank[i : j + 1].min()


def test_nearest(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(6, 16))
    x = centres[rng.integers(0, 6, 900)] + 0.5 * rng.normal(size=(900, 16))
    x[100:160] = x[100]
    rows = [(i, v.tolist(), "clash") for i, v in enumerate(x)] + [(1000, None, ""), (1100, [0.0] * 16, ""), (1200, [float("nan")] * 16, ""), (1300, [None] * 16, ""), (1400, [], ""), (None, x[0].tolist(), ""), (5, x[5].tolist(), "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    for slice_rows in (1 << 16, 20):
        found = defaultdict(list)
        for r in ann.nearest(df, df.where("vec_id % 100 = 0"), slice_rows=slice_rows).orderBy("query_id", "rank").collect():
            found[r["query_id"]].append((r["vec_id"], r["score"]))
        assert sorted(found) == list(range(0, 900, 100))
        hit = 0
        for q, got in found.items():
            d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
            d[q] = np.inf
            best = np.lexsort((np.arange(900), d))[:10].tolist()
            assert all(d[v] == s for v, s in got) and [v for v, _ in got] == sorted((v for v, _ in got), key=lambda v: (d[v], v))
            hit += len(set(best) & {v for v, _ in got})
        assert hit >= 0.9 * 90
        assert [v for v, _ in found[100]] == list(range(101, 111))
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


@pytest.mark.parametrize("hashes", [1, 2, 3])
def test_nearest_reaches_its_recall_with_any_number_of_hashes(spark, hashes):
    rng = np.random.default_rng(19)
    x = rng.normal(size=(4, 32))[rng.integers(0, 4, 1200)] + 0.7 * rng.normal(size=(1200, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    hit = 0
    for r in ann.nearest(df, df.where("vec_id % 20 = 0"), hashes=hashes).groupBy("query_id").agg(F.collect_set("vec_id").alias("v")).collect():
        d = ((x - x[r["query_id"]]) ** 2).sum(axis=1)
        d[r["query_id"]] = np.inf
        hit += len(set(np.argsort(d)[:10].tolist()) & set(r["v"]))
    assert hit >= 0.9 * 600


def test_nearest_returns_all_that_is_owed(spark):
    rng = np.random.default_rng(20)
    for n in (1, 5, 11, 12, 30):
        x = {i: rng.normal(size=64 if i % 3 else 7) * 10.0 ** rng.integers(-3, 4) for i in range(n)}
        df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in x.items()], "vec_id long, embedding array<double>, qid int")
        found = defaultdict(list)
        for r in ann.nearest(df, df, block=4).orderBy("query_id", "rank").collect():
            found[r["query_id"]].append((r["vec_id"], r["score"]))
        for q, v in x.items():
            told = sorted((float(np.sqrt(((w - v) ** 2).sum())), i) for i, w in x.items() if i != q and len(w) == len(v))[:10]
            assert len(found[q]) == len(told)
            if len(told) < 10:
                assert found[q] == [(i, s) for s, i in told]


def test_hamming(spark):
    rng = random.Random(10)
    codes = [rng.getrandbits(64) for _ in range(300)]
    codes += [codes[0] ^ (1 << rng.randrange(64)) for _ in range(30)] + [codes[1]] * 40 + [0, (1 << 64) - 1]
    rows = [(i, c - (1 << 64) if c >> 63 else c) for i, c in enumerate(codes)]
    df = spark.createDataFrame([*rows, (None, 3), (999, None), (7, rows[7][1])], "id long, code long")
    found = defaultdict(list)
    for r in hamming.search(df, df.where("id % 20 = 0")).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["distance"], r["vec_id"]))
    for q in range(0, len(codes), 20):
        assert found[q] == sorted(((codes[q] ^ c).bit_count(), i) for i, c in enumerate(codes) if i != q)[:10]
    few = spark.createDataFrame(rows[:3], "id long, code long")
    assert hamming.search(few, few).count() == 6
    long = [(i, [rng.gauss(0, 1) for _ in range(150)]) for i in range(120)] + [(200, [1.0] * 40), (201, None), (202, [None] * 150)]
    long += [(300 + i, [-x if j == i else x for j, x in enumerate(long[7][1])]) for i in range(5)]
    codes = hamming.sign_codes(spark.createDataFrame(long, "vec_id long, embedding array<double>"))
    found = defaultdict(list)
    for r in hamming.search(codes, codes).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["distance"], r["vec_id"]))
    signs = {i: [v[j] > 0 if j < len(v) else False for j in range(192)] for i, v in long if v and v[0] is not None}
    for q, s in signs.items():
        assert found[q] == sorted((sum(a != b for a, b in zip(s, t)), i) for i, t in signs.items() if i != q)[:10]
    assert hamming.search(df.limit(0), df.limit(0)).count() == 0


def test_common_code_is_answered_whole(spark):
    asked = [(i, 7 if i % 4 else 100 + i) for i in range(2000)]
    found = [(7, 0, 1), (7, 0, 2), (7, 3, 900), *((100 + i, 1, i + 1) for i in range(0, 2000, 4))]
    got = hamming.answered(spark.createDataFrame(asked, "id long, code long"), spark.createDataFrame(found, "q long, distance int, vec_id long"))
    told = sorted((i, d, v) for i, c in asked for q, d, v in (found[:3] if c == 7 else [(c, 1, i + 1)]))
    assert sorted(map(tuple, got.collect())) == told


def test_packing(spark, words):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(path("word_bpe_49k.json"))
    rows = odd_documents(words) + [(40, "a<|endoftext|>B <|ENDOFTEXT|> I'm É́ 12", "en", "s", 1)]
    ids = [np.array([*encode.encode(r[1] or "", add_special_tokens=False).ids, 1], dtype="<u4") for r in rows]
    for group in (packing.GROUP_TOKENS, 3000):
        found = packing.pack_documents(table(spark, rows), group_tokens=group, with_ids=True).collect()
        by_row, by_sequence = defaultdict(list), defaultdict(list)
        for r in found:
            assert zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] > 0
            by_row[r["doc_id"], r["doc_tokens"]].append((r["start"], r["ids"]))
            by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        expected = Counter((r[0], i.tobytes()) for r, i in zip(rows, ids, strict=True))
        got = Counter()
        for (doc, n), pieces in by_row.items():
            copies = sum(len(p) for _, p in pieces) // n
            for k in range(copies):
                own = sorted(pieces)[k::copies]
                got[doc, np.array([x for _, p in own for x in p], dtype="<u4").tobytes()] += 1
        assert got == expected
        for pieces in by_sequence.values():
            at = 0
            for offset, n in sorted(pieces):
                assert offset == at
                at += n
            assert at == 2048 or at < 2048 and at & (at - 1) == 0
    assert packing.pack_documents(table(spark, [])).count() == 0


def test_encoder_that_forgets_gives_the_same_ids():
    from public_tokenizers import path
    from tokenizers import Tokenizer

    rng = random.Random(24)
    small, plain = packing.WordEncoder(path("word_bpe_49k.json"), 40), Tokenizer.from_file(path("word_bpe_49k.json"))
    texts = [" ".join(rng.choice(("the", "of", "and")) if rng.random() < 0.5 else f"w{rng.randrange(300)}x" for _ in range(50)) for _ in range(200)]
    for at in range(0, 200, 7):
        for text, ids in zip(texts[at : at + 7], small.ids([t.encode() for t in texts[at : at + 7]])):
            assert ids.tolist() == [*plain.encode(text, add_special_tokens=False).ids, 1]
    assert b"the" in small and small[b"the"] <= 20


def test_closest_fill():
    rng = random.Random(11)
    for _ in range(200):
        counts = {rng.randint(1, 40): rng.randint(1, 3) for _ in range(rng.randint(1, 6))}
        room = rng.randint(0, 80)
        sums = {0}
        for x, n in counts.items():
            sums = {s + k * x for s in sums for k in range(n + 1) if s + k * x <= room}
        used = packing.closest_fill(counts, room)
        assert sum(x * n for x, n in used) == max(sums) and all(n <= counts[x] for x, n in used)


def test_warc(spark, tmp_path):
    big, other = "<p>é</p>" * 200, "<b>x</b>" * 300
    rows = [(1, "http://a/\r\nX: y", big, "c"), (2, None, big, "c"), (3, "http://c", big, "c"), (4, "http://d", other, "c"), (5, "u", "short", "c"), (6, "u", "short", "c"), (7, "u", None, "c"), (8, "u", "", "c"), (None, "n", other, "c"), (3, "http://c", big, "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)
    folder = f"file://{tmp_path}/w"
    index = warc.write_archives(df, folder)
    found = warc.read_records(spark, folder, index).collect()
    kinds = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in found)
    assert kinds == Counter({(1, "revisit", 3): 1, (2, "revisit", 3): 1, (3, "response", None): 2, (4, "response", None): 1, (5, "response", None): 1, (6, "response", None): 1, (7, "response", None): 1, (8, "response", None): 1, (None, "revisit", 4): 1})
    assert all(r["payload"].decode() == big for r in found if r["page_id"] == 3) and {r["payload_bytes"] for r in found if r["page_id"] in (1, 2)} == {len(big.encode())}
    apart = warc.write_archives(df, folder + "2", most_broadcast=0)
    names = ["page_id", "url", "payload_digest", "record_type", "refers_to", "payload_bytes"]
    assert Counter(map(tuple, apart.select(names).collect())) == Counter(map(tuple, index.select(names).collect()))
    long = spark.createDataFrame([(1, "u", "é<br>" * 400_000), (2, "v", "é<br>" * 400_000)], "page_id long, url string, html string")
    assert sorted((r["page_id"], r["record_type"], r["payload_bytes"]) for r in warc.round_trip(long).collect()) == [(1, "revisit", 2_400_000), (2, "response", 2_400_000)]
    some = warc.read_records(spark, folder, index.where("page_id = 4")).collect()
    assert [r["payload"].decode() for r in some] == [other]
    assert warc.round_trip(df.limit(0)).count() == 0
    assert warc.coalesced([(0, 5), (5, 5), (100, 1)], gap=10, span=50) == [(0, 10, 0, 1), (100, 101, 2, 2)]


def test_resampling(spark, words):
    rng = random.Random(12)
    rows = [(i, prose(rng, words, 80) if i % 4 else " ".join(w + "###" for w in prose(rng, words, 80).split()), "en", "s", 1) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(0, 200, 3)] + [(None, 1, 0), (9, None, None)], "doc_id long, quality int, toxic int")
    docs = table(spark, rows + odd_documents(words)[12:])
    found = {(r["doc_id"], r["selected"]) for r in resampling.resample(docs, labels).collect()}
    assert all(((i, i % 4 != 0) in found) for i in range(200) if i not in range(20, 29))
    ten = resampling.resample(docs, labels, k=10).collect()
    top = sorted((r["key"] for r in ten), reverse=True)[:10]
    assert sorted((r["key"] for r in ten if r["selected"]), reverse=True) == top
    marks = ["doc_id", "quality", "target"]
    assert Counter(map(tuple, resampling.marked(docs, labels, most_broadcast=0).select(marks).collect())) == Counter(map(tuple, resampling.marked(docs, labels).select(marks).collect()))
    none = resampling.keep_selected(docs, labels.limit(0))
    assert none.count() == docs.count() and none.columns == docs.columns
    assert resampling.resample(docs.limit(0), labels).count() == 0


def test_mixing(spark, words):
    rows = odd_documents(words)
    found = mixing.mix_takes(table(spark, rows), range_rows=2).collect()
    assert len(found) == len(rows)
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in found:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    for s, n in taken.items():
        assert n == int(target[s]) and target[s] <= 2 * size[s]
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6
    again = mixing.mix_takes(table(spark, rows).repartition(5), range_rows=1000).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, found))
    clash = table(spark, rows).withColumns({c: F.lit(1) for c in ("__t", "__n", "__size", "size", "taken", "target")})
    mixed = mixing.mixed_documents(clash)
    assert mixed.columns == clash.columns
    words_of = defaultdict(int)
    for r in mixed.collect():
        words_of[r["source"]] += len(r["text"].split())
    assert words_of == {s: n for s, n in taken.items() if n}
    four = spark.createDataFrame([(1, "a b c d e f g h i", "s")] * 4 + [(2, "x y", "s")], "doc_id long, text string, source string")
    assert sum(len(r["text"].split()) for r in mixing.mixed_documents(four).collect()) == sum(r["taken"] for r in mixing.mix_takes(four).collect()) == 57
    assert mixing.mix_takes(table(spark, [])).count() == 0


def test_language_id(spark):
    con = duckdb.connect()
    lang = dict(con.sql(f"SELECT doc_id, lang FROM '{SF}/documents.parquet'").fetchall())
    found = QUERIES["op10_language_id"](spark, SF).collect()
    held = [r for r in found if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in found)
    assert sum(lang[r["doc_id"]] == r["lang_pred"] for r in held) > 0.97 * len(held)
    odd = spark.createDataFrame([(1, None, "en", 1), (2, "123 !?", "en", 1), (3, "the and of", "en", 1), (None, "le la les", "fr", 1), (5, "", None, 1)], "doc_id long, text string, lang string, score int")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify_languages(odd).collect()}
    assert got[1] == got[2] == got[5] == "und" and got[3] in ("en", "fr")
    assert langid.identify_languages(odd.limit(0)).count() == 0


def test_language_sample_is_that_of_a_plain_ranking(spark):
    rows = [(i, "some text" if i % 7 else "123", "en" if i % 10 else "fr") for i in range(5000)] + [(None, "no id", "en"), (3, None, "de"), (4, "none", None)]
    rows += [(5, "some text", "en")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    hashes = {r[0]: r[1] for r in df.select("doc_id", F.xxhash64("doc_id")).where("doc_id IS NOT NULL").collect()}
    told = []
    for lang in ("en", "fr"):
        own = sorted({(hashes[i], i) for i, t, n in rows if i is not None and n == lang and t == "some text"})
        told += [(lang, i) for _, i in own[:40]]
    assert sorted((r["lang"], r["doc_id"]) for r in langid.sample_rows(df, 40).collect()) == sorted(told)


def test_licences(spark):
    text = "Copyright (c) 1999 Some One\n\n" + licences.MIT.upper().replace(", ", ",\n   ") + "\n"
    rows = [(1, text, "c"), (2, "Some prose.\nreleased under the  MIT Licence!\nMore.", "c"), (3, None, "c"), (4, "", "c"), (5, "prose " * 50_000, "c"), (5, "x", "c"), (5, "x", "c")]
    found = [tuple(r)[0:1] + tuple(r)[2:] for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string, license_id string")).collect()]
    assert Counter(found) == Counter({(1, "MIT", ""): 1, (2, None, "MIT"): 1, (3, None, ""): 1, (4, None, ""): 1, (5, None, ""): 3})
    one_line = f"Copyright (c) 2020 J. R. Doe, Some Firm Inc. All rights reserved. {licences.BSD_3} {licences.BSD_DISCLAIMER}"
    rows = [(1, "BSD 3-Clause License\n\nCopyright 2020, A B\nCopyright 2021, C\nAll Rights Reserved\n" + licences.BSD_3 + "\n" + licences.BSD_DISCLAIMER), (2, one_line), (3, "The MIT License (MIT)\n\nCopyright © 2001 X\n\n" + licences.MIT), (4, licences.BSD_2 + licences.BSD_DISCLAIMER)]
    rows += [(5, "Copyright is a right that authors have. It is granted by law in most of the countries of the world, and this line of prose stays but for its first sentence.")]
    rows += [(10 + i, open(f"/usr/share/common-licenses/{f}", encoding="utf-8").read()) for i, f in enumerate(("Apache-2.0", "GPL-3", "MPL-2.0")) if os.path.exists(f"/usr/share/common-licenses/{f}")]
    got = {r["doc_id"]: (r["license_id"], r["text_digest"]) for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    empty = "d41d8cd98f00b204e9800998ecf8427e"
    assert [got[i][0] for i in (1, 2, 3, 4, 5)] == ["BSD-3-Clause", "BSD-3-Clause", "MIT", "BSD-2-Clause", None] and got[5][1] != empty
    assert [got[10 + i][0] for i in range(3) if 10 + i in got] == ["Apache-2.0", "GPL-3.0", "MPL-2.0"][: len(got) - 5]
    with pytest.raises(ValueError):
        licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string"), {"X": [str(i) for i in range(licences.MOST_KNOWN)]})


def test_pipeline_decisions(spark, words, tmp_path):
    import corpus_pipeline

    rng = random.Random(13)
    passage = prose(rng, words, 70)
    rows = [(i, prose(rng, words, 150), "en", f"s{i % 2}", 1) for i in range(40)]
    rows += [(50, rows[3][1], "en", "s0", 1), (51, prose(rng, words, 20) + " " + passage, "en", "s0", 1), (52, passage + " " + prose(rng, words, 20), "en", "s0", 1)]
    rows += [(60 + i, " ".join(w + "$$$" for w in prose(rng, words, 100).split()), "en", "s1", 1) for i in range(6)]
    table(spark, rows).drop("fp", "component").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(0, 40, 2)] + [(60 + i, 0, 0) for i in range(0, 6, 2)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append({r["doc_id"] for r in docs.collect()})
        assert name == "packing" or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert not kept[0] & set(range(60, 66)) and set(range(40)) <= kept[0]
    assert kept[1] == kept[0] - {50} and kept[2] == kept[1]
    cut = {r["doc_id"]: r["text"] for r in spark.read.parquet(str(tmp_path / "passages")).collect()}
    assert passage in cut[51] and passage not in cut[52] and len(cut[52].split()) == 20
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
