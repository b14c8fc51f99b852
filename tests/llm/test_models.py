"""The two learned operators against plain versions of themselves, and the pipeline on odd and empty tables."""

import random
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quirefold.llm import langid, resampling

MASK = (1 << 64) - 1


def plain_weights(texts, targets):
    """Log weights with dictionaries and loops alone."""
    cells = []
    for text in texts:
        ids = [zlib.crc32(t) for w in (text or "").encode().lower().split() for t in re.findall(rb"[a-z0-9_\x80-\xff]+|[^a-z0-9_\x80-\xff]+", w)]
        grams = ids + [(a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F) & MASK for a, b in zip(ids, ids[1:])]
        cells.append([(g * 0xD6E8FEB86659FD93 & MASK) >> 49 for g in grams])
    raw, target = Counter(), Counter()
    for own, t in zip(cells, targets):
        raw.update(own)
        if t:
            target.update(own)
    n, m = sum(raw.values()) + 0.5 * (1 << 15), sum(target.values()) + 0.5 * (1 << 15)
    return [sum(np.log((target[c] + 0.5) / m) - np.log((raw[c] + 0.5) / n) for c in own) if target else 0.0 for own in cells]


def test_resampling_equals_a_plain_version(spark):
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdef") for _ in range(4)) for _ in range(60)]
    good, bad = words[:40], words[20:]
    rows = [(i, " ".join(rng.choice(good if i % 3 else bad) for _ in range(30))) for i in range(90)]
    rows += [(200, None), (201, ""), (202, " \t"), (None, rows[5][1]), (203, rows[7][1]), (203, rows[7][1]), (204, "Ärger's x-y " * 3000)]
    labels = {i: int(i % 3 != 0) for i in range(0, 90, 2)} | {204: 1}
    toxic = {4: 1}
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, quality int, __t int")
    known = spark.createDataFrame([(i, q, toxic.get(i, 0)) for i, q in labels.items()] + [(None, 1, 0), (7, None, 1)], "doc_id long, quality int, toxic int")
    told = plain_weights([t for _, t in rows], [labels.get(i) == 1 and not toxic.get(i) for i, _ in rows])
    hashed = {r[0]: r[1] & MASK for r in spark.createDataFrame([(i,) for i in {r[0] for r in rows}], "i long").select("i", F.xxhash64("i", F.lit(8))).collect()}
    noise = {i: -np.log(-np.log(((h >> 11) + 0.5) / (1 << 53))) for i, h in hashed.items()}
    for k in (1, 13, 40, len(rows), len(rows) + 5):
        found = resampling.resample(table, known, k).collect()
        assert len(found) == len(rows)
        got, want = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["log_weight"], r["key"]) for r in found), sorted((i if i is not None else -1, w, w + noise[i]) for (i, _), w in zip(rows, told))
        assert np.allclose(np.array(got, dtype=float), np.array(want, dtype=float), rtol=1e-9, atol=1e-7)
        chosen = sorted((r["key"] for r in found if r["selected"]), reverse=True)
        assert np.allclose(chosen, sorted((w + noise[i] for (i, _), w in zip(rows, told)), reverse=True)[:k], atol=1e-7)
    kept = resampling.keep_selected(table, known, 40)
    assert kept.columns == table.columns and 1 <= kept.count() <= 41


def plain_model(rows, names):
    """A linear model a name against the rest by many rounds of plain subgradient steps over dense vectors."""
    x = np.zeros((len(rows), langid.CELLS))
    for i, t in enumerate(rows):
        cells = langid.cells_of(t)
        for c in cells:
            x[i, c] += 1
        x[i] = np.sqrt(x[i]) / np.linalg.norm(np.sqrt(x[i]))
    out = {}
    for name in sorted(set(names)):
        y, w, b = np.where(np.array(names) == name, 1.0, -1.0), np.zeros(langid.CELLS), 0.0
        for step in range(1, 400):
            miss = y * (x @ w + b) < 1
            w += 0.5 / step**0.5 * ((y * miss) @ x / len(y) * 10 - 0.001 * w)
            b += 0.5 / step**0.5 * float((y * miss).mean())
        out[name] = (w, b)
    return out, x


def test_language_models_agree_with_plain_ones(spark):
    rng = random.Random(22)
    letters = {"en": "etaoinshrdlu", "de": "enisratdhulcg", "fr": "esaitnrulodcq", "xx": "kwzxyvjq", "yy": "mbpfgö"}
    rows = [(i, " ".join("".join(rng.choice(letters[n]) for _ in range(rng.randint(3, 8))) for _ in range(60)), n) for i, n in enumerate(sorted(letters) * 40)]
    df = spark.createDataFrame([*rows, (900, None, "en"), (901, "12 34", "de"), (902, "a b", None), (None, "no id", "fr"), *rows[:3]], "doc_id long, text string, lang string")
    model = langid.fit(df, per_language=30)
    assert sorted(n for own in model["languages"].values() for n in own) == sorted(letters) and set(model["families"]) == {"germanic", "romance", "xx", "yy"}
    plain, x = plain_model([t for _, t, _ in rows], [n for *_, n in rows])
    names = sorted(plain)
    told = [names[int(np.argmax([v @ w + b for w, b in map(plain.get, names)]))] for v in x]
    got = [langid.predict(t, model) for _, t, _ in rows]
    assert all(0 <= p <= 1 for _, p in got)
    assert sum(g == t for (g, _), t in zip(got, told)) >= 0.98 * len(rows) and sum(g == n for (g, _), (*_, n) in zip(got, rows)) >= 0.98 * len(rows)
    # A prediction is what its parts say: the family of the greatest margin, then the pairs of its languages.
    for t in [t for _, t, _ in rows[:20]]:
        v = np.zeros(langid.CELLS)
        for c, n in Counter(langid.cells_of(t).tolist()).items():
            v[c] = n**0.5
        v /= np.linalg.norm(v)
        margin = {k: float(v @ model["weights"][:-1, i] + model["weights"][-1, i]) for k, i in model["at"].items()}
        family = max(model["families"], key=lambda f: margin[f, ""])
        own = model["languages"][family]
        wins = Counter(a if margin[a, b] >= 0 else b for a, b in model["pairs"][family])
        assert langid.predict(t, model)[0] == (own[0] if len(own) == 1 else max(own, key=lambda n: wins[n]))


def test_every_language_is_learned(spark):
    rows = [(i * 70 + n, chr(97 + n % 26) * 3 + " " + chr(97 + n // 26) * 4 + " " + chr(98 + n % 20) * (2 + n % 5), f"l{n}") for i in range(3) for n in range(70)]
    df = spark.createDataFrame(rows + [(9000 + i, "very long " * 20_000, "l3") for i in range(2)], "doc_id long, text string, lang string")
    assert len(langid.fit(df, per_language=5)["families"]) == 70
    found = langid.identify_languages(df).collect()
    assert len(found) == len(rows) + 2


@pytest.mark.parametrize("rows", [0, 1])
def test_pipeline_on_odd_and_empty_tables(spark, tmp_path, rows):
    rng = random.Random(23)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(500)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [(i, prose(80), "en", f"s{i % 2}", 1) for i in range(20)]
    odd = [(30, None, None, None, None), (31, "", "en", "s0", 0), (32, " \n ", None, "s1", 3), (None, prose(60), "en", None, 4), (33, prose(30_000), "en", "s0", 5), (34, base[2][1], "en", "s1", 6), (35, prose(90), "en", "s1", 7), (35, prose(90), "en", "s1", 7)]
    odd += [odd[-1], odd[3]]
    clash = ", ".join(f"{c} int" for c in ("__t", "__d", "__k", "__spans", "node", "key", "size", "fp", "taken"))
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + clash
    spark.createDataFrame([(*r, *range(9)) for r in base + odd] if rows else [], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(0, 20, 2)] + [(None, 1, None), (3, None, 0)] if rows else [], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names, tokenizer = docs.columns, Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "packing":
            # Every id of every row that came in lies in one piece, with one more for its end.
            ids = [len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in before.collect()]
            assert (docs.agg(F.sum("length")).first()[0] or 0) == sum(ids)
            assert sum(r["doc_tokens"] for r in docs.where("start = 0").collect()) == sum(ids)
            continue
        assert docs.columns == names
        ids = [r["doc_id"] for r in docs.collect()]
        if name == "near_duplicates" and rows:
            assert len(ids) == len(set(ids)) or Counter(ids)[35] == 2
            assert 2 in ids and 34 not in ids and 30 in ids and not {31, 32} & set(ids) and 33 in ids and None in ids
        if name == "passages" and rows:
            assert set(range(20)) <= set(ids)
        if name == "mixing" and rows:
            assert not {30, 31, 32} & set(ids)
    assert (docs.count() > 0) == bool(rows)
