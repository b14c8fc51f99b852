"""The pipeline's near-duplicate stage on edited copies, against brute force."""

import random

import corpus_pipeline
from test_near_passages import prose, runs


def test_edited_copies_are_grouped(spark, tmp_path):
    rng, rows, alike = random.Random(4), [], set()
    for i in range(60):
        p = prose(rng, rng.choice((60, 90, 200, 400)))
        q = list(p)
        for at in rng.sample(range(len(q)), max(1, len(q) // rng.choice((50, 100)))):
            q[at] = "changed"
        rows += [(i, " ".join(p), "x"), (100 + i, " ".join(q), "x")]
        if len(runs(p) & runs(q)) / len(runs(p) | runs(q)) >= 0.8:
            alike.add(100 + i)
    less = prose(rng, 60)  # 45 of 60 words alike are not enough
    rows += [(200, " ".join(less), "x"), (201, " ".join(less[:45] + prose(rng, 15)), "x"), (202, None, "x"), (203, " ", "x"), (204, "two words", "x"), (None, "Two  WORDS", "x"), (205, "two words", "x")]
    rows += [(300 + i, " ".join(less[i:] + prose(rng, i)), "x") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    found = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    kept = [r["doc_id"] for r in found.collect()]
    assert found.columns == docs.columns and len(kept) == len(set(kept))
    gone = {r[0] for r in rows} - set(kept)
    assert len(alike) >= 40 and len(gone & alike) >= 0.98 * len(alike)
    assert not {x for x in gone if x is not None and 100 <= x < 200} - alike
    assert set(range(60)) | {200, 201, 202, 204} <= set(kept) and {203, 205, None, 300, 301} <= gone
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_groups_of_unlike_copies_are_connected_like_by_brute_force(spark):

    from quirefold.llm.common import connected_components
    from quirefold.llm.nearcopies import near_links

    rng, texts = random.Random(6), []
    for _ in range(3):
        base = prose(rng, 150)
        for _ in range(120):
            q = list(base)
            for at in rng.sample(range(150), rng.randint(1, 8)):
                q[at] = prose(rng, 1)[0]
            texts.append(q)
    own = [runs(t) for t in texts]
    up = list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if len(own[i] & own[j]) >= 0.8 * len(own[i] | own[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "node long, text string")
    for block in (1 << 13, 25):
        found = {r["node"]: r["component"] for r in connected_components(near_links(df, block=block)).collect()}
        wrong = [i for i in range(len(texts)) if found.get(i, i) != top(i)]
        assert len(wrong) <= 2, wrong


def test_a_copy_less_alike_than_many_others_seem_is_linked(spark):
    from quirefold.llm.common import connected_components
    from quirefold.llm.nearcopies import near_links

    rng, texts = random.Random(9), []

    def changed(text, ends):
        q = list(text)
        for at in (rng.randint(10, 45), rng.randint(52, 88)):
            q[at] = prose(rng, 1)[0]
        return [*q[:-1], prose(rng, 1)[0]] if ends else q

    for _ in range(6):  # two texts alike, each with many others that are not quite
        x = prose(rng, 100)
        z = changed(x, False)
        texts += [x, z, *(changed(t, True) for t in (x, z) for _ in range(100))]
    assert all(len(runs(texts[i]) & runs(texts[i + 1])) >= 0.8 * len(runs(texts[i]) | runs(texts[i + 1])) for i in range(0, len(texts), 202))
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "node long, text string")
    found = {r["node"]: r["component"] for r in connected_components(near_links(df)).collect()}
    assert [i for i in range(0, len(texts), 202) if i not in found or found[i] != found.get(i + 1)] == []


def test_unlike_texts_of_one_group_are_compared_without_a_row_for_each_pair(spark, monkeypatch):
    from quirefold.llm import nearcopies
    from quirefold.llm.common import connected_components

    rng, texts, counts = random.Random(12), [], []
    base = prose(rng, 150)
    for i in range(300):  # with three far changes a text is 0.68 like any other, and 0.8 like the one before it in the pairs
        q = list(texts[-1] if i % 10 == 9 else base)
        for at in (rng.randint(140, 149),) if i % 10 == 9 else (rng.randint(10, 30), rng.randint(60, 80), rng.randint(110, 130)):
            q[at] = prose(rng, 1)[0]
        texts.append(q)
    own = [runs(t) for t in texts]
    alike = [(i, j) for i in range(300) for j in range(i) if len(own[i] & own[j]) >= 0.8 * len(own[i] | own[j])]
    keep = nearcopies.materialise

    def counted(df, name):
        out = keep(df, name)
        counts.append((out.count(), name))
        return out

    monkeypatch.setattr(nearcopies, "materialise", counted)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "node long, text string")
    wanted = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(alike, "a long, b long")).collect()}
    for block_bytes in (1 << 24, 1 << 15):
        links = nearcopies.near_links(df, block_bytes=block_bytes)
        found = {r["node"]: r["component"] for r in connected_components(links).collect()}
        assert found == wanted and len(wanted) >= 60
        assert max(counts) <= (24 * 300, "groups") and links.count() <= 600
        assert max(n for n, name in counts if name == "pairs") <= 10 * 300, counts
