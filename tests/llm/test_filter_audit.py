"""Filter interactions against applying every order document by document."""

import re
from itertools import permutations

from quirefold.llm import filteraudit

DOCS = "doc_id long, text string, lang string, source string, mask int, part string, good int, first long"
LABELS = "doc_id long, quality int, toxic int, n string"


def rows_of():
    long = " ".join(f"w{k}" for k in range(230))
    texts = [long, long + " $", long.upper(), "a " * 250, "A " * 250 + "&", "short", "", None, " \t\r\n\x0b\x0c ", "é è " * 300, long, "x" * 5000 + " |", "Ab " * 3000, " ".join(["p q"] * 120), "short", long.replace("w1", "W1")]
    rows = [(k, t, ["en", "fr", None, ""][k % 4]) for k, t in enumerate(texts * 2)]
    return rows + [(3, texts[3], "en"), (None, long, "en"), (None, None, None), (-5, "short", "fr"), (0, long, "en")]


def plain(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    docs = []
    for i, t, lang in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows),
        }
        docs.append((lang or "", fails, i is not None and i in good, i is not None and i in toxic))
    out, shares = [], {}
    for part in {d[0] for d in docs}:
        for order in permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            whole = list(left)
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                shares[part, f] = shares.get((part, f), 0) + len(gone)
                failing = sum(d[1][f] for d in whole)
                out.append([part, "".join(order), step, len(left), len(gone), failing - len(gone), sum(d[1][f] and sum(d[1].values()) == 1 for d in whole), sum(d[2] for d in gone), sum(d[3] for d in gone), f])
    return sorted((*r[:-1], shares[r[0], r[-1]]) for r in out)


def test_equals_applying_every_order(spark):
    rows, labels = rows_of(), [(0, 1, 0), (0, 0, 1), (1, 1, None), (2, None, 1), (5, 1, 1), (7, 1, 0), (None, 1, 1), (99, 1, 1), (-5, 1, 0), (18, 0, 1)]
    docs = spark.createDataFrame([(*r, "s", 3, "clash", 9, 9) for r in rows], DOCS)
    said = spark.createDataFrame([(*r, "clash") for r in labels], LABELS)
    found = filteraudit.audit_filters(docs, said)
    assert found.dtypes == [("part", "string"), ("filter_order", "string"), ("step", "int")] + [(c, "bigint") for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")]
    assert sorted(map(tuple, found.collect())) == plain(rows, labels)
    assert sorted(map(tuple, filteraudit.audit_filters(docs, said.limit(0)).collect())) == plain(rows, [])
    assert filteraudit.audit_filters(docs.limit(0), said).count() == 0


def test_other_filters(spark):
    masks = spark.createDataFrame([("p", m, m % 2, 0) for m in (0, 1, 2, 3, 3, 4, 7)] + [(None, 0, 1, 1)], "part string, mask int, good int, toxic int")
    found = {(r["part"], r["filter_order"], r["step"]): r for r in filteraudit.order_audit(masks, "XYZ").collect()}
    assert len(found) == 2 * 6 * 3
    first, second, third = (found["p", "YXZ", s] for s in (1, 2, 3))
    assert (first["kept"], first["removed"], first["good_lost"]) == (3, 4, 3) and (second["kept"], second["removed"], second["redundant"]) == (2, 1, 3) and (third["kept"], third["removed"]) == (1, 1)
    assert first["shapley"] == sum(found["p", o, 1 + o.index("Y")]["removed"] for o in map("".join, permutations("XYZ")))
    assert all(found[None, o, s]["kept"] == 1 for o in ("XYZ", "ZYX") for s in (1, 2, 3))
