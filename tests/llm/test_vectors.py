"""Near-duplicate vectors and vector codes against brute force, with nulls, ties, repeats, ragged lengths, empty tables and foreign columns."""

import hashlib
from fractions import Fraction
from math import floor

import numpy as np
import pytest

from quirefold.llm import vectorcodes, vectordups

KIND = "vec_id long, embedding array<float>, label int, node string, q int"


def odd_vectors(seed, n, dim=16, label=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    for k in range(0, n - 2, 5):  # near copies, on both sides of the threshold, in chains
        x[k + 1] = x[k] + rng.normal(size=dim) * rng.choice([0.02, 0.1, 0.18, 0.2])
        x[k + 2] = x[k + 1] * 3
    return [(k, [float(v) for v in x[k]], label if k % 7 else label + 1) for k in range(n)]


ODD = [
    (900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [None] + [1.0] * 15, 1), (904, [float("nan")] + [1.0] * 15, 1), (905, [float("inf")] + [1.0] * 15, 1),
    (906, [1.0] * 16, None), (907, [1.0] * 16, 1), (908, [1.0] * 16, 1), (908, [1.0] * 16, 1), (908, [-1.0] * 16, 1), (None, [1.0] * 16, 1), (None, [0.5, -1.0] * 8, 1), (None, None, 1),
    (909, [1.0, 2.0], 1), (910, [2.0, 4.0], 1), (911, [0.0] + [1.0] * 15, 1), (912, [-0.0] + [1.0] * 15, 1), (913, [1e-30] * 16, 1), (914, [1e30] * 16, 1), (None, [3.0] * 16, None),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 7) for r in rows], KIND)


def plain_links(rows, threshold=0.98):
    """n_links, component_id and kept of each row, in the order of the rows."""
    fine = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(np.float32(c)) for c in v) and any(c != 0 for c in v) and label is not None for _, v, label in rows]
    unit = [np.array(v, dtype=np.float32).astype(float) if ok else None for ok, (_, v, _) in zip(fine, rows)]
    unit = [None if u is None else (u / np.abs(u).max()) / np.linalg.norm(u / np.abs(u).max()) for u in unit]
    near = {i: [j for j in range(len(rows)) if j != i and fine[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold] if fine[i] else [] for i in range(len(rows))}
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(near[i]), least, rows[i][0] == least))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [vectordups.BLOCK, 40, 7])
def test_links_equal_brute_force(spark, block, monkeypatch):
    rows = odd_vectors(1, 160) + ODD
    found = vectordups.near_duplicate_vectors(frame(spark, rows), block=block)
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, found.collect()), key=str) == plain_links(rows)


def test_large_group_and_empty_table(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=64)
    rows = [(k, [float(v) for v in np.float32(base + rng.normal(size=64) * 0.05)], 3) for k in range(700)] + [(k, [float(v) for v in np.float32(base)], 3) for k in range(700, 900)]
    assert sorted(map(tuple, vectordups.near_duplicate_vectors(frame(spark, rows), block=300).collect()), key=str) == plain_links(rows)
    assert vectordups.near_duplicate_vectors(frame(spark, [])).count() == 0
    assert vectordups.near_duplicate_vectors(frame(spark, [(1, None, 1), (2, [0.0], 2)])).orderBy("vec_id").collect() == [(1, 0, 1, True), (2, 0, 2, True)]


@pytest.mark.parametrize("dim", [3, 64, 2500])
def test_bounds_hold(dim):
    """No product is further off than the bound says, and int8 products are exact whatever the length."""
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(60, dim)) * rng.choice([1e-12, 1.0, 1e12], size=(60, 1)) * np.exp(rng.normal(size=(60, dim)) * 2)
    u = vectordups.units(x)
    q, unit, left = vectordups.quantised(u)
    exact = vectordups.products(q, q)
    assert (exact == q.astype(np.int64) @ q.astype(np.int64).T).all()
    off = np.abs(u @ u.T - exact * unit[:, None] * unit[None, :])
    assert (off <= left[:, None] + left[None, :] + left[:, None] * left[None, :]).all()
    full = np.full((1, dim), 127, dtype=np.int8)
    assert vectordups.products(full, full)[0, 0] == 127 * 127 * dim


def plain_codes(rows, entries, rounds=4, scale=1024, parts=4):
    """vec_id, code, error, label_error, digest with whole numbers of any size."""
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(c is not None and np.isfinite(np.float32(c)) and abs(np.float32(c)) < 1e20 for c in v)]
    whole = [[floor(Fraction(float(np.float32(c))) * scale) for c in v] for _, v, _ in kept]
    out = []
    for dim in {len(v) for v in whole}:
        mine = [k for k in range(len(kept)) if len(whole[k]) == dim]
        cut = [dim // parts * p + min(p, dim % parts) for p in range(parts + 1)]
        part = lambda k, p: whole[k][cut[p] : cut[p + 1]]  # noqa: E731, B023
        start = sorted(mine, key=lambda k: (kept[k][0] is None, kept[k][0], whole[k]))[:entries]
        books = [[part(k, p) for k in start] for p in range(parts)]

        def near(k, p):
            return min((sum((a - b) ** 2 for a, b in zip(part(k, p), e)), n) for n, e in enumerate(books[p]))  # noqa: B023

        for _ in range(rounds):
            own = [[near(k, p)[1] for k in mine] for p in range(parts)]
            for p in range(parts):
                books[p] = [[sum(c) // len(hit) for c in zip(*hit)] if (hit := [part(k, p) for k, n in zip(mine, own[p]) if n == e]) else old for e, old in enumerate(books[p])]
        sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
        for k in mine:
            best = [near(k, p) for p in range(parts)]
            out.append([kept[k][0], "".join(f"{n:02x}" for _, n in best), sum(d for d, _ in best), kept[k][2], sha])
    total = {}
    for r in out:
        total[r[3]] = total.get(r[3], 0) + r[2]
    return sorted([(i, code, error, total[label], sha) for i, code, error, label, sha in out], key=str)


@pytest.mark.parametrize("entries", [256, 9])
def test_codes_equal_brute_force(spark, entries):
    rows = odd_vectors(2, 60) + [r for r in ODD if r[0] is not None or r[1] is None or r[1][0] != 3.0] + [(950 + k, [0.25] * 15 + [k % 2 / 8], None) for k in range(6)]
    found = vectorcodes.compress_vectors(frame(spark, rows), entries=entries)
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == plain_codes(rows, entries)


def test_codes_of_lengths_that_do_not_divide_and_of_nothing(spark):
    rows = [(k, [float(k * j % 5) for j in range(k % 7)], k % 2) for k in range(40)]
    assert sorted(map(tuple, vectorcodes.compress_vectors(frame(spark, rows), entries=3).collect()), key=str) == plain_codes(rows, 3)
    assert vectorcodes.compress_vectors(frame(spark, [])).count() == 0
    assert vectorcodes.compress_vectors(frame(spark, [(1, None, 1), (2, [float("nan")], 1), (3, [1e20], 1)])).count() == 0


def test_partial_distances_find_the_first_nearest():
    rng = np.random.default_rng(7)
    for dim, k in ((1, 1), (3, 5), (16, 256), (40, 256)):
        x, book = rng.integers(-4, 4, size=(300, dim)), rng.integers(-4, 4, size=(k, dim))
        entry, distance = vectorcodes.nearest_entries(x, book, vectorcodes.falling_variance(book))
        full = ((x[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
        assert (entry == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()
