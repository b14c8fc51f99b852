"""Versions of pages against a plain loop over each page."""

import numpy as np
from pyspark.sql import functions as F

from quirefold.operators import pageversions
from quirefold.operators.pageversions import Rung
from quirefold.sources import synthetic

RUNGS = [Rung(200, 0.95), Rung(64, 0.95), Rung(64, 0.6), Rung(40, 0.5), Rung(20, 0.1), Rung(10, 0.1)]


def block_clarity(a, b):
    """Similarity of 8 by 8 blocks with detail, weighted by it, averaged with the worst twentieth."""
    found = []
    for y in range(0, a.shape[0] // 8 * 8, 8):
        for x in range(0, a.shape[1] // 8 * 8, 8):
            p, q = a[y : y + 8, x : x + 8].astype(float).ravel(), b[y : y + 8, x : x + 8].astype(float).ravel()
            if p.var() >= 16:
                c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
                cov = ((p - p.mean()) * (q - q.mean())).mean()
                found.append(((2 * p.mean() * q.mean() + c1) * (2 * cov + c2) / ((p.mean() ** 2 + q.mean() ** 2 + c1) * (p.var() + q.var() + c2)), p.var()))
    if not found:
        return 1.0
    found.sort(key=lambda f: f[0])
    total, run, worst = sum(w for _, w in found), 0.0, []
    for s, w in found:
        worst.append((s, w))
        run += w
        if run >= 0.05 * total:
            break
    mean = lambda v: sum(s * w for s, w in v) / sum(w for _, w in v)
    return (mean(found) + mean(worst)) / 2


def scaled(x, height, width, lobes):
    """Separable resampling, one output sample at a time: triangle weights, or Lanczos weights with lobes."""
    def axis(v, m):
        n = v.shape[0]
        scale, wide = n / m, max(1.0, n / m)
        out = []
        for k in range(m):
            d = (np.arange(n) - ((k + 0.5) * scale - 0.5)) / wide
            w = np.maximum(0, 1 - abs(d)) if not lobes else np.where(abs(d) < lobes, np.sinc(d) * np.sinc(d / lobes), 0)
            out.append(np.tensordot(w / w.sum(), v, (0, 0)))
        return np.stack(out)

    wide = np.moveaxis(axis(np.moveaxis(x.astype(float), 1, 0), width), 0, 1)
    return axis(wide, height)


def test_versions_equal_a_plain_loop(spark):
    def fails(picture, quality):
        if quality < 0.7:
            raise ValueError("too coarse")
        return b"1234", picture

    synthetic.register(spark)
    strips = spark.read.format("synthetic_pictures").options(pictures=4, width=96, height=64, kind="noise", partitions=5).load().select(F.col("picture").alias("deck"), F.lit(7).cast("long").alias("page"), "y", "samples")
    blank = spark.createDataFrame([(50, 1, 0, None), (51, 1, 0, b"ab")], "deck long, page long, y int, samples binary")
    codecs = {"coarse": pageversions.coarse, "fails": fails, "differences": pageversions.differences}
    found = pageversions.page_versions(strips.unionByName(blank), ["deck", "page"], RUNGS, 48, codecs, 0.6).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r["deck"], r["version"])):
        got.setdefault(r["deck"], []).append(tuple(r)[2:])
    assert set(got) == {0, 1, 2, 3}
    rows = {(r["deck"], r["y"]): bytes(r["samples"]) for r in strips.collect()}
    stops = set()
    for deck, versions in got.items():
        page = np.stack([np.frombuffer(rows[deck, y], np.uint8).reshape(-1, 3) for y in range(64)])
        gray = lambda p: (77 * p[..., 0].astype(int) + 150 * p[..., 1].astype(int) + 29 * p[..., 2].astype(int) + 128) // 256
        sharp, expected, n = scaled(gray(page), 32, 48, 0), [], 0
        for k, rung in enumerate(RUNGS):
            scale = min(1, rung.long_edge / 96)
            h, w = int(64 * scale + 0.5), int(96 * scale + 0.5)
            small = page if (h, w) == (64, 96) else np.clip(np.rint(scaled(page, h, w, 3)), 0, 255).astype(np.uint8)
            best = -1
            for name, codec in codecs.items():
                if name == "fails" and rung.quality < 0.7:
                    continue
                data, back = codec(small, rung.quality)
                clear = block_clarity(sharp, scaled(gray(back), 32, 48, 0))
                expected.append((n, k, name, w, h, len(data), clear))
                best, n = max(best, clear), n + 1
            if best < 0.6:
                break
        stops.add(k)
        assert [v[:-1] for v in versions] == [e[:-1] for e in expected] and np.allclose([v[-1] for v in versions], [e[-1] for e in expected], atol=1e-9)
    assert max(stops) < len(RUNGS) - 1
