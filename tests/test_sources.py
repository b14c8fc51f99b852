"""The data source against its generator run step by step."""

import math

import pytest

from quirefold.sources import synthetic


def plain(kind, seed, width, height):
    """One step a pixel, one pixel after the other."""
    state, rows = seed % 2**32, []
    for y in range(height):
        row = bytearray()
        for x in range(width):
            state = (1664525 * state + 1013904223) % 2**32
            if kind == "noise":
                n = state % 256
                row += bytes(int(v) % 256 for v in (n + x / width * 100, n + y / height * 130, n + seed))
            else:
                g = ((state >> 24) - 128) / 12
                wave = (120 + 90 * math.sin((x + seed) / 140) + 30 * math.cos(y / 61), 110 + 80 * math.cos((y + seed) / 170) + 25 * math.sin((x + y) / 97), 140 + 70 * math.sin((x - y + seed) / 210))
                row += bytes(int(max(0, min(255, w + g))) for w in wave)
        rows.append(bytes(row))
    return rows


def test_leaps_are_steps():
    s, state = 12345, 12345
    a, c = synthetic.leaps(70)
    for n in range(1, 71):
        state = (1664525 * state + 1013904223) % 2**32
        far = synthetic.leap(n)
        assert (far[0] * s + far[1]) % 2**32 == state == (int(a[n - 1]) * s + int(c[n - 1])) % 2**32
    far, again = synthetic.leap(10**15), synthetic.leap(10**15 - 7)
    back = synthetic.leap(7)
    assert far == (again[0] * back[0] % 2**32, (again[1] * back[0] + back[1]) % 2**32)


@pytest.mark.parametrize("kind", ["noise", "photo"])
@pytest.mark.parametrize("partitions", [1, 3, 64])
def test_any_partitions_give_the_same_pictures(spark, kind, partitions):
    synthetic.register(spark)
    read = spark.read.format("synthetic_pictures").options(pictures=3, width=37, height=29, kind=kind, seed=2**32 - 2, partitions=partitions).load()
    assert read.rdd.getNumPartitions() == min(partitions, 87)
    got = {(r["picture"], r["y"]): bytes(r["samples"]) for r in read.collect()}
    assert got == {(p, y): row for p in range(3) for y, row in enumerate(plain(kind, 2**32 - 2 + p, 37, 29))}


def test_no_pictures_and_wrong_options(spark):
    synthetic.register(spark)
    assert spark.read.format("synthetic_pictures").options(pictures=0).load().count() == 0
    with pytest.raises(Exception, match="kind is noise or photo"):
        spark.read.format("synthetic_pictures").options(kind="drawing").load().count()
