"""Filter chains against round trips, known data, and damage."""

import random
import zlib

import numpy as np
import pytest

from quirefold.functions import filters
from quirefold.operators import streams

NAMES = ["/FlateDecode", "/Fl", "/LZWDecode", "/LZW", "/ASCII85Decode", "/A85", "/ASCIIHexDecode", "/AHx", "/RunLengthDecode", "/RL"]


def samples():
    rng = random.Random(5)
    return [b"", b"a", b"\x00" * 700, bytes(range(256)) * 20, b"ab" * 4000, bytes(rng.randrange(256) for _ in range(20_000)), bytes(rng.choice(b"abc") for _ in range(30_000)), b"zzzzz\x00\x00\x00\x00\x00~>y>"]


def test_chains_come_back(spark):
    rng = random.Random(6)
    rows = [(k, d, [rng.choice(NAMES) for _ in range(rng.randint(0, 3))]) for k, d in enumerate(samples() * 4)] + [(100 + k, d, [n]) for k, d in enumerate(samples()) for n in NAMES]
    df = spark.createDataFrame(rows, "deck_id int, ref binary, filters array<string>")
    df = df.withColumn("content", filters.encoded(df["ref"], df["filters"])).selectExpr("*", f"CAST(NULL AS {filters.PARMS}) AS parms")
    found = df.select("ref", "filters", filters.decoded(df["content"], df["filters"], df["parms"], "specialized").alias("d")).collect()
    assert len(found) == len(rows) and all(r["d"]["bytes"] == r["ref"] and r["d"]["filters"] == [] and not r["d"]["damaged"] for r in found)


def test_late_change_and_published_data():
    for data in samples():
        assert filters.lzw_decoded(filters.lzw_encoded(data, 0), 0) == data == filters.lzw_decoded(filters.lzw_encoded(data))
    # The worked example of the format's description: 45 45 45 45 45 65 45 45 45 66.
    assert filters.lzw_decoded(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    assert filters.a85_decoded(b"87cURD]i,\"Ebo80~>rest") == b"Hello World!" and filters.hex_decoded(b"48 65\n6c6C 6f 7>zz") == b"Hello\x70"


@pytest.mark.parametrize("colors", [1, 3, 4])
def test_predictors(colors):
    rng = np.random.default_rng(colors)
    columns, x = 17, rng.integers(0, 256, size=(9, 17 * colors), dtype=np.uint8)
    left = np.concatenate([np.zeros((9, colors), np.uint8), x[:, :-colors]], axis=1)
    up = np.concatenate([np.zeros((1, x.shape[1]), np.uint8), x[:-1]])
    corner = np.concatenate([np.zeros((9, colors), np.uint8), up[:, :-colors]], axis=1)
    a, b, c = (v.astype(int) for v in (left, up, corner))
    p = a + b - c
    near = np.where((abs(p - a) <= abs(p - b)) & (abs(p - a) <= abs(p - c)), a, np.where(abs(p - b) <= abs(p - c), b, c))
    guess = {0: 0 * a, 1: a, 2: b, 3: (a + b) // 2, 4: near}
    kinds = [0, 1, 2, 3, 4, 4, 3, 2, 1]
    packed = b"".join(bytes([k]) + ((x[n].astype(int) - guess[k][n]) % 256).astype(np.uint8).tobytes() for n, k in enumerate(kinds))
    assert filters.unpredicted(packed, 15, colors, 8, columns) == x.tobytes()
    assert filters.unpredicted(((x.astype(int) - a) % 256).astype(np.uint8).tobytes(), 2, colors, 8, columns) == x.tobytes()
    for bad in (packed[:-1], b"\x07" + packed[1:]):
        with pytest.raises(filters.Damaged):
            filters.unpredicted(bad, 12, colors, 8, columns)


def test_all_or_none_and_only_what_is_wanted(spark):
    text = b"some text " * 30
    flat = zlib.compress(text)
    rows = [
        (1, 1, flat, ["/FlateDecode"], None), (1, 2, flat[:-9], ["/FlateDecode"], None), (1, 3, zlib.compress(b"jpeg"), ["/FlateDecode", "/DCTDecode"], None), (1, 4, filters.hex_encoded(flat[:10]), ["/AHx", "/Fl"], None),
        (1, 5, text, [], None), (1, 6, text, None, None), (1, 7, None, ["/Fl"], None), (1, 8, filters.run_encoded(text), ["/RL"], None), (2, 1, flat, ["/Fl"], None), (2, 9, zlib.compress(b"\x02abc"), ["/Fl"], [(12, 1, 8, 3, None)]),
        (2, 10, b"", ["/LZW"], None), (2, 11, b"\xff\xff\xff", ["/LZW"], None),
    ]
    s = spark.createDataFrame(rows, f"deck_id int, ref int, content binary, filters array<string>, parms {filters.PARMS}")
    wanted = spark.createDataFrame([(r[0], r[1]) for r in rows if (r[0], r[1]) != (2, 1)] * 2 + [(9, 9)], "deck_id int, ref int")
    read, stay = streams.selected_streams(s, wanted)
    got = {(r["deck_id"], r["ref"]): (r["bytes"], r["filters"], r["damaged"]) for r in read.collect()}
    assert got == {
        (1, 1): (text, [], False), (1, 2): (flat[:-9], ["/FlateDecode"], True), (1, 3): (zlib.compress(b"jpeg"), ["/FlateDecode", "/DCTDecode"], False), (1, 4): (filters.hex_encoded(flat[:10]), ["/AHx", "/Fl"], True),
        (1, 5): (text, [], False), (1, 6): (text, [], False), (1, 7): (None, ["/Fl"], False), (1, 8): (filters.run_encoded(text), ["/RL"], False), (2, 9): (b"abc", [], False), (2, 10): (b"", ["/LZW"], True), (2, 11): (b"\xff\xff\xff", ["/LZW"], True),
    }
    assert {tuple(r) for r in stay.collect()} == {(1, "/FlateDecode", 2), (1, "/DCTDecode", 1), (1, "/AHx", 1), (1, "/Fl", 2), (1, "/RL", 1), (2, "/LZW", 2)}
    assert streams.selected_streams(s, wanted, "specialized")[0].where("deck_id = 1 AND ref = 8").first()["bytes"] == text
    assert streams.selected_streams(s.limit(0), wanted)[0].count() == 0
