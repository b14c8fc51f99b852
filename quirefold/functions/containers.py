"""Column functions on a container's parts: names, boxes, dictionaries, quantisation, compressed streams."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The luminance table of ITU-T T.81, annex K, row by row.
LUMINANCE = [
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
]
# Filter names around image data, and the order in which a table's 64 cells are stored (row by row numbers).
JPEG_FILTERS, FLATE_FILTERS = ("/DCTDecode", "/DCT"), ("/FlateDecode", "/Fl")
ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))
LETTER = [0.0, 0.0, 612.0, 792.0]
# Entries that a rewritten image does not keep.
DROPPED = ["/Filter", "/DecodeParms", "/Length", "/DL", "/ColorTransform"]


def decode_name(name: Column) -> Column:
    """A name with its ``#20``-like escapes read; of an escape with one hexadecimal digit that digit counts."""
    token = F.regexp_extract_all(name, F.lit(r"(?s)(#[0-9A-Fa-f].|.)"), F.lit(1))
    code = lambda x: F.conv(F.when(F.substring(x, 3, 1).rlike("[0-9A-Fa-f]"), F.substring(x, 2, 2)).otherwise(F.substring(x, 2, 1)), 16, 10)
    return F.array_join(F.transform(token, lambda x: F.when(F.length(x) == 3, F.char(code(x).cast("long"))).otherwise(x)), "")


def rectangle(numbers: Column) -> Column:
    """(x0, y0, x1, y1) in order; null unless there are four numbers."""
    at = lambda i: F.get(numbers, i)
    fine = (F.size(numbers) == 4) & F.forall(numbers, lambda x: x.isNotNull())
    return F.when(fine, F.array(F.least(at(0), at(2)), F.least(at(1), at(3)), F.greatest(at(0), at(2)), F.greatest(at(1), at(3))))


def page_box(media: Column, crop: Column) -> Column:
    """Width and height of what both boxes hold; the media box (letter paper if it is none) where they hold nothing together."""
    m, c = F.coalesce(rectangle(media), F.array(*map(F.lit, LETTER))), rectangle(crop)
    side = lambda i: F.least(m[i + 2], F.coalesce(F.get(c, i + 2), m[i + 2])) - F.greatest(m[i], F.coalesce(F.get(c, i), m[i]))
    fine = (side(0) > 0) & (side(1) > 0)
    return F.struct(F.when(fine, side(0)).otherwise(m[2] - m[0]).alias("width"), F.when(fine, side(1)).otherwise(m[3] - m[1]).alias("height"))


def rewritten_dict(entries: Column, width: Column, height: Column, jpeg: Column) -> Column:
    """An image's dictionary (a map of text) for its new size and encoding."""
    kept = F.map_filter(entries, lambda k, _: ~k.isin([*DROPPED, "/Width", "/Height", "/BitsPerComponent"]))
    new = F.create_map(
        F.lit("/Width"), width.cast("string"), F.lit("/Height"), height.cast("string"), F.lit("/BitsPerComponent"), F.lit("8"),
        F.lit("/Filter"), F.when(jpeg, "/DCTDecode").otherwise("/FlateDecode"),
    )
    return F.map_concat(kept, new)


def distance_of(quality: Column) -> Column:
    """Encoder distance of a canvas quality."""
    return 0.1 + (100 - F.floor(quality * 100 + 0.5)) * 0.09


def gray_quantisers(quality: Column) -> Column:
    """The luminance table scaled to a canvas quality."""
    q = F.greatest(F.lit(1), F.least(F.lit(100), F.floor(quality * 100 + 0.5))).cast("double")
    scale = F.when(q < 50, 5000 / q).otherwise(200 - q * 2)
    return F.transform(F.array(*map(F.lit, LUMINANCE)), lambda v: F.greatest(F.lit(1), F.least(F.lit(255), F.floor((v * scale + 50) / 100))).cast("int"))


def _binary(run: Callable[[bytes], bytes | None], content: Column) -> Column:
    """A function of bytes over batches; null stays null."""

    @F.pandas_udf("binary")
    def each(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else run(bytes(v)))

    return each(content)


def deflated(content: Column) -> Column:
    """Compressed as hard as zlib can."""
    return _binary(lambda x: zlib.compress(x, 9), content)


def inflated(content: Column) -> Column:
    """Decompressed, null where that fails."""

    def one(x: bytes) -> bytes | None:
        try:
            return zlib.decompress(x)
        except zlib.error:
            return None

    return _binary(one, content)


def jpeg_header(content: bytes) -> tuple[int, int, int, int] | None:
    """(width, height, components, bits) from the frame header; None for anything else."""
    if content[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 4 <= len(content) and content[at] == 0xFF:
        kind = content[at + 1]
        if kind == 0xFF:
            at += 1
        elif kind in (0x01, 0xD8) or 0xD0 <= kind <= 0xD7:
            at += 2
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            frame = content[at + 4 : at + 10]
            if len(frame) < 6:
                return None
            return int.from_bytes(frame[3:5], "big"), int.from_bytes(frame[1:3], "big"), frame[5], frame[0]
        else:
            length = int.from_bytes(content[at + 2 : at + 4], "big")
            if length < 2 or kind == 0xDA:
                return None
            at += 2 + length
    return None


def luma_quality(content: bytes) -> int | None:
    """The quality that the first luminance table speaks of: how much coarser it is than the standard's, on average; None without one."""
    for kind, start, end in segments(content):
        at = start
        while kind == 0xDB and at < end:
            wide, number = content[at] >> 4, content[at] & 15
            step = 2 if wide else 1
            if number == 0 and at + 1 + 64 * step <= end:
                table = np.frombuffer(content[at + 1 : at + 1 + 64 * step], dtype=">u2" if wide else np.uint8)
                scale = float((table / np.array(LUMINANCE)[ZIGZAG]).mean() * 100)
                if scale <= 0:
                    return 100
                return int(max(1, min(100, np.floor((100 - scale / 2 if scale <= 100 else 5000 / scale) + 0.5))))
            at += 1 + 64 * step
    return None


def segments(content: bytes) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) of a JPEG's segments before its scan."""
    at = 2 if content[:2] == b"\xff\xd8" else len(content)
    while at + 4 <= len(content) and content[at] == 0xFF and content[at + 1] != 0xDA:
        end = at + 2 + int.from_bytes(content[at + 2 : at + 4], "big")
        yield content[at + 1], at + 4, min(end, len(content))
        at = max(end, at + 4)


def jpeg_quality(content: Column) -> Column:
    @F.pandas_udf("int")
    def each(x: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else luma_quality(bytes(v)) for v in x], dtype="Int32")

    return each(content)


def readable_image(content: Column, filters: Column, kind: Column, width: Column, height: Column, components: Column, bits: Column) -> Column:
    """An image's data as an encoder takes it; null where it cannot be trusted.

    A JPEG is taken out of the Flate layers around it, and must have the size and number of colours that the document says. Raw samples must all be there, and no filter left; of 16-bit
    samples the high bytes stay.
    """

    def one(data: object, names: object, kind: str, w: int, h: int, n: int, depth: int) -> bytes | None:
        names, data = list(names), bytes(data)
        if not data:
            return None
        if kind == "jpeg":
            if names and (names[-1] not in JPEG_FILTERS or not set(names[:-1]) <= set(FLATE_FILTERS)):
                return None
            for _ in names[:-1]:
                try:
                    data = zlib.decompress(data)
                except zlib.error:
                    return None
            found = jpeg_header(data)
            return data if found and found[:3] == (w, h, n) else None
        need = int(w) * int(h) * int(n) * (2 if depth == 16 else 1)
        return None if names or len(data) < need else data[0:need:2] if depth == 16 else data

    @F.pandas_udf("binary")
    def each(data: pd.Series, names: pd.Series, kind: pd.Series, w: pd.Series, h: pd.Series, n: pd.Series, depth: pd.Series) -> pd.Series:
        return pd.Series([None if x[0] is None or x[2] is None else one(*x) for x in zip(data, names, kind, w, h, n, depth, strict=True)], dtype=object)

    return each(content, filters, kind, width, height, components, bits)


def jpeg_info(content: Column) -> Column:
    """Size of a JPEG from its frame header; nulls for anything else."""

    @F.pandas_udf("struct<width:int,height:int,components:int,bits:int>")
    def each(x: pd.Series) -> pd.DataFrame:
        found = [jpeg_header(bytes(v)) if v is not None else None for v in x]
        return pd.DataFrame([f or (None,) * 4 for f in found], columns=["width", "height", "components", "bits"]).astype("Int32")

    return each(content)


def without_metadata(content: bytes) -> bytes:
    """A JPEG without its APP1 and APP2 segments; anything else as it is."""
    if content[:2] != b"\xff\xd8":
        return content
    kept, at = [content[:2]], 2
    while at + 4 <= len(content) and content[at] == 0xFF and content[at + 1] != 0xDA:
        end = at + 2 + int.from_bytes(content[at + 2 : at + 4], "big")
        if content[at + 1] not in (0xE1, 0xE2):
            kept.append(content[at:end])
        at = end
    return b"".join([*kept, content[at:]])


def stripped(content: Column) -> Column:
    return _binary(without_metadata, content)
