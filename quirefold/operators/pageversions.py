"""Versions of pages that are pictures: each page's pixels at several sizes and through several codecs, as a table function that is handed one page at a time."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql.functions import udtf

from quirefold.functions import pixels

#: Writes pixels (rows by columns by 3) at a quality of 0 to 1, and gives the bytes and the pixels that come back from them.
Codec = Callable[[np.ndarray, float], tuple[bytes, np.ndarray]]
VERSION = "{keys}, version int, rung int, codec string, width int, height int, bytes long, clarity double"


@dataclass(frozen=True)
class Rung:
    """A long edge in pixels and a quality; pages are tried at the sharpest first."""

    long_edge: int
    quality: float


def coarse(picture: np.ndarray, quality: float) -> tuple[bytes, np.ndarray]:
    """A codec of plain means: samples in steps that grow as the quality falls, deflated."""
    step = 1 + round((1 - quality) * 63)
    kept = picture // step
    return zlib.compress(kept.tobytes(), 9), np.clip(kept.astype(np.int64) * step + step // 2, 0, 255).astype(np.uint8)


def differences(picture: np.ndarray, quality: float) -> tuple[bytes, np.ndarray]:
    """The same steps, as differences to the sample on the left."""
    step = 1 + round((1 - quality) * 63)
    kept = picture // step
    left = np.concatenate([np.zeros_like(kept[:, :1]), kept[:, :-1]], axis=1)
    return zlib.compress((kept - left).tobytes(), 9), np.clip(kept.astype(np.int64) * step + step // 2, 0, 255).astype(np.uint8)


CODECS: dict[str, Codec] = {"coarse": coarse, "differences": differences}


def luma(picture: np.ndarray) -> np.ndarray:
    return ((picture.astype(np.int64) @ np.array([77, 150, 29]) + 128) >> 8).astype(np.uint8)


def side(n: int, scale: float) -> int:
    return max(1, int(n * scale + 0.5))


def versions_of(picture: np.ndarray, rungs: list[Rung], compare: int, codecs: dict[str, Codec], floor: float) -> Iterator[tuple]:
    """(version, rung, codec, width, height, bytes, clarity) of one page, the sharpest rung first.

    Clarity is measured against the page itself, both at ``compare`` pixels across. Rungs of one size share one resize. A codec that fails has no version at that rung. Once no codec
    reaches the floor at a rung, lighter rungs are not tried: nobody would choose them.
    """
    height, width = picture.shape[:2]
    long = max(height, width)
    seen = (side(height, min(1.0, compare / long)), side(width, min(1.0, compare / long)))
    sharp = pixels.resample(luma(picture), *seen)
    sized: dict[tuple[int, int], np.ndarray] = {}
    n = 0
    for k, rung in enumerate(rungs):
        scale = min(1.0, rung.long_edge / long)
        size = (side(height, scale), side(width, scale))
        if size not in sized:
            sized[size] = picture if size == (height, width) else pixels.lanczos(picture, *size)
        best = -1.0
        for name, codec in codecs.items():
            try:
                data, back = codec(sized[size], rung.quality)
            except (ValueError, ArithmeticError):
                continue
            clear = pixels.clarity(sharp, pixels.resample(luma(back), *seen))
            best = max(best, clear)
            yield n, k, name, size[1], size[0], len(data), clear
            n += 1
        if n and best < floor:
            return


def page_versions(strips: DataFrame, keys: list[str], rungs: list[Rung], compare: int, codecs: dict[str, Codec] | None = None, floor: float = 0.7) -> DataFrame:
    """keys, version, rung, codec, width, height, bytes, clarity of the pages whose rows of pixels ``strips`` holds: keys (longs), y, samples (RGB bytes of one row).

    A table function partitioned by page takes a page's rows in order, keeps them until it has all, and gives its versions one by one: one page is one task's at most. Rows of unlike lengths are
    cut to the shortest, null rows left out; a page without a whole pixel has no versions.
    """
    spark, used = strips.sparkSession, codecs or CODECS
    kind = VERSION.format(keys=", ".join(f"{k} long" for k in keys))

    class Versions:
        def __init__(self) -> None:
            self.own: tuple | None = None
            self.rows: list[bytes] = []

        def eval(self, row: Row) -> None:
            self.own = tuple(row[k] for k in keys)
            if row["samples"] is not None:
                self.rows.append(bytes(row["samples"]))

        def terminate(self) -> Iterator[tuple]:
            width = min(map(len, self.rows), default=0) // 3
            if self.own is None or not width:
                return
            picture = np.frombuffer(b"".join(r[: 3 * width] for r in self.rows), dtype=np.uint8).reshape(-1, width, 3)
            for v in versions_of(picture, rungs, compare, used, floor):
                yield (*self.own, *v)

    spark.udtf.register("quirefold_page_versions", udtf(Versions, returnType=kind))
    return spark.sql(f"SELECT * FROM quirefold_page_versions(TABLE(SELECT {', '.join(keys)}, y, samples FROM {{strips}}) PARTITION BY ({', '.join(keys)}) ORDER BY y)", strips=strips)
