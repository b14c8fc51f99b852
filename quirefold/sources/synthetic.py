"""Pictures for tests of any size, as a data source: noise and photo-like pixels by a linear congruential generator that any partition can start anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

# The generator's multiplier, addend and modulus.
MULTIPLIER, ADDEND, MODULUS = 1664525, 1013904223, 1 << 32
#: Rows of a batch hold so many bytes at most, or are one row.
BATCH_BYTES = 8 << 20


def leap(steps: int) -> tuple[int, int]:
    """(a, c) such that ``steps`` steps of the generator take a state s to a * s + c: by squaring, as one leap after another is a leap."""
    a, c = 1, 0
    one_a, one_c = MULTIPLIER, ADDEND
    while steps:
        if steps & 1:
            a, c = a * one_a % MODULUS, (c * one_a + one_c) % MODULUS
        one_a, one_c = one_a * one_a % MODULUS, (one_c * one_a + one_c) % MODULUS
        steps >>= 1
    return a, c


def leaps(count: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, c) of 1 to ``count`` steps, by doubling."""
    a, c = np.array([MULTIPLIER], dtype=np.uint64), np.array([ADDEND], dtype=np.uint64)
    mask = np.uint64(MODULUS - 1)
    while len(a) < count:
        last_a, last_c = a[-1], c[-1]
        a, c = np.concatenate([a, a * last_a & mask]), np.concatenate([c, (a * last_c + c) & mask])
    return a[:count], c[:count]


def noise_row(state: np.ndarray, y: int, width: int, height: int, seed: int) -> np.ndarray:
    """A row of a picture that hardly compresses: noise with a slope across, one down, and a shift."""
    noise, x = (state & np.uint64(255)).astype(np.float64), np.arange(width)
    return np.stack([noise + x / width * 100, noise + y / height * 130, noise + seed], axis=1).astype(np.int64).astype(np.uint8)


def photo_row(state: np.ndarray, y: int, width: int, height: int, seed: int) -> np.ndarray:
    """A row of a picture that compresses like a photo: slow waves and a little grain."""
    grain, x = ((state >> np.uint64(24)).astype(np.float64) - 128) / 12, np.arange(width)
    red = 120 + 90 * np.sin((x + seed) / 140) + 30 * np.cos(y / 61) + grain
    green = 110 + 80 * np.cos((y + seed) / 170) + 25 * np.sin((x + y) / 97) + grain
    blue = 140 + 70 * np.sin((x - y + seed) / 210) + grain
    return np.clip(np.stack([red, green, blue], axis=1), 0, 255).astype(np.uint8)


KINDS = {"noise": noise_row, "photo": photo_row}


class Rows(InputPartition):
    """Rows ``start`` to ``end``, counted over all pictures."""

    def __init__(self, start: int, end: int) -> None:
        self.start, self.end = start, end


class PictureReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        of = lambda name, default: int(options.get(name, default))
        self.pictures, self.width, self.height, self.seed, self.parts = of("pictures", 1), of("width", 64), of("height", 48), of("seed", 1), of("partitions", 1)
        self.kind = options.get("kind", "noise")
        if self.kind not in KINDS or min(self.pictures, self.parts) < 0 or min(self.width, self.height) < 1:
            raise ValueError("kind is noise or photo, sizes are positive")

    def partitions(self) -> list[InputPartition]:
        rows = self.pictures * self.height
        parts = max(1, min(self.parts, rows))
        return [Rows(rows * k // parts, rows * (k + 1) // parts) for k in range(parts)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        a, c = leaps(self.width)
        mask, step = np.uint64(MODULUS - 1), max(1, BATCH_BYTES // (3 * self.width))
        for at in range(partition.start, partition.end, step):
            places = [divmod(n, self.height) for n in range(at, min(at + step, partition.end))]
            out = []
            for picture, y in places:
                seed = self.seed + picture
                first_a, first_c = leap(y * self.width)
                state = (a * np.uint64((first_a * (seed % MODULUS) + first_c) % MODULUS) + c) & mask
                out.append(KINDS[self.kind](state, y, self.width, self.height, seed).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in places], pa.int64()), pa.array([y for _, y in places], pa.int32()), pa.array(out, pa.binary())], ["picture", "y", "samples"])


class Pictures(DataSource):
    """``spark.read.format("synthetic_pictures")``: picture, y, samples (RGB bytes of a row), one row for each row of pixels.

    Options: pictures, width, height, kind (``noise`` or ``photo``), seed (of the first picture; each next one has the next seed), partitions. A picture's pixels are one sequence of the generator, whatever the partitions are.
    """

    @classmethod
    def name(cls) -> str:
        return "synthetic_pictures"

    def schema(self) -> str:
        return "picture long, y int, samples binary"

    def reader(self, schema: StructType) -> PictureReader:
        return PictureReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Pictures)
