"""Pixel kernels as small numpy helpers for pandas UDFs: clarity, resampling, luminance."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Block size, the variance from which a block counts as detail, the usual SSIM constants, and the share of the worst detail.
BLOCK, DETAIL_VARIANCE, C1, C2, WORST_SHARE = 8, 16, (0.01 * 255) ** 2, (0.03 * 255) ** 2, 0.05


def clarity(reference: np.ndarray, candidate: np.ndarray) -> float:
    """Contrast-weighted similarity of 8 x 8 blocks that have detail, averaged with that of the worst twentieth; 1 without detail."""
    h, w = (n // BLOCK * BLOCK for n in reference.shape)
    x, y = (a[:h, :w].astype(np.float64).reshape(h // BLOCK, BLOCK, w // BLOCK, BLOCK).swapaxes(1, 2).reshape(-1, BLOCK * BLOCK) for a in (reference, candidate))
    mx, my = x.mean(axis=1), y.mean(axis=1)
    vx, vy, cov = (x * x).mean(axis=1) - mx * mx, (y * y).mean(axis=1) - my * my, (x * y).mean(axis=1) - mx * my
    keep = vx >= DETAIL_VARIANCE
    if not keep.any():
        return 1.0
    score = (((2 * mx * my + C1) * (2 * cov + C2)) / ((mx * mx + my * my + C1) * (vx + vy + C2)))[keep]
    weight = vx[keep]
    order = np.argsort(score, kind="stable")
    run = np.cumsum(weight[order])
    n = int(np.searchsorted(run, weight.sum() * WORST_SHARE)) + 1
    worst = order[:n]
    return float((np.average(score, weights=weight) + np.average(score[worst], weights=weight[worst])) / 2)


def axis_weights(n: int, m: int) -> np.ndarray:
    """Triangle weights (m x n) from n samples to m, widened when shrinking."""
    scale = n / m
    width = max(1.0, scale)
    centre = (np.arange(m) + 0.5) * scale - 0.5
    w = np.maximum(0.0, 1 - np.abs(np.arange(n)[None, :] - centre[:, None]) / width)
    return w / w.sum(axis=1, keepdims=True)


def lanczos_weights(n: int, m: int, lobes: int = 3) -> np.ndarray:
    """Lanczos weights (m x n) from n samples to m, widened when shrinking."""
    scale = n / m
    width = max(1.0, scale)
    x = (np.arange(n)[None, :] - ((np.arange(m) + 0.5) * scale - 0.5)[:, None]) / width
    w = np.where(np.abs(x) < lobes, np.sinc(x) * np.sinc(x / lobes), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def resample(pixels: np.ndarray, height: int, width: int, weights: Callable[[int, int], np.ndarray] = axis_weights) -> np.ndarray:
    """The pixels at another size, one axis after the other; channels, if there are any, each on their own."""
    rows, columns = weights(pixels.shape[0], height), weights(pixels.shape[1], width)
    return np.moveaxis(np.tensordot(rows, np.tensordot(pixels.astype(np.float64), columns, (1, 1)), (1, 0)), -1, 1) if pixels.ndim > 2 else rows @ pixels.astype(np.float64) @ columns.T


def lanczos(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """8-bit pixels at another size by Lanczos filters of three lobes."""
    return np.clip(np.rint(resample(pixels, height, width, lanczos_weights)), 0, 255).astype(np.uint8)


def tile_stats(pixels: np.ndarray, size: int, step: int = 4) -> list[tuple[int, int, float, float]]:
    """(x, y, detail, spread) of the whole tiles of an image, centred: mean difference to the samples right and below, and standard deviation, of every fourth sample both ways."""
    gray = pixels if pixels.ndim == 2 else (pixels.astype(np.int64) @ np.array([2, 5, 1])) >> 3
    gray = gray.astype(np.int64)
    rows, columns = gray.shape[0] // size, gray.shape[1] // size
    top, left = (gray.shape[0] - rows * size) // 2, (gray.shape[1] - columns * size) // 2
    out = []
    for y in range(top, top + rows * size, size):
        for x in range(left, left + columns * size, size):
            v = gray[y : y + size : step, x : x + size : step]
            core = v[:-1, :-1]
            detail = np.abs(core - v[:-1, 1:]) + np.abs(core - v[1:, :-1])
            out.append((x, y, float(detail.mean()), float(core.std())))
    return out


def crop(pixels: np.ndarray, x: int, y: int, size: int) -> np.ndarray:
    return pixels[y : y + size, x : x + size]


def clarity_column(reference: Column, candidate: Column, width: int) -> Column:
    """Clarity of gray pixels, row by row, in rows of so many pixels."""
    shape = lambda b: np.frombuffer(bytes(b), dtype=np.uint8).reshape(-1, width)

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([clarity(shape(x), shape(y)) for x, y in zip(a, b, strict=True)], dtype="float64")

    return F.pandas_udf(run, "double")(reference, candidate)
