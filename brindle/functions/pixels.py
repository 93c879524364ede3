"""Pixel work on Spark's image column, in batches: perceptual hashes, sharpness, crops."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def grey(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(float)
    return a[:, :, 0] if channels == 1 else a[:, :, 0] * 0.114 + a[:, :, 1] * 0.587 + a[:, :, 2] * 0.299  # BGR


def shrink(a: np.ndarray, side: int) -> np.ndarray:
    """Means over side x side cells."""
    y, x = (np.arange(side + 1) * a.shape[0]) // side, (np.arange(side + 1) * a.shape[1]) // side
    y0, x0 = np.minimum(y[:-1], a.shape[0] - 1), np.minimum(x[:-1], a.shape[1] - 1)
    y1, x1 = np.maximum(y[1:], y0 + 1), np.maximum(x[1:], x0 + 1)
    s = np.zeros((a.shape[0] + 1, a.shape[1] + 1))
    s[1:, 1:] = a.cumsum(0).cumsum(1)
    return (s[y1][:, x1] - s[y0][:, x1] - s[y1][:, x0] + s[y0][:, x0]) / ((y1 - y0)[:, None] * (x1 - x0)[None, :])


def phash(a: np.ndarray, size: int = 16) -> list[int]:
    """size x size low cosine coefficients against their median, as 64-bit words, least significant first."""
    n = size * 4
    k, i = np.arange(size)[:, None], np.arange(n)[None, :]
    basis = np.cos(np.pi * k * (2 * i + 1) / (2 * n))
    low = basis @ shrink(a, n) @ basis.T
    bits = (low > np.median(low)).ravel()[::-1]
    words = np.packbits(bits.reshape(-1, 64)[:, ::-1], axis=1, bitorder="little").view("<i8").ravel()
    return words.tolist()


def sharpness(a: np.ndarray) -> float:
    """The variance of the Laplacian."""
    if min(a.shape) < 3:
        return 0.0
    lap = a[:-2, 1:-1] + a[2:, 1:-1] + a[1:-1, :-2] + a[1:-1, 2:] - 4 * a[1:-1, 1:-1]
    return float(lap.var())


def _each(image: pd.DataFrame, f) -> pd.Series:
    return pd.Series([f(grey(r.height, r.width, r.nChannels, r.data)) if r.height and r.height > 0 else None for r in image.itertuples()])


def phash_udf(size: int = 16):
    @F.pandas_udf("array<long>")
    def run(image: pd.DataFrame) -> pd.Series:
        return _each(image, lambda a: phash(a, size))

    return run


def sharpness_udf():
    @F.pandas_udf("double")
    def run(image: pd.DataFrame) -> pd.Series:
        return _each(image, sharpness)

    return run


def crop(image, window):
    """The window's pixels of an image struct, as a new one (an Arrow UDF over image and window); nulls where either is missing or empty."""

    @F.pandas_udf("height int, width int, nChannels int, data binary")
    def run(im: pd.DataFrame, w: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r, b in zip(im.itertuples(), w.itertuples(), strict=True):
            if not r.height or not r.height > 0 or not b.x2 > b.x1 or not b.y2 > b.y1:
                out.append((None,) * 4)
                continue
            a = np.frombuffer(r.data, np.uint8).reshape(int(r.height), int(r.width), int(r.nChannels))[int(b.y1) : int(b.y2), int(b.x1) : int(b.x2)]
            out.append((a.shape[0], a.shape[1], int(r.nChannels), a.tobytes()))
        return pd.DataFrame(out, columns=["height", "width", "nChannels", "data"]).astype({"height": "Int32", "width": "Int32", "nChannels": "Int32"})

    return run(image, window)
