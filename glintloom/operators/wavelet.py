"""Background of images by wavelets: what is left when all details up to a level are taken out.

Taking an axis down some levels with the low-pass filter of a Daubechies wavelet and up
again without details is linear, so it is one sparse matrix for each length of an axis,
made from the filter by rule. An image is multiplied by it along x and then along y:
two equality joins with a small table and two sums, for all images of all keys at once.
"""

from __future__ import annotations

from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintloom.operators.shared import checkpointed

#: Matrix cells under this size are nothing but rounding.
_NONE = 1e-15


def daubechies(n: int) -> np.ndarray:
    """The 2 n coefficients of the scaling filter with n vanishing moments, by spectral factorization: roots outside the unit circle, sum of the square root of 2."""
    # P(y) = sum of C(n - 1 + k, k) y^k with y = (2 - z - 1 / z) / 4
    outside = []
    for y in np.roots([comb(n - 1 + k, k) for k in range(n - 1, -1, -1)]) if n > 1 else []:
        z = np.roots([1, 4 * y - 2, 1])
        outside.append(z[np.argmin(np.abs(z))])
    filt = np.real(np.poly([-1.0] * n + outside))
    return filt * np.sqrt(2) / filt.sum()


def _extension(n: int, reach: int) -> np.ndarray:
    """Matrix from n samples to n + 2 * reach, continued along the straight line through the last two at each end."""
    out = np.zeros((n + 2 * reach, n))
    out[reach : reach + n] = np.eye(n)
    for i in range(1, reach + 1):
        if n == 1:
            out[reach - i, 0] = out[reach + i, 0] = 1
        else:
            out[reach - i, 0], out[reach - i, 1] = 1 + i, -i
            out[reach + n - 1 + i, n - 1], out[reach + n - 1 + i, n - 2] = 1 + i, -i
    return out


def _down(n: int, scaling: np.ndarray) -> np.ndarray:
    """Matrix of one low-pass step: filtered and every second sample kept, (n + length - 1) // 2 of them."""
    size = len(scaling)
    wide = _extension(n, size)
    low = scaling[::-1]  # the analysing filter is the scaling filter turned round
    out = np.zeros(((n + size - 1) // 2, n + 2 * size))
    for k in range(len(out)):
        for j in range(size):
            out[k, size + 2 * k + 1 - j] += low[j]
    return out @ wide


def _up(n: int, length: int, scaling: np.ndarray) -> np.ndarray:
    """Matrix from n low-pass samples back to `length` samples, without details."""
    size = len(scaling)
    out = np.zeros((2 * n - size + 2, n))
    for k in range(n):
        for j in range(size):
            at = 2 * k + j - (size - 2)
            if 0 <= at < len(out):
                out[at, k] += scaling[j]
    return out[:length]


def smoothing_matrix(length: int, level: int, moments: int = 4) -> np.ndarray:
    """What an axis of so many samples becomes when it loses the details of `level` levels."""
    scaling = daubechies(moments)
    sizes, down = [length], np.eye(length)
    for _ in range(level):
        down = _down(sizes[-1], scaling) @ down
        sizes.append(len(down))
    up = np.eye(sizes[-1])
    for k in range(level, 0, -1):
        up = _up(sizes[k], sizes[k - 1], scaling) @ up
    return up @ down


def _table(image: DataFrame, length: int, level: int, moments: int, name: str) -> DataFrame:
    """(name, to, w): the cells of the smoothing matrix. A band around the diagonal, some rows of the pixels of one axis."""
    m = smoothing_matrix(length, level, moments)
    rows = [(int(j), int(i), float(m[i, j])) for i, j in np.argwhere(np.abs(m) > _NONE)]
    return F.broadcast(image.sparkSession.createDataFrame(rows, f"{name} int, to int, w double"))


def smoothed(image: DataFrame, height: int, width: int, level: int, keys: list[str], value: str = "value", moments: int = 4) -> DataFrame:
    """(keys, y, x, background) of whole images: no details up to a level. Absent pixels count as 0."""
    along_x = image.select(*keys, "y", "x", F.col(value).alias("__v")).join(_table(image, width, level, moments, "x"), "x")
    once = along_x.groupBy(*keys, "y", F.col("to").alias("x")).agg(F.sum(F.col("__v") * F.col("w")).alias("__v"))
    along_y = once.join(_table(image, height, level, moments, "y"), "y")
    return along_y.groupBy(*keys, F.col("to").alias("y"), "x").agg(F.sum(F.col("__v") * F.col("w")).alias("background"))


def wavelet_background(image: DataFrame, height: int, width: int, iterations: int, threshold: float, level: int, keys: list[str], value: str = "value", moments: int = 4) -> DataFrame:
    """image with background, estimated so many times over: what stands out by more than the threshold is cut down to the last estimate before the next one.

    Images must have a row for each pixel.
    """
    now = image.select(*keys, "y", "x", F.col(value).cast("double").alias("__now"))
    for k in range(iterations):
        low = smoothed(now, height, width, level, keys, "__now", moments)
        both = now.join(low, [*keys, "y", "x"])
        cut = F.when(F.col("__now") > F.col("background") + threshold, F.col("background")).otherwise(F.col("__now"))
        both = both.select(*keys, "y", "x", cut.alias("__now"), "background")
        now = both if k == iterations - 1 else checkpointed(both.drop("background"))
    return image.join(now.select(*keys, "y", "x", "background"), [*keys, "y", "x"])
