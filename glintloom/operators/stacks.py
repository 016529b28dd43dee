"""Stacks of images, rows of (z, y, x, value), aligned to parts of a pixel by the sum of their products.

Moved by d, the second stack has with the first the product sum C(d) = sum over whole
lags l of s(l) K(l - d), where s are the product sums at whole lags and K interpolates.
So Spark sums s over the stacks once, for some lags around a coarse maximum, and Newton
steps on C with its gradient and Hessian need those few numbers only. Lags are summed in
blocks of voxels with a border, a task's work is bounded whatever the size of a stack.
A plain image is a stack with z = 0 throughout.
"""

from __future__ import annotations

from math import sqrt
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintloom.operators.shared import checkpointed

AXES = ("z", "y", "x")
Triple = tuple[int, int, int]
#: Side of a block of voxels.
_BLOCK = 16
#: Width of the Gaussian that ends the interpolating sinc, and whole lags on each side that it is given.
_WINDOW, REACH = 2.0, 5


class Alignment(NamedTuple):
    """shift is what to add to (z, y, x) of the second stack; score the product sum there; quality how many deviations it lies above that of two random stacks."""

    shift: tuple[float, float, float]
    score: float
    quality: float


def summed(stack: DataFrame, bins: int = 1, flat: bool = False) -> DataFrame:
    """(z, y, x, value): voxels added up in cubes of `bins`; those met twice are added, null values count as 0. A flat stack is not binned in z."""
    at = [F.floor(F.col(a) / (1 if flat and a == "z" else bins)).cast("int").alias(a) for a in AXES]
    return stack.groupBy(*at).agg(F.coalesce(F.sum(F.col("value").cast("double")), F.lit(0.0)).alias("value"))


def lag_sums(first: DataFrame, second: DataFrame, centre: Triple = (0, 0, 0), reach: Triple = (REACH, REACH, REACH)) -> DataFrame:
    """(lz, ly, lx, s): sum of the products of second at a voxel and of first that lag farther on, for lags at most `reach` from centre whose sum is not 0.

    Both are summed stacks: each voxel once. Voxels that are not there are 0, and nothing
    wraps. A voxel of first goes to the blocks from which it can be reached.
    """
    block = lambda a, low, high: F.sequence(F.floor((F.col(a) - high) / _BLOCK), F.floor((F.col(a) - low) / _BLOCK))
    a = first
    for name, c, r in zip(AXES, centre, reach, strict=True):
        a = a.withColumn("b" + name, F.explode(block(name, c - r, c + r)))
    b = second.withColumns({"b" + name: F.floor(F.col(name) / _BLOCK) for name in AXES})
    names, low = ["bz", "by", "bx"], np.array(centre) - np.array(reach)

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"lz": [], "ly": [], "lx": [], "s": []}, dtype="int32").astype({"s": "float64"})
        origin = np.array(key) * _BLOCK
        inner, border = np.zeros((_BLOCK,) * 3), np.zeros(_BLOCK + 2 * np.array(reach))
        inner[tuple((right[list(AXES)].to_numpy() - origin).T)] = right["value"]
        border[tuple((left[list(AXES)].to_numpy() - origin - low).T)] = left["value"]
        used = right["z"].to_numpy() - origin[0]
        inner, border = inner[: used.max() + 1], border[: used.max() + 1 + 2 * reach[0]]  # flat stacks fill one layer
        s = np.tensordot(np.lib.stride_tricks.sliding_window_view(border, inner.shape), inner, 3)
        lags = np.argwhere(s != 0)
        return pd.DataFrame({**{n: (lags[:, k] + low[k]).astype("int32") for k, n in enumerate(("lz", "ly", "lx"))}, "s": s[s != 0]})

    sums = b.groupBy(*names).cogroup(a.groupBy(*names))
    found = sums.applyInPandas(lambda key, right, left: run(key, left, right), "lz int, ly int, lx int, s double")
    return found.groupBy("lz", "ly", "lx").agg(F.sum("s").alias("s"))


def _patch(sums: DataFrame, centre: Triple, reach: Triple) -> np.ndarray:
    out = np.zeros(2 * np.array(reach) + 1)
    for lz, ly, lx, s in sums.collect():  # a row for each lag
        out[lz - centre[0] + reach[0], ly - centre[1] + reach[1], lx - centre[2] + reach[2]] = s
    return out


def kernel(t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The interpolating kernel, a sinc under a Gaussian, with its first two derivatives."""
    t = np.asarray(t, float)
    tiny = np.abs(t) < 1e-4
    safe = np.where(tiny, 1.0, t)
    s = np.sinc(t)
    s1 = np.where(tiny, -np.pi**2 * t / 3, (np.cos(np.pi * safe) - s) / safe)
    s2 = np.where(tiny, -np.pi**2 / 3, -np.pi**2 * s - 2 * s1 / safe)
    w = 1 / _WINDOW**2
    g = np.exp(-t * t * w / 2)
    return s * g, (s1 - s * t * w) * g, (s2 - 2 * s1 * t * w + s * (t * t * w * w - w)) * g


def product_at(patch: np.ndarray, d: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """C, its gradient and its Hessian at d, in voxels from the middle of a patch of lag sums. An axis of one lag is not interpolated."""
    rows = []
    for n, x in zip(patch.shape, d, strict=True):
        rows.append(kernel(np.arange(n) - n // 2 - x) if n > 1 else (np.ones(1), np.zeros(1), np.zeros(1)))
    at = lambda *orders: float(np.einsum("zyx,z,y,x", patch, *[r[o] for r, o in zip(rows, orders, strict=True)])) * (-1) ** sum(orders)
    one = np.eye(3, dtype=int)
    return at(0, 0, 0), np.array([at(*one[i]) for i in range(3)]), np.array([[at(*(one[i] + one[j])) for j in range(3)] for i in range(3)])


def newton_maximum(patch: np.ndarray, steps: int = 100) -> tuple[np.ndarray, float]:
    """Where C is largest near the largest lag sum of a patch, from its middle, and C there. Raises ValueError if the steps do not settle within a voxel of it."""
    start = np.array(np.unravel_index(np.argmax(patch), patch.shape)) - np.array(patch.shape) // 2
    d, moving = start.astype(float), np.array(patch.shape) > 1
    value, gradient, hessian = product_at(patch, d)
    for _ in range(steps):
        h, g = hessian[np.ix_(moving, moving)], gradient[moving]
        values, vectors = np.linalg.eigh(h)
        curved = np.maximum(np.abs(values), 1e-9 * max(np.abs(values).max(), 1e-300))  # up along every direction, at a saddle too
        step = np.zeros(3)
        step[moving] = vectors @ ((vectors.T @ g) / curved)
        step *= min(1.0, 0.5 / max(np.abs(step).max(), 1e-300))
        while np.abs(step).max() > 1e-10 and product_at(patch, d + step)[0] < value:
            step /= 2
        if np.abs(step).max() <= 1e-9:
            return d, value
        d = d + step
        if np.abs(d - start).max() > 1:
            break
        value, gradient, hessian = product_at(patch, d)
    raise ValueError("the stacks cannot be aligned")


def align(first: DataFrame, second: DataFrame, shape: Triple, expected: Triple = (0, 0, 0), coarse: tuple[int, ...] = (4,)) -> Alignment:
    """How second must be moved to lie on first; both have rows (z, y, x, value), shape is that of the stacks.

    For each of the falling sizes `coarse` the lag is taken from cubes of that many voxels,
    first with REACH cubes around the expected lag, then with two around the lag found; the
    last whole lag is refined by Newton steps. Stacks without a common maximum raise
    ValueError. A shape of one layer aligns plain images.
    """
    flat = shape[0] == 1
    centre, reach = np.array(expected), REACH
    for bins in coarse:
        scale = np.array([1 if flat else bins, bins, bins])
        middle, wide = tuple(int(x) for x in np.round(centre / scale)), (0 if flat else reach, reach, reach)
        patch = _patch(lag_sums(summed(first, bins, flat), summed(second, bins, flat), middle, wide), middle, wide)
        if not patch.any():
            raise ValueError("the stacks cannot be aligned")
        centre, reach = (np.array(np.unravel_index(np.argmax(patch), patch.shape)) - np.array(wide) + middle) * scale, 2
    a, b = checkpointed(summed(first)), checkpointed(summed(second))
    wide = (0 if flat else REACH, REACH, REACH)
    for _ in range(2):  # the largest whole lag goes to the middle, so that interpolation has all sides
        middle = tuple(int(x) for x in centre)
        patch = _patch(lag_sums(a, b, middle, wide), middle, wide)
        if not patch.any():
            raise ValueError("the stacks cannot be aligned")
        centre = np.array(np.unravel_index(np.argmax(patch), patch.shape)) - np.array(wide) + middle
        if tuple(centre) == middle:
            break
    d, score = newton_maximum(patch)
    size = float(np.prod(shape))
    means = [t.agg(F.sum("value")).first()[0] / size for t in (a, b)]
    spread = sqrt(abs(means[0] * means[1] * (1 + means[0] + means[1]) * size))
    z, y, x = (float(m + k) for m, k in zip(middle, d, strict=True))
    return Alignment((z, y, x), score, (score - means[0] * means[1] * size) / spread if spread else 0.0)


def translated(stack: DataFrame, shift: tuple[float, float, float], shape: Triple) -> DataFrame:
    """(z, y, x, value): the stack moved by shift and interpolated, one axis after the other; what leaves the shape is cut off. Voxels that no given one reaches are absent."""
    out = summed(stack)
    for name, d, n in zip(AXES, shift, shape, strict=True):
        whole = round(d)
        part = d - whole
        places = [whole] if part == 0 else list(range(whole - REACH, whole + REACH + 1))
        weights = [1.0] if part == 0 else kernel(np.array(places) - d)[0].tolist()
        moves = F.array(*[F.struct(F.lit(p).alias("by"), F.lit(w).alias("w")) for p, w in zip(places, weights, strict=True)])
        others = [a for a in AXES if a != name]
        moved = out.select(*others, name, "value", F.explode(moves).alias("m")).select(*others, (F.col(name) + F.col("m.by")).alias(name), (F.col("value") * F.col("m.w")).alias("value"))
        out = moved.where(F.col(name).between(0, n - 1)).groupBy(*AXES).agg(F.sum("value").alias("value"))
    return out.select(*AXES, "value")
