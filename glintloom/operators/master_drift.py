"""Drift against a growing master image, in x, y and z together.

Time bins are folded in order. The master is a table of grid cells; a bin is compared
with it, moved by what was found, and added to it. Cells of both meet by equality: in
blocks for the lags in x and y, by their place for the lags in z, and only sums by lag
come to the driver, 121 numbers and one for each pair of planes. Peaks of these sums
are fitted there. Localizations are written once, by bin, and each bin reads its own.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintloom.functions.columns import time_bin
from glintloom.operators.aggregate import grid_2d, grid_3d
from glintloom.operators.drift import fit_peak
from glintloom.operators.shared import checkpointed, written

#: Lags on each side of the expected one that are looked at, and the height of a z bin in microns.
REACH, Z_STEP = 5, 0.05
#: Side of a block of cells, for the join of two grids.
_BLOCK = 16
FIELDS = ("dx", "dy", "dz")


def xy_lag_sums(first: DataFrame, second: DataFrame, centre: tuple[int, int] = (0, 0), reach: int = REACH, keys: list[str] = ()) -> DataFrame:  # type: ignore[assignment]
    """(keys, lx, ly, s): sum of count * count of the cells of second and of first that lie lx, ly farther on, for lags at most `reach` from centre.

    Cells are joined by blocks: a cell of first is repeated for the four blocks at most
    from which it can be reached, so a block never holds more pairs than it has cells.
    """
    keys = list(keys)
    blocks = lambda c, m: F.sequence(F.floor((F.col(c) - m - reach) / _BLOCK), F.floor((F.col(c) - m + reach) / _BLOCK))
    a = first.select(*keys, F.col("ix").alias("__x"), F.col("iy").alias("__y"), F.col("count").alias("__n"), F.explode(blocks("ix", centre[0])).alias("bx")).withColumn("by", F.explode(blocks("__y", centre[1])))
    b = second.select(*keys, "ix", "iy", "count", F.floor(F.col("ix") / _BLOCK).alias("bx"), F.floor(F.col("iy") / _BLOCK).alias("by"))
    lag = (F.col("__x") - F.col("ix")).alias("lx"), (F.col("__y") - F.col("iy")).alias("ly")
    near = (F.abs(F.col("lx") - centre[0]) <= reach) & (F.abs(F.col("ly") - centre[1]) <= reach)
    pairs = b.join(a, [*keys, "bx", "by"]).select(*keys, *lag, (F.col("count") * F.col("__n")).alias("p")).where(near)
    return pairs.groupBy(*keys, "lx", "ly").agg(F.sum("p").alias("s"))


def median_count(grid: DataFrame, cells: int) -> float:
    """Median of a grid of so many cells, those that are not in the table being 0."""
    filled = grid.count()
    if 2 * filled < cells:
        return 0.0
    found = grid.groupBy("count").agg(F.count("*").alias("n")).orderBy("count").collect()  # one row for each value that a cell has
    values, many = [0, *[r["count"] for r in found]], np.cumsum([cells - filled, *[r["n"] for r in found]])
    at = lambda k: values[int(np.searchsorted(many, k, side="right"))]
    return (at((cells - 1) // 2) + at(cells // 2)) / 2


def _overlap_sums(grid: DataFrame, width: int, height: int, centre: tuple[int, int], sign: int) -> np.ndarray:
    """For each lag the sum of the cells that stay inside the image when moved by sign times the lag."""
    lags = F.array(*[F.struct(F.lit(centre[0] + i).alias("lx"), F.lit(centre[1] + j).alias("ly")) for i in range(-REACH, REACH + 1) for j in range(-REACH, REACH + 1)])
    x, y = F.col("ix") + sign * F.col("l.lx"), F.col("iy") + sign * F.col("l.ly")
    moved = grid.select("ix", "iy", "count", F.explode(lags).alias("l")).where((x >= 0) & (x < width) & (y >= 0) & (y < height))
    return _patch(moved.groupBy("l.lx", "l.ly").agg(F.sum("count").alias("s")), centre)


def _patch(sums: DataFrame, centre: tuple[int, int]) -> np.ndarray:
    out = np.zeros((2 * REACH + 1, 2 * REACH + 1))
    for lx, ly, s in sums.select("lx", "ly", "s").collect():  # 121 rows at most
        out[lx - centre[0] + REACH, ly - centre[1] + REACH] = s
    return out


def xy_offset(first: DataFrame, second: DataFrame, width: int, height: int, expected: tuple[float, float], moves: int = 0) -> tuple[float, float, bool]:
    """How far second must be moved to lie on first, in cells: a Gaussian fitted to the correlation of both, less their medians, around the expected lag.

    A peak near the border of these lags fails. With moves, lags around the highest one
    are looked at next, so many times at most, until a peak is well inside or none of
    them is higher than the middle.
    """
    centre = (round(expected[0]), round(expected[1]))
    a, b = median_count(first, width * height), median_count(second, width * height)
    for left in range(moves, -1, -1):
        patch = _patch(xy_lag_sums(first, second, centre), centre)
        if a:
            patch -= a * _overlap_sums(second, width, height, centre, 1)
        if b:
            patch -= b * _overlap_sums(first, width, height, centre, -1)
        if a and b:
            lags = [np.abs(c + np.arange(-REACH, REACH + 1)) for c in centre]
            patch += a * b * np.outer(np.maximum(width - lags[0], 0), np.maximum(height - lags[1], 0))
        if not patch.any():
            return 0.0, 0.0, False
        fit, success = fit_peak(patch)
        top = tuple(c + int(k) - REACH for c, k in zip(centre, np.unravel_index(patch.argmax(), patch.shape), strict=True))
        if success or not left or top == centre:
            break
        centre = top
    return float(centre[0] + fit[2] - REACH), float(centre[1] + fit[3] - REACH), success


def z_lag_scores(first: DataFrame, second: DataFrame, bins: int, cells: int) -> np.ndarray:
    """Mean product of the planes of both grids at lags -(bins - 1) .. bins - 1 of second against first, less their medians; cells in each plane."""
    b = second.select("ix", "iy", F.col("iz").alias("__z"), F.col("count").alias("__n"))
    pairs = first.join(b, ["ix", "iy"]).groupBy((F.col("__z") - F.col("iz")).alias("lag")).agg(F.sum(F.col("count") * F.col("__n")).alias("s"))
    out = np.zeros(2 * bins - 1)
    for lag, s in pairs.collect():  # a row for each lag
        out[lag + bins - 1] = s
    medians = [median_count(g, cells * bins) for g in (first, second)]
    if any(medians):
        planes = np.zeros((2, bins))
        for k, g in enumerate((first, second)):
            for r in g.groupBy("iz").agg(F.sum("count").alias("s")).collect():  # a row for each plane
                planes[k, r["iz"]] = r["s"]
        for lag in range(-bins + 1, bins):
            low, high = max(0, -lag), min(bins, bins - lag)
            out[lag + bins - 1] += (high - low) * cells * medians[0] * medians[1] - medians[1] * planes[0, low:high].sum() - medians[0] * planes[1, low + lag : high + lag].sum()
    return out / (bins - np.abs(np.arange(-bins + 1, bins)))


def least_squares(model: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], start: np.ndarray, data: np.ndarray, steps: int = 300) -> tuple[np.ndarray, bool]:
    """Parameters by damped Gauss-Newton steps; model gives values and their derivatives."""
    p = np.array(start, float)
    value, jac = model(p)
    error, damping = ((data - value) ** 2).sum(), 1e-3
    for _ in range(steps):
        a = jac.T @ jac
        trial = p + np.linalg.lstsq(a + damping * np.diag(np.diag(a) + 1e-12), jac.T @ (data - value), rcond=None)[0]
        trial_value, trial_jac = model(trial)
        after = ((data - trial_value) ** 2).sum()
        if np.isfinite(after) and after <= error:
            settled = error - after <= 1e-13 * max(error, 1e-300)
            p, value, jac, error, damping = trial, trial_value, trial_jac, after, max(damping * 0.3, 1e-10)
            if settled:
                return p, True
        else:
            damping *= 5
            if damping > 1e14:
                break
    return p, bool(np.isfinite(p).all())


def fit_lorentzian(data: np.ndarray) -> tuple[np.ndarray, bool]:
    """(offset, height, centre, width) of offset + height / pi * width / ((x - centre)^2 + width^2)."""
    x = np.arange(len(data), dtype=float)

    def model(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = x - p[2]
        q = d * d + p[3] * p[3]
        e = p[3] / q / np.pi
        return p[0] + p[1] * e, np.stack([np.ones_like(e), e, p[1] * e * 2 * d / q, p[1] / np.pi * (d * d - p[3] * p[3]) / (q * q)], axis=1)

    return least_squares(model, np.array([data.min(), np.ptp(data), float(data.argmax()), 1.2]), data)


def z_offset(first: DataFrame, second: DataFrame, bins: int, cells: int) -> tuple[float, bool]:
    """How many planes second lies above first: the centre of a Lorentzian, or the only lag with a positive score."""
    scores = z_lag_scores(first, second, bins, cells)
    positive = np.flatnonzero(scores > 0)
    if len(positive) > 1:
        fit, success = fit_lorentzian(scores)
        return float(fit[2]) - bins + 1, success
    return (float(positive[0]) if len(positive) else 0.0) - bins + 1, len(positive) == 1


def bin_edges(length: int, step: int) -> list[int]:
    """Frames at which time bins begin, and the length; the last bin takes what is less than a step."""
    return [*range(0, max(1, length // step) * step, step), length]


def fold_offsets(locs: DataFrame, step: int, length: int, width: int, height: int, scale: int = 2, z_range: tuple[float, float] | None = None) -> list[tuple[float, float, float, float]]:
    """(t, dx, dy, dz) of each time bin: its middle, and what to add to its localizations so that they lie on the master (pixels and microns).

    The first bin with localizations is the master; those before it have no drift. A
    bin whose offset cannot be measured takes the last one and is not added. Without
    z_range dz is 0.
    """
    edges = bin_edges(length, step)
    bins = len(edges) - 1
    z = [F.col("z").cast("double").alias("z")] if z_range else []
    inside = locs.where((F.col("frame") >= 0) & (F.col("frame") < length))
    kept = written(inside.select(time_bin(F.col("frame"), step, length).alias("bin"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), *z).repartitionByRange("bin", "x"), ["bin"])
    w, h = width * scale, height * scale
    z_bins = int((z_range[1] - z_range[0]) / Z_STEP) if z_range else 0
    z_scale = (z_range[1] - z_range[0]) / z_bins if z_range else 0.0

    def flat(rows: DataFrame, dx: float = 0.0, dy: float = 0.0) -> DataFrame:
        return grid_2d(rows, w, h, float(scale), dx, dy)

    def deep(rows: DataFrame, dx: float, dy: float, dz: float) -> DataFrame:
        # z is filtered before it is moved, so that what was out of range stays out
        within = rows.where((F.col("z") > z_range[0]) & (F.col("z") < z_range[1]))
        moved = within.withColumns({"x": F.col("x") + dx, "y": F.col("y") + dy, "z": F.col("z") + dz})
        return grid_3d(moved, w, h, z_range[0], z_range[1], z_bins, float(scale))

    def added(master: DataFrame, more: DataFrame, cells: list[str]) -> DataFrame:
        return checkpointed(master.unionByName(more).groupBy(*cells).agg(F.sum("count").alias("count")))

    out: list[tuple[float, float, float, float]] = []
    master = master_3d = None
    last = [0.0, 0.0, 0.0]  # in cells and planes
    for k in range(bins):
        middle = (edges[k] + edges[k + 1]) / 2
        rows = kept.where(F.col("bin") == k)
        now = checkpointed(flat(rows))
        if master is None:
            if not now.isEmpty():
                master = now
                master_3d = checkpointed(deep(rows, 0.0, 0.0, 0.0)) if z_range else None
            out.append((middle, 0.0, 0.0, 0.0))
            continue
        success = False
        if not now.isEmpty():
            dx, dy, success = xy_offset(master, now, w, h, (out[-1][1] * scale, out[-1][2] * scale))
        if success:
            last[:2] = dx, dy
        dx, dy = last[0] / scale, last[1] / scale
        if success:
            master = added(master, flat(rows, dx, dy), ["ix", "iy"])
        if success and z_range:
            now_3d = checkpointed(deep(rows, dx, dy, 0.0))
            if not now_3d.isEmpty():
                dz, found = z_offset(master_3d, now_3d, z_bins, w * h)
                if found:
                    last[2] = dz
                    master_3d = added(master_3d, deep(rows, dx, dy, -dz * z_scale), ["ix", "iy", "iz"])
        out.append((middle, dx, dy, -last[2] * z_scale if z_range else 0.0))
    return out


def master_drift(locs: DataFrame, step: int, length: int, width: int, height: int, scale: int = 2, z_range: tuple[float, float] | None = None) -> DataFrame:
    """(frame, dx, dy, dz) for frames 0 .. length - 1: what to add to each frame.

    Movies of at most four steps, and those without localizations, have no drift.
    Between the middles of time bins it is linear, and goes on so beyond the ends.
    """
    from glintloom.operators.windows import interpolated

    spark = locs.sparkSession
    if 4 * step >= length or locs.isEmpty():
        return spark.range(length).select(F.col("id").cast("int").alias("frame"), *[F.lit(0.0).alias(f) for f in FIELDS])
    knots = fold_offsets(locs, step, length, width, height, scale, z_range)
    return interpolated(spark.createDataFrame(knots, "t double, dx double, dy double, dz double"), length, list(FIELDS))
