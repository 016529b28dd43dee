"""Axial calibration: width curves over z, and the tilt of the sample."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintloom.operators.filters import without_outliers


def width_by_z(locs: DataFrame, step: float) -> DataFrame:
    """(z, wx, wy, n): mean widths (2 sigma) of bins of the stage z; the bins are few."""
    z = (F.floor(F.col("stage_z") / step) + 0.5) * step
    return locs.groupBy(z.alias("z")).agg((2 * F.avg("xsigma")).alias("wx"), (2 * F.avg("ysigma")).alias("wy"), F.count("*").alias("n"))


def fit_width_curve(z: np.ndarray, w: np.ndarray, n: np.ndarray, terms: int = 2, steps: int = 300) -> np.ndarray:
    """(w0, c, d, A, B ...) of w0 sqrt(1 + X^2 + A X^3 + ...), X = (z - c) / d, by damped Gauss-Newton with numerical slopes."""
    p = np.concatenate([[3.0, 0.0, 0.5], np.zeros(terms)])
    p[0], p[1] = w.min(), z[w.argmin()]

    def curve(q):
        x = (z - q[1]) / q[2]
        inner = 1 + x * x + sum(a * x**k for k, a in enumerate(q[3:], 3))
        return q[0] * np.sqrt(np.maximum(inner, 1e-9))

    weight, damping = np.sqrt(n / n.max()), 1e-2
    rest = weight * (w - curve(p))
    for _ in range(steps):
        jac = np.stack([weight * (curve(p + h) - curve(p - h)) / 2e-6 for h in 1e-6 * np.eye(len(p))], 1)
        a = jac.T @ jac
        step = np.linalg.lstsq(a + damping * np.diag(np.diag(a) + 1e-12), jac.T @ rest, rcond=None)[0]
        after = weight * (w - curve(p + step))
        if np.isfinite(after).all() and (after**2).sum() < (rest**2).sum():
            done = (rest**2).sum() - (after**2).sum() < 1e-14
            p, rest, damping = p + step, after, max(damping * 0.3, 1e-9)
            if done:
                break
        else:
            damping *= 4
            if damping > 1e10:
                break
    return p


def calibrate(locs: DataFrame, step: float = 0.02, terms: int = 2, outliers: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """Width curves of x and y from localizations with a stage z, fitted again without outliers. Bins of z come to the driver, rows do not."""

    def curves(rows: DataFrame) -> list[np.ndarray]:
        bins = width_by_z(rows, step).orderBy("z").toPandas()
        return [fit_width_curve(bins["z"].to_numpy(), bins[k].to_numpy(), bins["n"].to_numpy(float), terms) for k in ("wx", "wy")]

    first = curves(locs)
    value = [p[0] * F.sqrt(F.lit(1.0) + F.pow((F.col("stage_z") - p[1]) / p[2], 2) + sum((float(a) * F.pow((F.col("stage_z") - p[1]) / p[2], k) for k, a in enumerate(p[3:], 3)), F.lit(0.0))) for p in ([float(v) for v in q] for q in first)]
    rest = locs.withColumns({"__rx": 2 * F.col("xsigma") - value[0], "__ry": 2 * F.col("ysigma") - value[1]})
    kept = without_outliers(rest, ["__rx", "__ry"], outliers).drop("__rx", "__ry")
    return tuple(curves(kept))


def fit_tilt(locs: DataFrame) -> tuple[float, float, float]:
    """(t0, tx, ty): least squares of stage_z - z on (1, x, y), from sums."""
    from glintloom.operators.spatial import affine_fit

    return affine_fit(locs.select((F.col("stage_z") - F.col("z")).alias("x1"), F.lit(0.0).alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2")))["x"]
