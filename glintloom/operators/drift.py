"""Drift from image correlation, resolution from ring correlation.

Points are gridded by Spark, one sparse image for each time bin. Pairs of images are
correlated side by side, each pair in a task of its own; what comes back is one row a
pair. Only the offsets of bins (tens of numbers) are solved on the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintloom.functions.columns import time_bin
from glintloom.operators.aggregate import grid_2d

REACH = 30


def fit_peak(image: np.ndarray, width: float = 4.0, steps: int = 200) -> tuple[np.ndarray, bool]:
    """Least squares of b + h * exp(-2 ((x - cx)^2 + (y - cy)^2) / w^2) by damped Gauss-Newton: ((b, h, cx, cy, w), success)."""
    gx, gy = np.meshgrid(np.arange(image.shape[0]), np.arange(image.shape[1]), indexing="ij")
    p = np.array([image.min(), image.max() - image.min(), image.shape[0] / 2, image.shape[1] / 2, width], float)
    k = np.unravel_index(image.argmax(), image.shape)
    p[2:4] = k

    def model(q):
        dx, dy = gx - q[2], gy - q[3]
        e = np.exp(-2 * (dx * dx + dy * dy) / q[4] ** 2)
        jac = np.stack([np.ones_like(e), e, q[1] * e * 4 * dx / q[4] ** 2, q[1] * e * 4 * dy / q[4] ** 2, q[1] * e * 4 * (dx * dx + dy * dy) / q[4] ** 3], -1)
        return q[0] + q[1] * e, jac.reshape(-1, 5)

    value, jac = model(p)
    error, damping = ((image - value) ** 2).sum(), 1e-3
    for _ in range(steps):
        a = jac.T @ jac
        try:
            step = np.linalg.solve(a + damping * np.diag(np.diag(a) + 1e-12), jac.T @ (image - value).ravel())
        except np.linalg.LinAlgError:
            return p, False
        trial, trial_jac = model(p + step)
        after = ((image - trial) ** 2).sum()
        if np.isfinite(after) and after <= error:
            done = error - after <= 1e-12 * max(error, 1e-300)
            p, value, jac, error, damping = p + step, trial, trial_jac, after, max(damping * 0.3, 1e-9)
            if done:
                break
        else:
            damping *= 5
            if damping > 1e12:
                break
    return p, bool(np.isfinite(p).all() and 2 <= p[2] <= image.shape[0] - 3 and 2 <= p[3] <= image.shape[1] - 3)


def image_offset(first: np.ndarray, second: np.ndarray, scale: int = 1) -> tuple[float, float, bool]:
    """How far second must be moved to lie on first, in pixels of the images, from the peak of their cross-correlation."""
    a, b = first - np.median(first), second - np.median(second)
    shape = [2 * n for n in a.shape]
    full = np.fft.irfft2(np.fft.rfft2(a, shape) * np.conj(np.fft.rfft2(b, shape)), shape)
    middle = [n // 2 for n in a.shape]
    result = np.roll(full, middle, axis=(0, 1))[: a.shape[0], : a.shape[1]]
    reach = [min(REACH * scale, m - 5) for m in middle]
    part = result[middle[0] - reach[0] : middle[0] + reach[0] + 1, middle[1] - reach[1] : middle[1] + reach[1] + 1]
    k = np.unravel_index(part.argmax(), part.shape)
    at = [max(5, min(int(k[i]) + middle[i] - reach[i], result.shape[i] - 6)) for i in (0, 1)]
    fit, success = fit_peak(result[at[0] - 5 : at[0] + 6, at[1] - 5 : at[1] + 6])
    return at[0] + fit[2] - 5 - middle[0], at[1] + fit[3] - 5 - middle[1], success


def _dense(pdf: pd.DataFrame, width: int, height: int) -> np.ndarray:
    image = np.zeros((width, height))
    image[pdf["ix"].to_numpy(), pdf["iy"].to_numpy()] = pdf["count"].to_numpy()
    return image


def bin_grids(locs: DataFrame, step: int, length: int, width: int, height: int, scale: int) -> DataFrame:
    """(bin, ix, iy, count): a sparse image of each time bin."""
    return grid_2d(locs.withColumn("bin", time_bin(F.col("frame"), step, length)), width * scale, height * scale, float(scale), keys=["bin"])


def pair_offsets(grids: DataFrame, bins: int, width: int, height: int, scale: int) -> DataFrame:
    """(i, j, dx, dy, success) in pixels for all pairs of bins i < j; the two images of a pair meet in one task."""
    others = F.sequence(F.lit(0), F.lit(bins - 1))
    rows = grids.select("bin", "ix", "iy", "count", F.explode(others).alias("other")).where("bin <> other")
    pairs = rows.select(F.least("bin", "other").alias("i"), F.greatest("bin", "other").alias("j"), "bin", "ix", "iy", "count")

    def correlate(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        a, b = (_dense(pdf[pdf["bin"] == k], width * scale, height * scale) for k in (i, j))
        dx, dy, ok = image_offset(a, b, scale)
        return pd.DataFrame({"i": [i], "j": [j], "dx": [dx / scale], "dy": [dy / scale], "success": [ok]})

    return pairs.groupBy("i", "j").applyInPandas(correlate, "i int, j int, dx double, dy double, success boolean")


def redundant_drift(pairs: pd.DataFrame, bins: int, max_error: float = 0.2) -> pd.DataFrame:
    """(bin, dx, dy): drift of each bin against the first, from all pair offsets by least squares.

    Pairs whose residual is over max_error are dropped, worst first, as long as all steps stay determined.
    """
    pairs = pairs[pairs["success"]].sort_values(["i", "j"])
    a = np.zeros((len(pairs), bins - 1))
    for k, (i, j) in enumerate(zip(pairs["i"], pairs["j"], strict=True)):
        a[k, i:j] = 1
    r = pairs[["dx", "dy"]].to_numpy(float)
    error = np.sqrt(((a @ (np.linalg.pinv(a) @ r) - r) ** 2).sum(axis=1))
    keep = np.ones(len(a), bool)
    for k in np.argsort(-error, kind="stable"):
        if error[k] <= max_error:
            break
        keep[k] = False
        keep[k] = np.linalg.matrix_rank(a[keep], tol=1.0) != bins - 1
    steps = np.linalg.pinv(a[keep]) @ r[keep]
    total = np.vstack([np.zeros(2), np.cumsum(steps, axis=0)])
    return pd.DataFrame({"bin": np.arange(bins), "dx": total[:, 0], "dy": total[:, 1]})


def estimate_drift(locs: DataFrame, step: int, length: int, width: int, height: int, scale: int = 2) -> DataFrame:
    """(frame, dx, dy): what to add to each frame so that it lies on the first time bin. Films of under four steps have none."""
    from glintloom.operators.windows import interpolated

    spark = locs.sparkSession
    if 4 * step > length:
        return spark.range(length).select(F.col("id").cast("int").alias("frame"), F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"))
    bins = length // step
    pairs = pair_offsets(bin_grids(locs, step, length, width, height, scale), bins, width, height, scale).toPandas()  # one row a pair of bins
    drift = redundant_drift(pairs, bins)
    edges = [*range(0, bins * step, step), length]
    drift["t"] = [(a + b) / 2 for a, b in zip(edges, edges[1:], strict=False)]
    return interpolated(spark.createDataFrame(drift[["t", "dx", "dy"]]), length, ["dx", "dy"])


def ring_correlation(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Mean over each whole radius of Re(F1 conj F2) / sqrt(|F1|^2 |F2|^2)."""
    f1, f2 = np.fft.fftshift(np.fft.fft2(first)), np.fft.fftshift(np.fft.fft2(second))
    value = np.real(f1 * np.conj(f2)) / np.maximum(np.sqrt(np.abs(f1) ** 2 * np.abs(f2) ** 2), 1e-300)
    dx, dy = np.meshgrid(*[np.arange(n) - n // 2 for n in value.shape], indexing="ij")
    ring = (np.sqrt(dx * dx + dy * dy) + 0.5).astype(int)
    most = min(value.shape) // 2
    inside = ring < most
    return np.bincount(ring[inside], value[inside], most) / np.bincount(ring[inside], minlength=most)


def fourier_ring(points: DataFrame, half: str, width: int, height: int, scale: int, pixel_size: float, keys: list[str]) -> DataFrame:
    """(keys, ring, frequency in 1/nm, correlation) between the images of both halves of the points; one image pair for each key."""
    grids = grid_2d(points, width * scale, height * scale, float(scale), keys=[*keys, half])

    def correlate(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (_dense(pdf[pdf[half] == k], width * scale, height * scale) for k in (0, 1))
        c = ring_correlation(a, b)
        rings = np.arange(len(c))
        return pd.DataFrame({**dict(zip(keys, key, strict=True)), "ring": rings, "frequency": rings / (min(width, height) * pixel_size), "correlation": c})

    kinds = ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in keys)
    return grids.groupBy(*keys).applyInPandas(correlate, f"{kinds}, ring int, frequency double, correlation double")
