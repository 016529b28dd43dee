"""Finding and fitting of emitters in frames.

Frames are independent, so each is a row for mapInPandas. Within a frame: smoothed
background, local maxima of signal over noise above a threshold, then damped Newton fits
of Gaussians, all peaks of the frame in one vector operation per step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

PEAKS = "movie string, frame int, loc_id long, x double, y double, height double, background double, xsigma double, ysigma double, sum double, significance double, error double, iterations int, category int"
MODELS = {"2dfixed": 4, "2d": 5, "3d": 6}


def _blur(image: np.ndarray, sigma: float) -> np.ndarray:
    r = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    padded = np.pad(image, r, mode="reflect" if min(image.shape) > r else "edge")
    return np.apply_along_axis(np.convolve, 1, np.apply_along_axis(np.convolve, 0, padded, k, "valid"), k, "valid")


def maxima(image: np.ndarray, radius: int, threshold: float, margin: int) -> tuple[np.ndarray, np.ndarray]:
    """(y, x) of pixels above threshold that are greatest within radius; of equal ones the last in (y, x) order."""
    order = np.argsort(np.argsort(image.ravel(), kind="stable"), kind="stable").reshape(image.shape)
    padded = np.pad(order, radius, constant_values=-1)
    best = np.ones(image.shape, bool)
    for dy in range(-radius, radius + 1):
        for dx in range(-radius, radius + 1):
            if 0 < dx * dx + dy * dy <= radius * radius:
                best &= order > padded[radius + dy : radius + dy + image.shape[0], radius + dx : radius + dx + image.shape[1]]
    y, x = np.nonzero(best & (image > threshold))
    inside = (y >= margin) & (x >= margin) & (y < image.shape[0] - margin) & (x < image.shape[1] - margin)
    return y[inside], x[inside]


def fit(image: np.ndarray, y: np.ndarray, x: np.ndarray, background: np.ndarray, sigma: float, roi: int = 9, model: str = "2d", steps: int = 60) -> dict[str, np.ndarray]:
    """Maximum-likelihood Gaussians at start points (y, x): height, x, y, background and widths by model, each in its own window."""
    h = roi // 2
    off = np.arange(-h, h + 1)
    gy, gx = np.meshgrid(off, off, indexing="ij")
    cy, cx = np.clip(y, h, image.shape[0] - h - 1), np.clip(x, h, image.shape[1] - h - 1)
    data = np.maximum(image[cy[:, None, None] + gy, cx[:, None, None] + gx], 1e-3)
    n, free = len(y), MODELS[model]
    p = np.stack([np.maximum(image[y, x] - background, 1.0), (x - cx).astype(float), (y - cy).astype(float), np.maximum(background, 0.1), np.full(n, sigma), np.full(n, sigma)], 1)
    damping, used, live = np.full(n, 1.0), np.zeros(n, int), np.ones(n, bool)

    def predict(q):
        sx = q[:, 4, None, None]
        sy = q[:, 5, None, None] if model == "3d" else sx
        dx, dy = gx - q[:, 1, None, None], gy - q[:, 2, None, None]
        e = np.exp(-0.5 * (dx / sx) ** 2 - 0.5 * (dy / sy) ** 2)
        a = q[:, 0, None, None] * e
        parts = [e, a * dx / sx**2, a * dy / sy**2, np.ones_like(e)]
        wx, wy = a * dx * dx / sx**3, a * dy * dy / sy**3
        parts += [] if model == "2dfixed" else [wx + wy] if model == "2d" else [wx, wy]
        return np.maximum(a + q[:, 3, None, None], 1e-3), np.stack(parts, -1)

    def cost(f):
        return 2 * ((f - data) - data * np.log(f / data)).sum(axis=(1, 2))

    value, jac = predict(p)
    error = cost(value)
    for _ in range(steps):
        if not live.any():
            break
        g = ((1 - data / value)[..., None] * jac).sum(axis=(1, 2))
        a = np.einsum("nij,nijk,nijl->nkl", data / value**2, jac, jac)
        d = np.einsum("nkk->nk", a)
        a = a + np.einsum("nk,kl->nkl", damping[:, None] * d + 1e-12, np.eye(free))
        try:
            step = np.linalg.solve(a, g[..., None])[..., 0]
        except np.linalg.LinAlgError:
            break
        trial = p.copy()
        trial[:, :free] -= np.clip(step, -np.maximum(np.abs(p[:, :free]), 1.0), np.maximum(np.abs(p[:, :free]), 1.0))
        trial[:, 4:] = np.clip(trial[:, 4:], 0.5 * sigma, 5 * sigma)
        v, j = predict(trial)
        after = cost(v)
        better = live & np.isfinite(after) & (after <= error)
        done = better & (error - after <= 1e-6 * np.maximum(error, 1e-12))
        p[better], value[better], jac[better] = trial[better], v[better], j[better]
        error = np.where(better, after, error)
        damping = np.where(better, np.maximum(damping * 0.75, 1e-3), damping * 4)
        used += live
        live &= ~done & (damping < 1e20)
    shape = np.exp(-0.5 * ((gx - p[:, 1, None, None]) / p[:, 4, None, None]) ** 2 - 0.5 * ((gy - p[:, 2, None, None]) / (p[:, 5] if model == "3d" else p[:, 4])[:, None, None]) ** 2)
    s1, s2 = shape.sum(axis=(1, 2)), (shape**2).sum(axis=(1, 2))
    fg = p[:, 0] * s2 / s1
    bg = (np.maximum(p[:, 3], 0.1)[:, None, None] * shape**2).sum(axis=(1, 2)) / s1**2
    return {"x": p[:, 1] + cx, "y": p[:, 2] + cy, "height": p[:, 0], "background": p[:, 3], "xsigma": p[:, 4], "ysigma": p[:, 5] if model == "3d" else p[:, 4], "sum": p[:, 0] * s1, "significance": fg / np.sqrt(bg), "error": error, "iterations": used}


def find_and_fit(image: np.ndarray, sigma: float = 1.0, threshold: float = 6.0, radius: int = 5, model: str = "2d", passes: int = 3, margin: int = 6) -> dict[str, np.ndarray]:
    """Peaks of one calibrated frame; later passes look in what earlier fits leave."""
    found, rest = None, image.astype(float)
    for level in range(passes, 0, -1):
        background = _blur(np.minimum(rest, np.percentile(rest, 95)), 8.0)
        noise = np.sqrt(np.maximum(0.1, background) * 1.0 / (4 * np.pi * sigma**2))
        y, x = maxima((_blur(rest, sigma) - background) / noise, radius, threshold + level - 1, margin)
        if found is not None and len(y):
            near = ((y[:, None] - found["y"][None]) ** 2 + (x[:, None] - found["x"][None]) ** 2).min(axis=1) <= (0.7 * radius) ** 2
            y, x = y[~near], x[~near]
        if not len(y):
            continue
        start_y = np.concatenate([y, np.rint(found["y"]).astype(int)]) if found is not None else y
        start_x = np.concatenate([x, np.rint(found["x"]).astype(int)]) if found is not None else x
        start_y, start_x = np.clip(start_y, 0, image.shape[0] - 1), np.clip(start_x, 0, image.shape[1] - 1)
        found = fit(image, start_y, start_x, background[start_y, start_x], sigma, model=model)
        gy, gx = np.mgrid[: image.shape[0], : image.shape[1]]
        rest = image.astype(float).copy()
        for k in range(len(found["x"])):
            b = int(6 * sigma) + 2
            cy, cx = int(found["y"][k]), int(found["x"][k])
            w = np.s_[max(0, cy - b) : cy + b + 1, max(0, cx - b) : cx + b + 1]
            rest[w] -= found["height"][k] * np.exp(-0.5 * ((gx[w] - found["x"][k]) / found["xsigma"][k]) ** 2 - 0.5 * ((gy[w] - found["y"][k]) / found["ysigma"][k]) ** 2)
    return found or {k: np.zeros(0) for k in ("x", "y", "height", "background", "xsigma", "ysigma", "sum", "significance", "error", "iterations")}


def localize(frames: DataFrame, gain: float = 1.0, offset: float = 0.0, **settings: object) -> DataFrame:
    """Localizations of all frames (movie, frame, height, width, pixels), in photo-electrons."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                image = np.maximum((np.frombuffer(r.pixels, "<i4").reshape(r.height, r.width) - offset) * gain, 1.0)
                peaks = find_and_fit(image, **settings)
                yield pd.DataFrame({"movie": r.movie, "frame": r.frame, "loc_id": np.arange(len(peaks["x"])), **peaks, "category": 1}).astype({"iterations": "int32", "frame": "int32", "category": "int32"})[[c.split()[0] for c in PEAKS.split(", ")]]

    return frames.mapInPandas(run, PEAKS)
