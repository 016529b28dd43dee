"""Sparse deconvolution of frames: non-negative x whose blurred image fits the frame.

A solver is a function (frame, response, steps, weight) -> x; SOLVERS names those there
are, and more can be passed. Frames come as arrays of pixels, one row each, and are
solved inside Arrow batches, so a movie is spread over all tasks. Blurring is periodic.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Solver = Callable[[np.ndarray, np.ndarray, int, float], np.ndarray]


def _blur(x: np.ndarray, response: np.ndarray) -> np.ndarray:
    return np.fft.irfft2(np.fft.rfft2(x) * response, s=x.shape)


def fista(frame: np.ndarray, response: np.ndarray, steps: int, weight: float) -> np.ndarray:
    """Proximal gradient steps with momentum for 1/2 |Ax - b|^2 + weight * sum(x), x >= 0."""
    rate = 1 / float((np.abs(response) ** 2).max())
    x = y = np.zeros_like(frame)
    t = 1.0
    for _ in range(steps):
        new = np.maximum(y - rate * (_blur(_blur(y, response) - frame, response.conj()) + weight), 0)
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        x, y = new, new + (last - 1) / t * (new - x)
    return x


def admm(frame: np.ndarray, response: np.ndarray, steps: int, weight: float, penalty: float = 0.1) -> np.ndarray:
    """The same problem, split into a least-squares part solved in Fourier space and a non-negative one."""
    inverse = 1 / (np.abs(response) ** 2 + penalty)
    fixed = _blur(frame, response.conj())
    z = u = np.zeros_like(frame)
    for _ in range(steps):
        x = np.fft.irfft2(np.fft.rfft2(fixed + penalty * (z - u)) * inverse, s=frame.shape)
        z = np.maximum(x + u - weight / penalty, 0)
        u = u + x - z
    return z


def mlem(frame: np.ndarray, response: np.ndarray, steps: int, weight: float) -> np.ndarray:
    """Multiplicative maximum-likelihood steps for Poisson noise; weight counts towards the sensitivity."""
    seen = float(response.flat[0].real) + weight
    x = np.full_like(frame, max(frame.mean(), 1e-12))
    for _ in range(steps):
        x = x * np.maximum(_blur(np.maximum(frame, 0) / np.maximum(_blur(x, response), 1e-12), response.conj()), 0) / seen
    return x


SOLVERS: dict[str, Solver] = {"fista": fista, "admm": admm, "mlem": mlem}


def deconvolved(frames: DataFrame, psf: np.ndarray, solver: str | Solver = "fista", steps: int = 100, weight: float = 0.0, least: float = 0.0) -> DataFrame:
    """(frame, y, x, value): the pixels of each solution above `least`. frames has frame, height, width and pixels (array of double, row by row).

    psf is a small image with its peak in the middle. Frames without pixels give nothing.
    """
    solve = SOLVERS[solver] if isinstance(solver, str) else solver

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                if row.pixels is None or not len(row.pixels):
                    continue
                image = np.asarray(row.pixels, dtype=float).reshape(row.height, row.width)
                kernel = np.zeros_like(image)
                kernel[: psf.shape[0], : psf.shape[1]] = psf
                kernel = np.roll(kernel, (-(psf.shape[0] // 2), -(psf.shape[1] // 2)), (0, 1))
                x = solve(image, np.fft.rfft2(kernel), steps, weight)
                ys, xs = np.nonzero(x > least)
                yield pd.DataFrame({"frame": row.frame, "y": ys.astype("int32"), "x": xs.astype("int32"), "value": x[ys, xs]})

    return frames.select("frame", "height", "width", "pixels").mapInPandas(run, "frame int, y int, x int, value double")
