"""Wavelet background: the filter's laws, a direct filter bank, and iterations."""

from __future__ import annotations

import numpy as np
import pytest

from glintloom.operators import wavelet as W


@pytest.mark.parametrize("n", [1, 2, 3, 4, 6])
def test_scaling_filters_are_orthogonal_with_vanishing_moments(n):
    h = W.daubechies(n)
    assert len(h) == 2 * n and h.sum() == pytest.approx(np.sqrt(2))
    for k in range(n):
        assert np.dot(h[: 2 * n - 2 * k], h[2 * k :]) == pytest.approx(float(k == 0), abs=1e-9)
        # the high-pass filter does not see polynomials
        assert sum((-1) ** i * h[i] * i**k for i in range(2 * n)) == pytest.approx(0, abs=1e-6)
    if n == 2:
        r = np.sqrt(3)
        assert np.allclose(h, np.array([1 + r, 3 + r, 3 - r, 1 - r]) / (4 * np.sqrt(2)))


def straight(x, h, level):
    """The same by convolution of one line, extended and cut anew at every level."""
    size, lengths = len(h), []
    for _ in range(level):
        lengths.append(len(x))
        i = np.arange(1, size + 1)
        wide = np.concatenate([(x[0] + i * (x[0] - x[1]))[::-1], x, x[-1] + i * (x[-1] - x[-2])])
        x = np.convolve(wide, h[::-1])[size + 1 : size + 1 + 2 * ((len(x) + size - 1) // 2) : 2]
    for n in reversed(lengths):
        up = np.zeros(2 * len(x) - 1)
        up[::2] = x
        x = np.convolve(up, h)[size - 2 : 2 * len(x)][:n]
    return x


@pytest.mark.parametrize(("n", "level"), [(16, 1), (33, 2), (64, 3)])
def test_matrix_equals_the_filter_bank(n, level):
    x = np.random.default_rng(0).normal(size=n)
    assert np.allclose(W.smoothing_matrix(n, level) @ x, straight(x, W.daubechies(4), level), atol=1e-9)


@pytest.mark.parametrize("level", [1, 2])
def test_straight_lines_stay(level):
    m = W.smoothing_matrix(40, level)
    assert np.allclose(m @ np.arange(40.0), np.arange(40.0), atol=1e-7) and np.allclose(m.sum(axis=1), 1, atol=1e-9)


def test_background_of_images(spark):
    rng = np.random.default_rng(1)
    y, x = np.mgrid[:24, :30]
    images = {}
    for k in range(2):
        image = 100 + 2.0 * x + k * y + rng.normal(0, 1, (24, 30))
        image[10:12, 14:16] += 200
        images[k] = image
    rows = [(k, int(i), int(j), float(images[k][i, j])) for k in images for i in range(24) for j in range(30)]
    got = W.wavelet_background(spark.createDataFrame(rows, "frame int, y int, x int, value double"), 24, 30, 4, 10.0, 2, ["frame"]).toPandas()
    assert len(got) == len(rows)
    a, b = W.smoothing_matrix(24, 2), W.smoothing_matrix(30, 2)
    for k, image in images.items():
        now = image.copy()
        for _ in range(4):
            low = a @ now @ b.T
            now = np.where(now > low + 10, low, now)
        part = got[got.frame == k]
        assert np.allclose(part.background, low[part.y, part.x], atol=1e-8)
        assert abs(low[11, 15] - (100 + 30 + 11 * k)) < 25
