"""Stacks aligned to parts of a voxel, and filters of what changes in a movie, against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from glintloom.operators import image, stacks

SHAPE = (12, 26, 28)


def blobs(shift=(0, 0, 0), shape=SHAPE):
    """Gaussians in a stack, moved by shift."""
    rng = np.random.default_rng(5)
    grid = np.meshgrid(*[np.arange(n) for n in shape], indexing="ij")
    out = np.zeros(shape)
    for _ in range(6):
        at = [rng.uniform(0.35 * n, 0.65 * n) + d if n > 1 else 0 for n, d in zip(shape, shift)]
        out += rng.uniform(2, 5) * np.exp(-sum((g - c) ** 2 for g, c in zip(grid, at)) / (2 * 1.2**2))
    return out


def table(spark, a):
    return spark.createDataFrame([(int(z), int(y), int(x), float(a[z, y, x])) for z, y, x in np.argwhere(a > 1e-9)], "z int, y int, x int, value double")


def test_lag_sums_match_brute_force(spark):
    rng = np.random.default_rng(1)
    a, b = (np.where(rng.random((5, 20, 37)) < 0.2, rng.integers(1, 9, (5, 20, 37)), 0).astype(float) for _ in range(2))
    got = {tuple(r[:3]): r.s for r in stacks.lag_sums(table(spark, a), table(spark, b), (1, -3, 2), (1, 2, 3)).collect()}
    want = {}
    for lag in np.ndindex(3, 5, 7):
        l = np.array(lag) - (1, 2, 3) + (1, -3, 2)
        s = sum(a[tuple(p + l)] * b[tuple(p)] for p in np.argwhere(b) if all(0 <= q < n for q, n in zip(p + l, a.shape)))
        if s:
            want[tuple(int(v) for v in l)] = s
    assert got == pytest.approx(want)


def test_derivatives_match_differences():
    rng = np.random.default_rng(2)
    patch, d, h = rng.random((11, 11, 11)), np.array([0.3, -0.2, 0.0]), 1e-5
    value, gradient, hessian = stacks.product_at(patch, d)
    for i in range(3):
        e = np.eye(3)[i] * h
        up, down = stacks.product_at(patch, d + e), stacks.product_at(patch, d - e)
        assert (up[0] - down[0]) / (2 * h) == pytest.approx(gradient[i], abs=1e-5)
        assert (up[1] - down[1]) / (2 * h) == pytest.approx(hessian[i], abs=1e-5)


@pytest.mark.parametrize("shift", [(0.1, 0.1, -0.1), (1.3, -5.6, 3.2)])
def test_stacks_are_aligned(spark, shift):
    first, second = blobs(), blobs(shift)
    found = stacks.align(table(spark, first), table(spark, second), SHAPE)
    assert found.shift == pytest.approx([-x for x in shift], abs=0.01) and found.quality > 10
    assert found.score == pytest.approx((first**2).sum(), rel=0.01)
    moved = np.zeros(SHAPE)
    for r in stacks.translated(table(spark, second), found.shift, SHAPE).collect():
        moved[r.z, r.y, r.x] = r.value
    assert np.abs(moved - first).max() < 0.03 * first.max()


def test_plain_images_are_aligned(spark):
    shape = (1, 30, 40)
    found = stacks.align(table(spark, blobs(shape=shape)), table(spark, blobs((0, 2.4, -4.7), shape)), shape)
    assert found.shift == pytest.approx([0, -2.4, 4.7], abs=0.01)


def test_stacks_without_anything_are_refused(spark):
    a = table(spark, blobs())
    with pytest.raises(ValueError):
        stacks.align(a, a.limit(0), SHAPE)


def movie(rng):
    """(m, frame, y, x, value) with pixels that stay, drift, jump, and are missing in some frames."""
    rows, value = [], {}
    for f in [*range(3, 12), 20, 21]:
        for y in range(6):
            for x in range(7):
                value[y, x] = value.get((y, x), 5.0) + rng.choice([0, 0, 0, 0.5, -0.5, 3.0])
                if rng.random() < 0.9:
                    rows.append((1, f, y, x, value[y, x]))
    return rows


KERNEL = [(0, 0, 0.5), (0, 1, 0.25), (-1, 0, 0.25), (2, -1, -0.1)]


@pytest.mark.parametrize("max_diff", [0.0, 0.7])
def test_changes_of_a_filter_match_a_serial_pass(spark, max_diff):
    rows = movie(random.Random(4))
    got = image.each_frame(image.filtered_changes(spark.createDataFrame(rows, "m int, frame int, y int, x int, value double"), KERNEL, 6, 7, ["m"], max_diff=max_diff))
    got = {(r.frame, r.y, r.x): r.value for r in got.collect()}
    used, want = {}, {}
    for _, f, y, x, v in rows:
        last = used.get((y, x))
        if last is None or last[0] != f - 1 or abs(v - last[1]) > max_diff:
            last = (f, v)
        used[y, x] = (f, last[1])
        for dy, dx, w in KERNEL:
            at = (f, (y + dy) % 6, (x + dx) % 7)
            want[at] = want.get(at, 0) + w * last[1]
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_only_changes_make_rows(spark):
    rows = [(f, 0, 0, 1.0) for f in range(500)] + [(f, 3, 3, float(f >= 250)) for f in range(500)]
    found = image.filtered_changes(spark.createDataFrame(rows, "frame int, y int, x int, value double"), [(0, 0, 2.0)], 5, 5, [])
    assert sorted((r.y, r.x, r.frame, r.until, r.value) for r in found.collect()) == [(0, 0, 0, 500, 2.0), (3, 3, 0, 250, 0.0), (3, 3, 250, 500, 2.0)]
    assert image.filtered_changes(found.withColumn("value", found["value"]).limit(0), KERNEL, 5, 5, []).count() == 0
