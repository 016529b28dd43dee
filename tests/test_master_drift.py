"""Drift against a growing master: lag sums by brute force, offsets and series as made."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from glintloom.operators import master_drift as M


def table(spark, grid):
    cells = [(int(i), int(j), int(grid[i, j])) for i, j in np.argwhere(grid)]
    return spark.createDataFrame(cells, "ix int, iy int, count long")


@pytest.mark.parametrize(("density", "centre"), [(0.05, (0, 0)), (0.3, (3, -7)), (0.9, (-2, 1))])
def test_lag_sums_with_and_without_medians(spark, density, centre):
    rng = np.random.default_rng(0)
    a, b = ((rng.random((37, 50)) < density) * rng.integers(1, 5, (37, 50)) for _ in range(2))
    ta, tb = table(spark, a), table(spark, b)
    got = {(r.lx, r.ly): r.s for r in M.xy_lag_sums(ta, tb, centre).collect()}
    patch = M._patch(M.xy_lag_sums(ta, tb, centre), centre)
    medians = [M.median_count(t, a.size) for t in (ta, tb)]
    assert medians == [np.median(a), np.median(b)]
    assert (medians[0] > 0) == (density > 0.5)
    if medians[0]:
        patch = patch - medians[0] * M._overlap_sums(tb, 37, 50, centre, 1) - medians[1] * M._overlap_sums(ta, 37, 50, centre, -1)
        for k, c in enumerate(centre):
            assert abs(c) < a.shape[k]
    for lx in range(centre[0] - 5, centre[0] + 6):
        for ly in range(centre[1] - 5, centre[1] + 6):
            one, two = a[max(lx, 0) : 37 + min(lx, 0), max(ly, 0) : 50 + min(ly, 0)], b[max(-lx, 0) : 37 + min(-lx, 0), max(-ly, 0) : 50 + min(-ly, 0)]
            assert got.get((lx, ly), 0) == (one * two).sum()
            want = ((one - medians[0]) * (two - medians[1])).sum()
            here = patch[lx - centre[0] + 5, ly - centre[1] + 5] + medians[0] * medians[1] * one.size
            assert abs(here - want) < 1e-9


def test_z_scores_with_and_without_medians(spark):
    rng = np.random.default_rng(1)
    for density in (0.1, 0.8):
        a, b = ((rng.random((6, 7, 9)) < density) * rng.integers(1, 4, (6, 7, 9)) for _ in range(2))
        rows = lambda g: spark.createDataFrame([(int(i), int(j), int(k), int(g[i, j, k])) for i, j, k in np.argwhere(g)], "ix int, iy int, iz int, count long")
        got = M.z_lag_scores(rows(a), rows(b), 9, 42)
        p, q = a - np.median(a), b - np.median(b)
        want = [(p[:, :, max(0, -g) : min(9, 9 - g)] * q[:, :, max(0, g) : min(9, 9 + g)]).sum() / (9 - abs(g)) for g in range(-8, 9)]
        assert np.allclose(got, want)


def test_lorentzian_is_fitted():
    x = np.arange(79.0)
    fit, ok = M.fit_lorentzian(3 + 200 / np.pi * 2.5 / ((x - 45.3) ** 2 + 2.5**2))
    assert ok and np.allclose(fit[:3], [3, 200, 45.3]) and abs(fit[3]) == pytest.approx(2.5)


def cloud(seed=0, n=500):
    rng = np.random.default_rng(seed)
    return rng.normal(10.0, 0.2, n), rng.normal(10.0, 0.2, n), rng.normal(0.0, 0.05, n)


def test_offset_in_x_and_its_direction(spark):
    x, y, _ = cloud()
    rows = lambda dx: spark.createDataFrame([(float(a + dx), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double")
    grid = lambda dx: M.grid_2d(rows(dx), 40, 40, 2.0)
    dx, dy, ok = M.xy_offset(grid(0), grid(1.0), 40, 40, (0, 0))
    assert ok and abs(dx / 2 + 1) < 1e-6 and abs(dy) < 1e-6
    dx, dy, ok = M.xy_offset(grid(0), M.grid_2d(rows(1.0), 40, 40, 2.0, dx / 2, dy / 2), 40, 40, (0, 0))
    assert ok and abs(dx) < 1e-6 and abs(dy) < 1e-6


def test_offset_in_z_and_its_direction(spark):
    x, y, z = cloud()
    rows = lambda dz: spark.createDataFrame([(float(a), float(b), float(c + dz)) for a, b, c in zip(x, y, z, strict=True)], "x double, y double, z double")
    grid = lambda dz: M.grid_3d(rows(dz), 40, 40, -1.0, 1.0, 40, 2.0)
    dz, ok = M.z_offset(grid(0.0), grid(0.3), 40, 1600)
    assert ok and abs(dz * 0.05 / 0.3 - 1) < 0.1
    again, ok = M.z_offset(grid(0.0), grid(0.3 - dz * 0.05), 40, 1600)
    assert ok and abs(again * 0.05) < 0.1


def test_short_and_empty_movies_have_no_drift(spark):
    schema = "frame int, x double, y double"
    short = M.master_drift(spark.createDataFrame([(0, 1.0, 1.0), (2, 1.0, 1.0)], schema), 500, 100, 128, 128)
    empty = M.master_drift(spark.createDataFrame([], schema), 10, 100, 128, 128)
    for d in (short, empty):
        assert d.count() == 100 and d.where("dx <> 0 OR dy <> 0 OR dz <> 0").count() == 0


def test_edges_of_time_bins():
    assert M.bin_edges(1050, 500) == [0, 500, 1050] and M.bin_edges(1000, 500) == [0, 500, 1000] and M.bin_edges(300, 500) == [0, 300]


def test_drift_of_a_series_is_recovered(spark):
    rng = np.random.default_rng(0)
    length, total = 2000, np.array([0.8, 1.5, 0.2])
    centres = np.stack([rng.uniform(20, 76, 60), rng.uniform(20, 76, 60), rng.uniform(-0.3, 0.3, 60)])
    rows = []
    for f in range(length):
        if 800 <= f < 1000:
            continue  # a bin without localizations takes the offset before
        on = rng.random(60) < 0.1
        p = centres[:, on] + (total * f / length)[:, None] + rng.normal(0, 1, (3, on.sum())) * np.array([[0.3], [0.3], [0.05]])
        rows += [(f, *map(float, q)) for q in p.T]
    locs = spark.createDataFrame(rows, "frame int, x double, y double, z double").repartition(4)
    got = M.master_drift(locs, 200, length, 96, 96, 2, (-0.6, 0.6)).orderBy("frame").toPandas()
    assert len(got) == length
    middle = got[(got.frame >= 100) & ((got.frame < 700) | (got.frame > 1150))]
    for k, (name, slack) in enumerate((("dx", 0.2), ("dy", 0.2), ("dz", 0.04))):
        # offsets are against the first bin, whose middle is frame 100
        want = -total[k] * (middle.frame - 100) / length
        assert np.abs(middle[name] - want).max() < slack, name
    gap = got[got.frame == 900].iloc[0]
    before = got[got.frame == 700].iloc[0]
    assert gap.dx == pytest.approx(before.dx) and gap.dz == pytest.approx(before.dz)
    plain = M.master_drift(locs.where(F.col("frame") >= 400).drop("z"), 200, length, 96, 96)
    assert plain.where("dz <> 0").count() == 0
    first = plain.where("frame = 300").first()
    assert first.dx == 0 and first.dy == 0  # nothing before the first localizations
