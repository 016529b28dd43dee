"""Cells and their clusters against brute force over all triples."""

from __future__ import annotations

import numpy as np
import pytest

from glintloom.operators import tessellation


def brute_cells(x, y):
    """For each point its neighbours and area, from what is left of the bisector with each other point after all third ones cut it."""
    out = []
    for i in range(len(x)):
        sides, area, open_ = set(), 0.0, False
        for j in range(len(x)):
            if i == j:
                continue
            ex, ey = x[j] - x[i], y[j] - y[i]
            size = np.hypot(ex, ey)
            mx, my, ux, uy = ex / 2, ey / 2, -ey / size, ex / size
            low, high = -np.inf, np.inf
            for k in range(len(x)):
                if k in (i, j):
                    continue
                qx, qy = x[k] - x[i], y[k] - y[i]
                rest, slope = (qx * qx + qy * qy) / 2 - (mx * qx + my * qy), ux * qx + uy * qy
                if abs(slope) < 1e-14:
                    if rest < 0:
                        low, high = 1.0, 0.0
                elif slope > 0:
                    high = min(high, rest / slope)
                else:
                    low = max(low, rest / slope)
            if high - low > 1e-9:
                sides.add(j)
                open_ |= not np.isfinite(high - low)
                area += (high - low) * size / 4
        out.append((sides, None if open_ or len(sides) < 3 else area))
    return out


def check(spark, x, y, **more):
    rows = spark.createDataFrame([(int(i), float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id long, x double, y double")
    got = {r.place: r for r in tessellation.cells(rows, "id", **more).collect()}
    want = brute_cells(x, y)
    assert len(got) == len(want)
    for i, (sides, area) in enumerate(want):
        assert set(got[i].neighbours) == sides, i
        assert (got[i].area is None) == (area is None)
        assert area is None or abs(got[i].area / area - 1) < 1e-6


def test_cells_in_one_tile(spark):
    rng = np.random.default_rng(0)
    check(spark, rng.uniform(0, 9, 40), rng.uniform(-4, 4, 40))


@pytest.mark.parametrize("kind", ["uniform", "clusters", "line and dots"])
def test_cells_by_rounds_equal_brute_force(spark, kind):
    rng = np.random.default_rng(1)
    if kind == "uniform":
        x, y = rng.uniform(0, 50, 150), rng.uniform(0, 50, 150)
    elif kind == "clusters":
        centres = rng.uniform(0, 1000, (5, 2))
        x, y = (centres[rng.integers(0, 5, 150)] + rng.normal(0, 1, (150, 2))).T
    else:
        x, y = np.concatenate([np.linspace(0, 100, 90), rng.uniform(0, 100, 40)]), np.concatenate([rng.normal(0, 0.01, 90), rng.uniform(20, 90, 40)])
    check(spark, x, y, last_points=8)


def test_cells_of_odd_tables(spark):
    rows = lambda t: spark.createDataFrame(t, "id long, x double, y double, k int")
    assert tessellation.cells(rows([]), "id").count() == 0
    one = tessellation.cells(rows([(3, 1.0, 1.0, 0), (2, 1.0, 1.0, 0), (4, None, 1.0, 0), (5, float("nan"), 1.0, 0)]), "id").collect()
    assert [(r.place, r.copies, r.area, list(r.neighbours)) for r in one] == [(2, 2, None, [])]
    line = {r.place: r for r in tessellation.cells(rows([(i, float(i), 2.0 * i, 0) for i in range(5)]), "id").collect()}
    assert all(r.area is None for r in line.values()) and set(line[2].neighbours) == {1, 3} and set(line[0].neighbours) == {1}
    grid = [(10 * i + j, float(i), float(j), k) for k in (0, 1) for i in range(5) for j in range(5)]
    got = tessellation.cells(rows(grid), "id", keys=["k"]).collect()
    assert len(got) == 50
    middle = [r for r in got if r.place == 22]
    assert [(r.k, round(r.area, 9), sorted(r.neighbours)) for r in sorted(middle, key=lambda r: r.k)] == [(k, 1.0, [12, 21, 23, 32]) for k in (0, 1)]


def test_ten_clusters_are_found(spark):
    rng = np.random.default_rng(1)
    rows = [(100 * k + i, float(x), float(y)) for k in range(10) for i, (x, y) in enumerate(rng.normal(10.0 * (k + 1), 0.1, (100, 2)))]
    points = spark.createDataFrame(rows, "track_id long, x double, y double")
    got = tessellation.voronoi_clusters(points, "track_id", 0.1, 10).collect()
    sizes = {}
    for r in got:
        if r.cluster_id >= 0:
            sizes.setdefault(r.cluster_id, []).append(r.track_id // 100)
    assert sorted(sizes) == list(range(10))
    assert all(len(v) > 80 and set(v) == {k} for k, v in sizes.items())
    assert tessellation.voronoi_clusters(points.limit(0), "track_id", 0.1, 10).count() == 0


def test_copies_share_a_cell(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 5, (60, 2)))]
    rows += [(100 + i, *rows[30][1:]) for i in range(4)]
    points = spark.createDataFrame(rows, "id long, x double, y double")
    found = tessellation.cells(points, "id")
    density = {r.node: r.density for r in tessellation.densities(points, found, "id").collect()}
    assert len(density) == 64 and len({density[i] for i in (30, 100, 101, 102, 103)}) == 1
    pairs = {(r.a, r.b) for r in tessellation.edges(points, found, "id").collect()}
    assert {(30, 100 + i) for i in range(4)} <= pairs and all(a < b for a, b in pairs)
