"""Maps between lists of points: found, scored, refined, and refused where there is none."""

from __future__ import annotations

import math

import numpy as np

from glintloom.operators import micrometry as M
from glintloom.operators.spatial import quads

BACKGROUND = 1.0 / (512 * 512)


def lists(spark, parts):
    rows = [(k, i, float(x), float(y)) for k, points in parts.items() for i, (x, y) in enumerate(points)]
    return spark.createDataFrame(rows, "fov int, id long, x double, y double")


def moved(points, angle=0.4, size=1.2, shift=(30.0, -12.0), mirror=False):
    m = size * np.array([[math.cos(angle), -math.sin(angle)], [math.sin(angle), math.cos(angle)]])
    m = m @ np.diag([1, -1]) if mirror else m
    return points @ m.T + shift, m, np.array(shift)


def test_same_list_gives_the_identity(spark):
    points = np.random.default_rng(0).uniform(0, 512, (50, 2))
    one = lists(spark, {0: points})
    (best,) = M.best_maps(one, one, "id", ["fov"], BACKGROUND, 5.0, 100.0, 20).collect()
    assert best.score > M.GOOD
    assert np.allclose([best[m] for m in M.MAP], [0, 1, 0, 0, 0, 1], atol=1e-6)
    (fine,) = M.refined_maps(M.best_maps(one, one, "id", ["fov"], BACKGROUND, 5.0, 100.0, 20), one, one, "id", ["fov"]).collect()
    assert fine.n == 50 and np.allclose([fine[f"back_{m}"] for m in M.MAP], [0, 1, 0, 0, 0, 1], atol=1e-9)


def test_random_lists_score_low(spark):
    rng = np.random.default_rng(0)
    one, two = (lists(spark, {0: rng.uniform(0, 512, (50, 2))}) for _ in range(2))
    assert all(r.score < M.GOOD for r in M.best_maps(one, two, "id", ["fov"], BACKGROUND, 5.0, 100.0, 20).collect())


def test_many_fields_of_view_at_once(spark):
    rng = np.random.default_rng(3)
    first, second, truth = {}, {}, {}
    for k in range(4):
        points = rng.uniform(0, 300, (40, 2))
        there, m, shift = moved(points[:32] + rng.normal(0, 0.05, (32, 2)), 0.3 * k, 1 + 0.1 * k, (5.0 * k, -7.0), mirror=k == 2)
        first[k], second[k], truth[k] = points, np.vstack([there, rng.uniform(0, 300, (5, 2))]), (m, shift)
    first[9], second[8] = rng.uniform(0, 300, (40, 2)), rng.uniform(0, 300, (40, 2))  # without a partner
    one, two = lists(spark, first), lists(spark, second)
    best = M.best_maps(one, two, "id", ["fov"], 1 / 90000, 5.0, 150.0, 8)
    got = {r.fov: r for r in M.refined_maps(best, one, two, "id", ["fov"]).collect()}
    assert sorted(got) == [0, 1, 2, 3]
    for k, r in got.items():
        m, shift = truth[k]
        back = np.array([[r.back_xx, r.back_xy], [r.back_yx, r.back_yy]])
        assert r.n >= 31 and np.allclose(back, m, atol=2e-3) and np.allclose([r.back_x0, r.back_y0], shift, atol=0.3)
        assert np.allclose(np.array([[r.xx, r.xy], [r.yx, r.yy]]) @ back, np.eye(2), atol=1e-3)


def test_scores_match_brute_force(spark):
    rng = np.random.default_rng(5)
    a, b = rng.uniform(0, 60, (30, 2)), rng.uniform(0, 60, (20, 2))
    one, two = lists(spark, {0: a}), lists(spark, {0: b})
    maps = [(0, k, float(rng.normal(0, 2)), 1.0, 0.1 * k, float(rng.normal(0, 2)), -0.1 * k, 1.0) for k in range(4)] + [(0, 4, 1e6, 1.0, 0.0, 0.0, 0.0, 1.0)]
    table = spark.createDataFrame(maps, "fov int, id long, x0 double, xx double, xy double, y0 double, yx double, yy double").withColumnRenamed("id", "map")
    got = {r.map: r.score for r in M.scores(table, one, two, "id", "map", 1e-3, ["fov"]).collect()}
    for _, k, x0, xx, xy, y0, yx, yy in maps:
        p = np.stack([x0 + xx * b[:, 0] + xy * b[:, 1], y0 + yx * b[:, 0] + yy * b[:, 1]], axis=1)
        d2 = ((p[:, None] - a[None]) ** 2).sum(axis=2).min(axis=1)
        assert abs(got[k] - math.log((1e-3 + (1 - 1e-3) * np.exp(-d2 / 2).mean()) / 1e-3)) < 1e-9


def test_hypotheses_are_least_squares_of_four_points(spark):
    rng = np.random.default_rng(7)
    points = rng.uniform(0, 100, (12, 2))
    there, _, _ = moved(points)
    one, two = lists(spark, {0: points, 1: np.arange(12)[:, None] * np.ones(2)}), lists(spark, {0: there, 1: np.arange(12)[:, None] * np.ones(2)})
    found = [quads(t, "id", 1.0, 200.0, 6, ["fov"]) for t in (one, two)]
    matches = M.all_matches(*found, 0.01, ["fov"])
    rows = M.hypotheses(matches, one, two, "id", ["fov"]).collect()
    assert rows and {r.fov for r in rows} == {0}  # points on a line make no map
    for r in rows:
        p1, p2 = (np.array([t[r[f"{c}{k}"]] for c in "abcd"]) for k, t in ((1, points), (2, there)))
        want = np.linalg.lstsq(np.column_stack([np.ones(4), p2]), p1, rcond=None)[0]
        assert np.allclose([[r.x0, r.y0], [r.xx, r.yx], [r.xy, r.yy]], want, atol=1e-6)


def test_empty_lists_have_no_maps(spark):
    one = lists(spark, {0: np.random.default_rng(1).uniform(0, 50, (9, 2))})
    assert M.best_maps(one, one.limit(0), "id", ["fov"], BACKGROUND).count() == 0
