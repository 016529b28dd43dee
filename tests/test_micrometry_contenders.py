import numpy as np
import pytest

from glintloom.operators import micrometry as M

CORNERS = "struct<a1:long,b1:long,c1:long,d1:long,a2:long,b2:long,c2:long,d2:long>"


def lists_and_maps(spark, true_map):
    rng = np.random.default_rng(11)
    points = [(key, k, float(x), float(y)) for key in ("p", "q") for k, (x, y) in enumerate(rng.uniform(0, 300, (150, 2)))]
    one = spark.createDataFrame(points, "key string, id long, x double, y double")
    two = spark.createDataFrame([(key, k, x + 30, y - 20) for key, k, x, y in points if k % 5], "key string, id long, x double, y double")
    rows = [(key, (j,) * 8, float(rng.uniform(-60, 60)), 1.0, 0.0, float(rng.uniform(-60, 60)), 0.0, 1.0) for key in ("p", "q") for j in range(40)]
    if true_map:  # twice: of maps that agree the one with the smallest corners is taken
        rows += [("p", (j,) * 8, -30.0, 1.0, 0.0, 20.0 + e, 0.0, 1.0) for j, e in ((77, 1e-12), (78, 0.0))]
    return one, two, spark.createDataFrame(rows, f"key string, corners {CORNERS}, " + ", ".join(f"{m} double" for m in M.MAP))


@pytest.mark.parametrize("true_map", [True, False])
def test_maps_that_cannot_be_the_best_are_left_out_early(spark, monkeypatch, true_map):
    one, two, maps = lists_and_maps(spark, true_map)
    best = {}
    for r in M.scores(maps, one, two, "id", "corners", 1e-5, ["key"]).collect():
        best[r.key] = min(best.get(r.key, (0.0, None)), (-r.score, tuple(r.corners)))
    monkeypatch.setattr(M, "FEW_SCORES", 0)
    seen, real = [], M._hits
    monkeypatch.setattr(M, "_hits", lambda maps, first, points, *a: seen.append(maps.where("key = 'p'").count() * points.where("key = 'p'").count()) or real(maps, first, points, *a))
    left = M.contenders(maps, one, two, "id", ["key"])
    kept = {(r.key, tuple(r.corners)) for r in left.collect()}
    assert {(key, corners) for key, (_, corners) in best.items()} <= kept
    if true_map:
        assert {x for x in kept if x[0] == "p"} == {("p", (77,) * 8)}
        # in rounds, without all points for every map
        assert sum(seen) < maps.where("key = 'p'").count() * two.where("key = 'p'").count() / 2


def test_few_maps_stay_as_they_are(spark):
    one, two, maps = lists_and_maps(spark, True)
    assert M.contenders(maps, one, two, "id", ["key"]).count() == maps.count()
