import numpy as np
import pytest

from glintloom.operators import spatial


@pytest.mark.parametrize("least", [0.0, 0.3])
def test_k_nearest_in_rounds_is_that_of_all_pairs(spark, monkeypatch, least):
    rng = np.random.default_rng(5)
    xy = np.concatenate([rng.normal(0, 0.1, (300, 2)), rng.uniform(-9, 9, (60, 2)), np.round(rng.normal(3, 1, (100, 2)), 1), np.full((30, 2), 2.0)])
    df = spark.createDataFrame([(i, i % 2, *p) for i, p in enumerate(xy.tolist())], "id long, c int, x double, y double")
    rows = lambda: sorted(map(tuple, spatial.k_nearest(df, 4, 3.0, "id", ["c"], least).collect()))
    want, seen, within = rows(), [], spatial.pairs_within
    monkeypatch.setattr(spatial, "FEW_PAIRS", 0)
    monkeypatch.setattr(spatial, "pairs_within", lambda *a, **k: seen.append(a[2]) or within(*a, **k))
    assert rows() == want
    assert len(seen) > 2 and seen == sorted(seen) and seen[-1] <= 3.0


def test_unbounded_nearest_in_rounds(spark, monkeypatch):
    rng = np.random.default_rng(6)
    xy = np.concatenate([rng.normal(0, 0.1, (300, 2)), rng.uniform(-50, 50, (40, 2))])
    df = spark.createDataFrame([(i, i % 3, *p) for i, p in enumerate(xy.tolist())], "id long, c int, x double, y double")
    left, right = df.where("id % 2 = 0"), df.where("id % 2 = 1 AND c < 2")
    want = {}
    for i in range(0, len(xy), 2):
        other = [j for j in range(1, len(xy), 2) if j % 3 == i % 3 < 2]
        if other:
            want[i] = min((float((xy[i] - xy[j]) @ (xy[i] - xy[j])), j) for j in other)[1]
    monkeypatch.setattr(spatial, "FEW_PAIRS", 0)
    assert {r.id: r.nearest_id for r in spatial.nearest(left, right, "id", "id", ["c"]).collect()} == want
