"""Exact quantiles against numpy, with few and many values, ties and odd rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from glintloom.operators.quantile import exact_quantile


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.993, 1.0])
def test_quantiles_of_keys_equal_numpy(spark, q):
    rng = np.random.default_rng(0)
    groups = {0: rng.normal(size=3000), 1: np.exp(rng.normal(0, 8, 2999)), 2: rng.integers(0, 3, 2500).astype(float), 3: np.full(2000, 7.5), 4: np.array([1.0, 2.0]), 5: np.array([-3.0]), 6: np.concatenate([np.zeros(1500), rng.random(1500)])}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [(0, None), (7, None), (4, float("nan"))]
    table = spark.createDataFrame(rows, "k int, v double").repartition(4)
    got = {r.k: r.value for r in exact_quantile(table, "v", q, ["k"], most=50).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4, 5, 6]
    for k, vs in groups.items():
        assert got[k] == pytest.approx(np.quantile(vs, q), rel=1e-12, abs=1e-12), k


def test_quantile_of_all_rows(spark):
    table = spark.range(100_001).select((F.col("id") * 7 % 100_003).cast("double").alias("v"))
    want = np.quantile(np.arange(100_001) * 7 % 100_003, 0.3)
    assert [r.value for r in exact_quantile(table, "v", 0.3).collect()] == [pytest.approx(want, rel=1e-12)]
    assert exact_quantile(table.limit(0), "v", 0.5).count() == 0
