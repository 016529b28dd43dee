import numpy as np
import pytest
from pyspark.sql import functions as F

from glintloom.operators import alignment
from glintloom.operators import master_drift as M
from glintloom.operators.aggregate import grid_2d


@pytest.mark.parametrize(("dx", "dy"), [(1.5, -0.75), (1.53, -0.77), (5.0, -4.0)])
def test_lists_farther_apart_than_the_first_lags_are_aligned(spark, dx, dy):
    rng = np.random.default_rng(3)
    at = rng.uniform(8, 24, (60, 2)).repeat(4, axis=0) + rng.normal(0, 0.2, (240, 2))
    rows = [(float(x), float(y), float(z)) for (x, y), z in zip(at, rng.uniform(-0.2, 0.2, 240), strict=True)]
    one = spark.createDataFrame(rows, "x double, y double, z double")
    two = one.withColumns({"x": F.col("x") + dx, "y": F.col("y") + dy, "z": F.col("z") + 0.1})
    assert alignment.track_offset(one, two, 32, 32) == pytest.approx((-dx, -dy, -0.1), abs=0.1)
    # without moves, as drift asks for, a peak at the border of the lags still fails
    if dx > 4:
        assert not M.xy_offset(*(grid_2d(t, 64, 64, 2.0) for t in (one, two)), 64, 64, (0, 0))[2]


def test_lists_without_a_peak_are_refused(spark):
    one = spark.createDataFrame([(1.0, 1.0, 0.0)], "x double, y double, z double")
    with pytest.raises(ValueError):
        alignment.track_offset(one, one.withColumn("x", F.lit(30.0)), 32, 32)
