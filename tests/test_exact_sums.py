from decimal import ROUND_HALF_UP, Decimal

import numpy as np
from pyspark.sql import functions as F

from glintloom.functions.columns import rounded_mean


def test_rounded_mean_is_of_the_exact_sum(spark):
    rng = np.random.default_rng(3)
    cents = rng.integers(1, 50_000, (200, 64))
    cents[:, 0] += (2 - cents.sum(axis=1)) % 4  # means of 64 that end in a 5 at the seventh decimal
    rows = [(g, c / 100) for g in range(200) for c in cents[g].tolist()]
    df = spark.createDataFrame(rows, "g long, v double").repartition(4)
    got = {r.g: r.m for r in df.groupBy("g").agg(rounded_mean(F.col("v"), 6).alias("m")).collect()}
    want = {g: float((Decimal(int(cents[g].sum())) / 6400).quantize(Decimal("1e-6"), ROUND_HALF_UP)) for g in range(200)}
    assert got == want


def test_rounded_mean_of_odd_values(spark):
    rows = [(0, 1.5), (0, float("nan")), (1, 1e300), (1, 1e300), (2, 1e-9), (2, 3e-9), (3, None), (3, 1.0)]
    df = spark.createDataFrame(rows, "g long, v double")
    got = {r.g: r.m for r in df.groupBy("g").agg(rounded_mean(F.col("v"), 9).alias("m")).collect()}
    assert got[0] != got[0] and got[1] == 1e300 and got[2] == 2e-9 and got[3] == 0.5
