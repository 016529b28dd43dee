"""Seeded emitters and localizations for tests and fixtures."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _normal(seed: int, *of: Column) -> Column:
    """A standard normal number that depends on the seed and the given columns alone."""
    u = (F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(1 << 40)) + 1) / F.lit(float(1 << 40) + 1)
    v = F.pmod(F.xxhash64(F.lit(seed + 1), *of), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


def _uniform(seed: int, *of: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(1 << 40)) / F.lit(float(1 << 40))


def on_grid(spark: SparkSession, columns: int, rows: int, spacing: float) -> DataFrame:
    """(emitter, x, y, z) on a square grid."""
    k = F.col("id")
    return spark.range(columns * rows).select(k.alias("emitter"), ((k % columns + 1) * spacing).alias("x"), ((F.floor(k / columns) + 1) * spacing).alias("y"), F.lit(0.0).alias("z"))


def uniform(spark: SparkSession, n: int, width: float, height: float, z: float = 0.0, seed: int = 0) -> DataFrame:
    k = F.col("id")
    return spark.range(n).select(k.alias("emitter"), (_uniform(seed, k) * width).alias("x"), (_uniform(seed + 1, k) * height).alias("y"), ((_uniform(seed + 2, k) * 2 - 1) * z).alias("z"))


def in_clusters(spark: SparkSession, clusters: int, size: int, width: float, height: float, deviation: float, seed: int = 0) -> DataFrame:
    """size emitters around each of the uniform centres, at least two pixels from the edges; z a tenth as wide."""
    c, k = F.floor(F.col("id") / size), F.col("id")
    x = 2 + _uniform(seed, c) * (width - 4) + deviation * _normal(seed + 10, k)
    y = 2 + _uniform(seed + 1, c) * (height - 4) + deviation * _normal(seed + 20, k)
    return spark.range(clusters * size).select(k.alias("emitter"), c.alias("cluster"), x.alias("x"), y.alias("y"), (0.1 * deviation * _normal(seed + 30, k)).alias("z"))


def blinking(emitters: DataFrame, frames: int, chance: float, photons: float, noise: float, drift: tuple[float, float] = (0.0, 0.0), seed: int = 0) -> DataFrame:
    """(frame, emitter, x, y, z, sum): each emitter is seen in a frame with the given chance, off by noise and by a linear drift over the film."""
    rows = emitters.select("*", F.explode(F.sequence(F.lit(0), F.lit(frames - 1))).alias("frame"))
    on = rows.where(_uniform(seed, F.col("emitter"), F.col("frame")) < chance)
    at = [F.col(c) + noise * _normal(seed + 10 * k, F.col("emitter"), F.col("frame")) + drift[k - 1] * F.col("frame") / frames for k, c in enumerate(("x", "y"), 1)]
    return on.select("frame", "emitter", at[0].alias("x"), at[1].alias("y"), "z", F.lit(photons).alias("sum"))
