"""Colour classes by k-means over channel heights."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintloom.operators.aggregate import gated, nearest_code


def normalised_heights(tracks: DataFrame, heights: list[str], keys: list[str] = ()) -> DataFrame:  # type: ignore[assignment]
    """tracks with f_0, f_1 ...: heights over their sum, divided by their population deviation within keys (1 where that is 0)."""
    total = sum((F.col(h) for h in heights[1:]), F.col(heights[0]))
    shares = tracks.withColumns({f"__f{k}": F.col(h) / total for k, h in enumerate(heights)})
    spread = shares.groupBy(*keys).agg(*[F.stddev_pop(f"__f{k}").alias(f"__s{k}") for k in range(len(heights))])
    joined = shares.join(spread, list(keys)) if keys else shares.join(F.broadcast(spread))
    scaled = {f"f_{k}": F.col(f"__f{k}") / F.when(F.col(f"__s{k}") == 0, 1.0).otherwise(F.col(f"__s{k}")) for k in range(len(heights))}
    return joined.withColumns(scaled).drop(*[f"__{c}{k}" for c in "fs" for k in range(len(heights))])


def codebook(tracks: DataFrame, heights: list[str], colours: int, seed: int = 0) -> list[list[float]]:
    """Centres of the colours; one row of numbers a colour."""
    features = normalised_heights(tracks, heights)
    data = VectorAssembler(inputCols=[f"f_{k}" for k in range(len(heights))], outputCol="features").transform(features)
    model = KMeans(k=colours, seed=seed, featuresCol="features").fit(data)
    return sorted(c.tolist() for c in model.clusterCenters())


def classified(tracks: DataFrame, codes: list[list[float]], heights: list[str], percentile: float = 0.8, block: str = "block_id") -> DataFrame:
    """tracks with km_color and km_distance; the most distant of each block get colour 9."""
    features = normalised_heights(tracks, heights, [block])
    coded = nearest_code(features, codes, [f"f_{k}" for k in range(len(heights))])
    own = coded.select(*[F.col(c).alias(f"t_{c}") for c in tracks.columns], F.col(block), F.col("km_color").alias("category"), "km_distance")
    cut = gated(own, "km_distance", percentile, [block])
    return cut.select(*[F.col(f"t_{c}").alias(c) for c in tracks.columns], F.col("category").alias("km_color"), "km_distance")
