"""The whole path from frames to tracks: localize, correct drift, track, check z."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintloom.functions.columns import z_checked
from glintloom.operators import aggregate, drift, peaks, scan, track


def analyse(frames: DataFrame, length: int, width: int, height: int, radius: float = 1.0, max_gap: int = 0, descriptor: str = "1", step: int = 500, z_range: tuple[float, float] = (-0.5, 0.5), **settings: object) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(localizations, drift, tracks) of one movie.

    Order matters: drift is estimated from raw localizations, tracking uses corrected
    ones, and z is checked last. Intermediate results are plain DataFrames; write them
    between steps when a movie is large.
    """
    locs = peaks.localize(frames, **settings)
    found = drift.estimate_drift(locs, step, length, width, height)
    moved = scan.drift_corrected(locs, found.withColumn("dz", F.lit(0.0)))
    linked = track.tracker(moved.withColumnRenamed("movie", "dataset_id"), radius, max_gap, descriptor).withColumn("z", F.lit(0.0))
    tracks = aggregate.track_aggregate(linked.where("track_id >= 0"), ["sum", "height", "background"], keys=["dataset_id"], has_z=True)
    return locs, found, tracks.withColumn("category", z_checked(F.col("category"), F.col("z"), *z_range))
