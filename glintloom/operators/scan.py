"""Scans of localizations, tracks and movies: ranges, drift, empty frames, channels, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glintloom.operators.shared import small


def frame_range(locs: DataFrame, start: int, stop: int, fields: list[str] | None = None) -> DataFrame:
    """Rows with start <= frame < stop; fields prunes the columns that are read."""
    if stop <= start:
        raise ValueError("stop must be larger than start")
    rows = locs.where((F.col("frame") >= start) & (F.col("frame") < stop))
    return rows.select(*fields) if fields else rows


def drift_corrected(locs: DataFrame, frames: DataFrame, on: list[str] = ["frame"]) -> DataFrame:  # noqa: B006
    """x + dx, y + dy and z + dz (where there is a z); frames without attributes keep their coordinates."""
    moved = locs.join(small(frames.select(*on, "dx", "dy", "dz")), on, "left")
    out = locs.columns
    shift = {"x": "dx", "y": "dy", "z": "dz"}
    return moved.select(*[(F.col(c) + F.coalesce(shift[c], F.lit(0.0))).alias(c) if c in shift else F.col(c) for c in out])


def frame_sizes(locs: DataFrame, length: int) -> DataFrame:
    """(frame, n_locs) of frames 0 .. length - 1, empty ones included."""
    frames = locs.sparkSession.range(length).select(F.col("id").cast("int").alias("frame"))
    counts = locs.groupBy("frame").agg(F.count("*").alias("n_locs"))
    return frames.join(counts, "frame", "left").select("frame", F.coalesce("n_locs", F.lit(0)).alias("n_locs"))


def calibrated(pixels: DataFrame, gain: float = 1.0, offset: float = 0.0) -> DataFrame:
    """Photo-electrons of an EMCCD camera: (adu - offset) * gain, at least 1."""
    return pixels.withColumn("photons", F.greatest((F.col("adu") - offset) * gain, F.lit(1.0)))


def calibrated_scmos(pixels: DataFrame, calibration: DataFrame) -> DataFrame:
    """Photo-electrons of an sCMOS camera; calibration (y, x, offset, gain, rqe) has a row for each pixel of one sensor."""
    joined = pixels.join(small(calibration.select("y", "x", "offset", "gain", "rqe")), ["y", "x"])
    value = (F.col("adu") - F.col("offset")) * (F.col("gain") * F.col("rqe"))
    return joined.select(*pixels.columns, F.greatest(value, F.lit(1.0)).alias("photons"))


def average_frames(pixels: DataFrame, start: int, stop: int) -> DataFrame:
    """(y, x, mean) of the frames start <= frame < stop."""
    return frame_range(pixels, start, stop).groupBy("y", "x").agg(F.avg("adu").alias("mean"))


def aligned_planes(first: DataFrame, second: DataFrame, offset: int, keys: list[str]) -> DataFrame:
    """Rows of two channels whose frames belong together: frame of the second = frame of the first + offset."""
    b = second.select((F.col("frame") - offset).alias("frame"), *keys, *[F.col(c).alias(f"c1_{c}") for c in second.columns if c not in ("frame", *keys)])
    return first.join(b, ["frame", *keys])


def movie_hash(frames: DataFrame) -> DataFrame:
    """(movie_id, hash): MD5 of the bytes of frame 0."""
    return frames.where("frame = 0").select("movie_id", F.md5("pixels").alias("hash"))


def split_channels(wide: DataFrame, channels: int, fields: list[str], keys: list[str]) -> DataFrame:
    """Long form of c1_field, c2_field ...: one row for each channel; channel 0 has the plain names."""
    each = [F.struct(F.lit(k).alias("channel"), *[F.col(f if k == 0 else f"c{k}_{f}").alias(f) for f in fields]) for k in range(channels)]
    return wide.select(*keys, F.explode(F.array(*each)).alias("c")).select(*keys, "c.*")


def join_channels(long: DataFrame, channels: int, fields: list[str], keys: list[str]) -> DataFrame:
    """Wide form of a channel column; the number of channels is given, so no pass is needed to find it."""
    aggregated = [F.max(F.when(F.col("channel") == k, F.col(f))).alias(f if k == 0 else f"c{k}_{f}") for k in range(channels) for f in fields]
    return long.groupBy(*keys).agg(*aggregated)


def clusters_of_size(members: DataFrame, least: int, cluster: str = "cluster_id", skip_unclustered: bool = True) -> DataFrame:
    """Members of clusters with at least `least` members; cluster 0 holds what is unclustered."""
    sizes = members.groupBy(cluster).agg(F.count("*").alias("__n")).where(F.col("__n") >= least).select(cluster)
    kept = members.join(sizes, cluster, "left_semi")
    return kept.where(F.col(cluster) > 0) if skip_unclustered else kept


def fetch_members(members: DataFrame, parents: DataFrame, on: list[str], fields: list[str]) -> DataFrame:
    """Members with fields of the rows they point back to."""
    return members.join(parents.select(*on, *fields), on)


def resume_point(locs: DataFrame) -> int:
    """The first frame that is not analysed yet."""
    last = locs.agg(F.max("frame")).first()[0]
    return 0 if last is None else last + 1


def is_localization_table(df: DataFrame) -> bool:
    """Whether a table has what localizations need."""
    return {"frame", "x", "y"} <= set(df.columns)


def photons(adu: Column, gain: float, offset: float) -> Column:
    return F.greatest((adu - offset) * gain, F.lit(1.0))
