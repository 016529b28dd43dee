"""Filters over localizations."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintloom.operators.shared import small


def roi(locs: DataFrame, x: tuple | None = None, y: tuple | None = None, frames: tuple | None = None) -> DataFrame:
    """Rows strictly inside the given ranges (None leaves one open)."""
    tests = [F.lit(True)]
    for c, span in (("x", x), ("y", y), ("frame", frames)):
        for bound, test in zip(span or (None, None), (lambda a, b: a > b, lambda a, b: a < b), strict=True):
            if bound is not None:
                tests.append(test(F.col(c), F.lit(bound)))
    return locs.where(reduce(and_, tests))


def good_only(locs: DataFrame) -> DataFrame:
    """Rows whose category is not 9."""
    return locs.where("category <> 9")


def inside_all_channels(locs: DataFrame, maps: list[tuple[tuple, tuple]], aoi: float, width: int, height: int) -> DataFrame:
    """Rows whose area of interest lies inside the image in every channel; maps are the affine x and y of each channel."""
    tests = []
    for cx, cy in maps:
        x = cx[0] + cx[1] * F.col("x") + cx[2] * F.col("y")
        y = cy[0] + cy[1] * F.col("x") + cy[2] * F.col("y")
        tests += [x >= aoi, y >= aoi, x + aoi < width, y + aoi < height]
    return locs.where(reduce(and_, tests))


def area_mask(locs: DataFrame, centre: tuple[float, float], radius: float) -> DataFrame:
    """Rows in a circle."""
    return locs.where(F.pow(F.col("x") - centre[0], 2) + F.pow(F.col("y") - centre[1], 2) <= radius * radius)


def rectangle(locs: DataFrame, x: tuple[float | None, float | None] = (None, None), y: tuple[float | None, float | None] = (None, None)) -> DataFrame:
    """Rows from start up to, but not at, stop in x and y; None leaves a side open."""
    for c, (start, stop) in (("x", x), ("y", y)):
        if start is not None:
            locs = locs.where(F.col(c) >= start)
        if stop is not None:
            locs = locs.where(F.col(c) < stop)
    return locs


def channel_view(locs: DataFrame, category: int | None = None, frames: tuple[int, int] | None = None, z: tuple[float, float] | None = None) -> DataFrame:
    """Rows of one category, of frames from first up to stop, and of z strictly inside a range; None leaves a test out."""
    if category is not None:
        locs = locs.where(F.col("category") == category)
    if frames is not None:
        locs = locs.where((F.col("frame") >= frames[0]) & (F.col("frame") < frames[1]))
    return locs if z is None else locs.where((F.col("z") > z[0]) & (F.col("z") < z[1]))


def bright(locs: DataFrame, least: float, height: str = "height") -> DataFrame:
    """Rows higher than `least`."""
    return locs.where(F.col(height) > least)


def without_status(peaks: DataFrame, *statuses: str) -> DataFrame:
    """Peaks of none of these statuses, such as "ERROR" or "RUNNING"; a null status stays."""
    return peaks.where(~F.coalesce(F.col("status").isin(*statuses), F.lit(False)))


def without_outliers(rows: DataFrame, residuals: list[str], k: float, keys: list[str] = ()) -> DataFrame:  # type: ignore[assignment]
    """Rows whose residuals are all within k population standard deviations of zero."""
    spread = rows.groupBy(*keys).agg(*[F.stddev_pop(r).alias(f"__s_{r}") for r in residuals])
    joined = rows.join(spread, list(keys)) if keys else rows.join(F.broadcast(spread))
    return joined.where(reduce(and_, [F.abs(r) < k * F.col(f"__s_{r}") for r in residuals])).select(*rows.columns)


def valid_frames(locs: DataFrame, z_table: DataFrame) -> DataFrame:
    """Rows of the frames that z_table (frame, valid, z) calls valid, with their stage z."""
    return locs.join(small(z_table.where("valid <> 0").select("frame", F.col("z").alias("stage_z"))), "frame")


def frequent(members: DataFrame, key: str, least: int) -> DataFrame:
    """Members of keys that occur in at least `least` frames."""
    kept = members.groupBy(key).agg(F.count_distinct("frame").alias("n")).where(F.col("n") >= least).select(key)
    return members.join(kept, key, "left_semi")
