"""Unions of tables, with the checks and shifts that go with them, and row expansion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_tables(tables: list[DataFrame]) -> DataFrame:
    """All rows of all tables; a column that one lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def merge_shards(rows: DataFrame, shards: DataFrame, key: str) -> DataFrame:
    """Rows of all shards; raises unless every shard in shards (key, analysis_finished) is finished."""
    open_ = [r[0] for r in shards.where("NOT coalesce(analysis_finished, false)").select(key).limit(20).collect()]
    if open_:
        raise ValueError(f"shards that are not finished: {open_}")
    return rows.join(shards.select(key), key, "left_semi")


def shifted_union(first: DataFrame, second: DataFrame, dx: float, dy: float, dz: float) -> DataFrame:
    """first, and second moved by the offset."""
    moved = second.withColumns({"x": F.col("x") + dx, "y": F.col("y") + dy, "z": F.col("z") + dz})
    return first.unionByName(moved, allowMissingColumns=True)


def expand_tracks(tracks: DataFrame, pixel_size: float) -> DataFrame:
    """Each track as one row a frame, in nm: (track_id, frame, x, y, z)."""
    each = F.explode(F.sequence(F.lit(0), F.col("track_length") - 1)).alias("j")
    rows = tracks.where("track_length > 0").select("track_id", "frame_number", "x", "y", "z", each)
    return rows.select("track_id", (F.col("frame_number") + F.col("j")).alias("frame"), (F.col("x") * pixel_size).alias("x"), (F.col("y") * pixel_size).alias("y"), (F.col("z") * 1000).alias("z"))


def odd_even(tracks: DataFrame) -> DataFrame:
    """tracks with half: parity of the id, for resolution estimates."""
    return tracks.withColumn("half", F.pmod(F.col("track_id"), F.lit(2)).cast("int"))


def merged_maps(maps: list[DataFrame]) -> DataFrame:
    """(source, target, axis, c0, c1, c2) of all maps between channel 0 and channel 1 of their own; the n-th map's channel 1 becomes channel n."""
    number = lambda c, n: F.when(F.col(c) == 1, F.lit(n)).otherwise(F.col(c)).alias(c)
    return reduce(DataFrame.unionByName, [m.select(number("source", n), number("target", n), "axis", "c0", "c1", "c2") for n, m in enumerate(maps, 1)])


def top_one(rows: DataFrame, keys: list[str], score: str, ties: list[str]) -> DataFrame:
    """Of each key the row with the highest score, of equal ones that first in `ties`. One pass of partial maxima, without sorting a key."""
    rank = F.struct(F.col(score).alias("s"), *[(-F.col(t)).alias(t) for t in ties])
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), rank).alias("top"))
    return picked.select(*keys, "top.*")
