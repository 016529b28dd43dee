"""A store of localizations and tracks as Parquet folders.

Localizations lie in blocks of frames, so that a frame range reads few files; tracks in
numbered blocks. Writes append or replace whole partitions; a run that was cut off goes
on behind the last finished block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Frames in a block.
BLOCK = 1000


_FIXED = ("frame", "loc_id")


def _folder(channel: int | None) -> str:
    return f"c{channel}" if channel else "c0"


def write_localizations(locs: DataFrame, path: str, channel: int | None = None) -> None:
    """Appends localizations. The fields of channels from 1 on are named c<channel>_<field> when they are read; each channel has a folder of its own."""
    if channel:
        locs = locs.select(*[F.col(c) if c in _FIXED else F.col(c).alias(f"c{channel}_{c}") for c in locs.columns])
    blocked = locs.withColumn("block", F.floor(F.col("frame") / BLOCK).cast("int"))
    blocked.repartition("block", F.col("frame") % 16).sortWithinPartitions("frame").write.mode("append").partitionBy("block").parquet(f"{path.rstrip('/')}/{_folder(channel)}")


def channels(spark: SparkSession, path: str) -> list[int]:
    """Channels that have been written."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(place) if f.isDirectory()]
    return sorted(int(n[1:]) for n in names if n[0] == "c" and n[1:].isdigit())


def read_localizations(spark: SparkSession, path: str, first: int | None = None, stop: int | None = None) -> DataFrame:
    """Localizations of the frames from first up to stop, one wide row for all channels of a frame and loc_id; only their blocks are read. Fields of a channel that lacks the row are null."""
    out = None
    for k in channels(spark, path):
        # appends may bring new fields
        rows = spark.read.option("mergeSchema", "true").parquet(f"{path.rstrip('/')}/{_folder(k)}")
        if first is not None:
            rows = rows.where((F.col("block") >= first // BLOCK) & (F.col("frame") >= first))
        if stop is not None:
            rows = rows.where((F.col("block") <= (stop - 1) // BLOCK) & (F.col("frame") < stop))
        rows = rows.drop("block")
        out = rows if out is None else out.join(rows, list(_FIXED), "full")
    if out is None:
        raise ValueError(f"no localizations at {path}")
    return out


def with_column(rows: DataFrame, values: DataFrame, on: list[str], name: str, default: Column | None = None) -> DataFrame:
    """rows with the field `name` added or replaced from values (on, name); rows without a value get the default, or null."""
    new = values.select(*on, F.col(name).alias("__new"))
    value = F.col("__new") if default is None else F.coalesce(F.col("__new"), default)
    return rows.drop(name).join(new, on, "left").withColumn(name, value).drop("__new")


def write_tracks(tracks: DataFrame, path: str, per_block: int = 10_000, order: tuple[str, ...] = ("frame_number", "track_id")) -> None:
    """Replaces the tracks by these, in blocks of about per_block rows, in order."""
    n = tracks.count()
    blocks = max(1, -(-n // per_block))
    tracks.repartitionByRange(blocks, *order).sortWithinPartitions(*order).withColumn("block", F.spark_partition_id()).write.mode("overwrite").partitionBy("block").parquet(path)


def read_tracks(spark: SparkSession, path: str, block: int | None = None) -> DataFrame:
    """All tracks, or those of one block."""
    rows = spark.read.parquet(path)
    return (rows if block is None else rows.where(F.col("block") == block)).drop("block")
