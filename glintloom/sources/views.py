"""Localization and point views over the driver tables.

``locs`` reads ``events`` as localizations: frame = whole hours since 2024-01-01,
loc_id = order within the frame, x and sum = value, y = user, category = event type.
``pts`` reads ``embeddings`` as labelled points in three dimensions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EPOCH_US = 1704067200 * 1_000_000

LOCS_SQL = """locs AS (SELECT CAST(floor((epoch_us(ts) - 1704067200000000) / 3600000000) AS INTEGER) AS frame,
 row_number() OVER (PARTITION BY CAST(floor((epoch_us(ts) - 1704067200000000) / 3600000000) AS INTEGER) ORDER BY event_id) - 1 AS loc_id,
 value AS x, CAST(user_id AS DOUBLE) AS y, value AS sum,
 CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS category, CAST(props->>'$.k' AS INTEGER) AS k, event_id FROM events)"""

PTS_SQL = """pts AS (SELECT vec_id, 10 * CAST(embedding[1] AS DOUBLE) AS x, 10 * CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, label AS category FROM embeddings)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def locs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, loc_id, x, y, sum, category, k and event_id of every event."""
    events = table(spark, sf_dir, "events")
    kinds = events.select("event_type").distinct()
    # the rank of a type among the few types there are
    ranked = kinds.withColumn("category", F.row_number().over(Window.orderBy("event_type")) - 1)
    frame = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(EPOCH_US)) / F.lit(3_600_000_000)).cast("int")
    rows = events.join(F.broadcast(ranked), "event_type").withColumn("frame", frame)
    order = Window.partitionBy("frame").orderBy("event_id")
    return rows.select(
        "frame",
        (F.row_number().over(order) - 1).cast("long").alias("loc_id"),
        F.col("value").alias("x"),
        F.col("user_id").cast("double").alias("y"),
        F.col("value").alias("sum"),
        F.col("category").cast("int").alias("category"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        "event_id",
    )


def pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, x, y, z and category of every embedding."""
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", (10 * e[0].cast("double")).alias("x"), (10 * e[1].cast("double")).alias("y"), e[2].cast("double").alias("z"), F.col("label").alias("category")
    )


def drift(frame_column: str = "frame"):
    """The drift of a frame that queries use: dx, dy and dz as columns of the frame number."""
    f = F.col(frame_column)
    return {"dx": 0.001 * f, "dy": -0.002 * f, "dz": 0.0001 * f}
