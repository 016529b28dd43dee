"""Computations over ordered frames: interpolation, running sums, sliding means, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cumulative_drift(steps: DataFrame, fields: list[str], order: str, keys: list[str]) -> DataFrame:
    """Drift of each bin: the sum of the steps before it."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return steps.select(*keys, order, *[F.coalesce(F.sum(f).over(w), F.lit(0.0)).alias(f) for f in fields])


def interpolated(knots: DataFrame, length: int, fields: list[str], time: str = "t") -> DataFrame:
    """(frame, fields) for frames 0 .. length - 1: linear between knots, and along the first and last two beyond them. knots has a row for each time bin and fits one task."""
    w = Window.partitionBy(F.lit(0)).orderBy(time)
    cols = []
    for c in (time, *fields):
        cols += [F.lead(c).over(w).alias(f"next_{c}"), F.lag(c).over(w).alias(f"last_{c}")]
    k = knots.select(time, *fields, *cols)
    # each segment holds until the next knot; the first reaches down and the last up without end
    k = k.where(F.col(f"next_{time}").isNotNull())
    first = F.col(f"last_{time}").isNull()
    final = F.lead(time).over(w).isNull()
    k = k.withColumns({"__from": F.when(first, F.lit(float("-inf"))).otherwise(F.col(time).cast("double")), "__to": F.when(final, F.lit(float("inf"))).otherwise(F.col(f"next_{time}").cast("double"))})
    frames = knots.sparkSession.range(length).select(F.col("id").cast("int").alias("frame"))
    joined = frames.join(F.broadcast(k), (F.col("frame") >= F.col("__from")) & (F.col("frame") < F.col("__to")))
    at = (F.col("frame") - F.col(time)) / (F.col(f"next_{time}") - F.col(time))
    return joined.select("frame", *[(F.col(f) + at * (F.col(f"next_{f}") - F.col(f))).alias(f) for f in fields])


def filled(series: DataFrame, length: int, field: str, key: str) -> DataFrame:
    """(key, frame, field) for all frames 0 .. length - 1 of every key: missing values linear between neighbours, and along the nearest two beyond the ends.

    Each known value gives the frames up to the next one, the first also those before it
    and the last but one those to the end, so the work is one sort of the known values
    and one row for each result. A key with a single value has nulls in other frames; a
    key without values has no rows.
    """
    order = Window.partitionBy(key).orderBy("frame")
    known = series.where(F.col(field).isNotNull()).select(key, "frame", F.col(field).alias("v"))
    here = known.withColumns({"f2": F.lead("frame").over(order), "v2": F.lead("v").over(order), "f3": F.lead("frame", 2).over(order), "first": F.lag("frame").over(order).isNull()})
    alone = F.col("f2").isNull() & F.col("first")
    here = here.where(F.col("f2").isNotNull() | alone)
    start = F.when(F.col("first"), F.lit(0)).otherwise(F.greatest("frame", F.lit(0)))
    stop = F.when(F.col("f3").isNull(), F.lit(length)).otherwise(F.least("f2", F.lit(length)))
    spans = here.withColumns({"__start": start.cast("int"), "__stop": stop.cast("int")}).where("__start < __stop")
    each = spans.withColumn("at", F.explode(F.sequence("__start", F.col("__stop") - 1)))
    value = F.when(F.col("at") == F.col("frame"), F.col("v")).otherwise(F.col("v") + (F.col("at") - F.col("frame")) * (F.col("v2") - F.col("v")) / (F.col("f2") - F.col("frame")))
    return each.select(key, F.col("at").alias("frame"), value.alias(field))


def sliding_background(pixels: DataFrame, half: int, keys: list[str], value: str = "adu", descriptor: str | None = None) -> DataFrame:
    """pixels with background: mean of the frames at most half before and after, fewer at the ends.

    With a descriptor, which is repeated over the frames, activation frames (those with
    0) count for no background: the others take their neighbours from among themselves,
    and an activation frame gets the mean of the nearest such frames, half on each side.
    """
    if descriptor is None:
        w = Window.partitionBy(*keys).orderBy("frame").rowsBetween(-half, half)
        return pixels.withColumn("background", F.avg(value).over(w))
    kinds = F.array(*[F.lit(c != "0") for c in descriptor])
    counts = kinds[(F.col("frame") % len(descriptor)).cast("int")]
    # the place of a frame among those that count; an activation frame stands between two of them
    order = Window.partitionBy(*keys).orderBy("frame")
    placed = pixels.withColumn("__counts", counts).withColumn("__place", F.sum(F.when(F.col("__counts"), 2).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.when(F.col("__counts"), 0).otherwise(1))
    near = Window.partitionBy(*keys).orderBy("__place").rangeBetween(-2 * half, 2 * half)
    mean = F.avg(F.when(F.col("__counts"), F.col(value))).over(near)
    return placed.withColumn("background", mean).select(*pixels.columns, "background")


def sessions(locs: DataFrame, keys: list[str], max_gap: int) -> DataFrame:
    """locs with session: a new one for each key after more than max_gap empty frames."""
    w = Window.partitionBy(*keys).orderBy("frame", "loc_id")
    new = F.when(F.col("frame") - F.lag("frame").over(w) > max_gap + 1, 1).otherwise(0)
    return locs.withColumn("__new", new).withColumn("session", F.sum("__new").over(w).cast("int")).drop("__new")


def shifted_pairs(bins: DataFrame, index: str) -> DataFrame:
    """All pairs i < j of time bins: (i, j)."""
    a = bins.select(F.col(index).alias("i"))
    return a.join(bins.select(F.col(index).alias("j")), F.col("i") < F.col("j"))


def offsets_to_z(stage: DataFrame, dz: float = 0.0, all_valid: bool = False) -> DataFrame:
    """(frame, valid, z): stage positions (frame, stage_z) less the first one, plus dz.

    Only frames from the first lowest to the first highest position are valid, unless
    all are. The ends are one row, whatever the number of frames.
    """
    ends = stage.agg(
        F.min_by("stage_z", "frame").alias("first"), F.min(F.struct("stage_z", "frame"))["frame"].alias("low"), F.max(F.struct("stage_z", (-F.col("frame")).alias("back")))["back"].alias("high")
    )
    valid = F.lit(1) if all_valid else ((F.col("frame") >= F.col("low")) & (F.col("frame") <= -F.col("high"))).cast("int")
    return stage.join(F.broadcast(ends)).select("frame", valid.alias("valid"), (F.col("stage_z") - F.col("first") + F.lit(dz)).alias("z"))
