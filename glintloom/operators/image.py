"""Operators on images as rows: keys (movie, frame), y, x and value.

A kernel is a small parameter, a list of (dy, dx, weight). Every pixel is repeated for
the kernel's places and summed or compared per target pixel; sums are combined before
they are moved, and no image is ever one task's.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glintloom.operators.shared import small

from glintloom.operators.graph import connected_components

Kernel = list[tuple[int, int, float]]


def _moved(image: DataFrame, kernel: Kernel, keys: list[str], value: str) -> DataFrame:
    """Each pixel at all places that the kernel sends it to: keys, y, x, value and weight."""
    places = F.array(*[F.struct(F.lit(int(dy)).alias("dy"), F.lit(int(dx)).alias("dx"), F.lit(float(w)).alias("w")) for dy, dx, w in kernel])
    rows = image.select(*keys, "y", "x", F.col(value).alias("value"), F.explode(places).alias("k"))
    return rows.select(*keys, (F.col("y") + F.col("k.dy")).alias("y"), (F.col("x") + F.col("k.dx")).alias("x"), "value", F.col("k.w").alias("weight"))


def gaussian_kernel(sigma: float, reach: int) -> Kernel:
    """A round Gaussian of unit sum, cut to a square of 2 * reach + 1 pixels."""
    raw = [(dy, dx, 2.718281828459045 ** (-(dx * dx + dy * dy) / (2 * sigma * sigma))) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1)]
    total = sum(w for *_, w in raw)
    return [(dy, dx, w / total) for dy, dx, w in raw]


def matched_filter(image: DataFrame, kernel: Kernel, height: int, width: int, keys: list[str], value: str = "value") -> DataFrame:
    """keys, y, x, value: the image convolved with the kernel on a torus, as a transform of the whole image would do it. Absent pixels count as 0."""
    moved = _moved(image, kernel, keys, value)
    return moved.groupBy(*keys, F.pmod("y", F.lit(height)).alias("y"), F.pmod("x", F.lit(width)).alias("x")).agg(F.sum(F.col("value") * F.col("weight")).alias("value"))


def ball(radius: float) -> Kernel:
    """The heights of a ball of this radius over a square of pixels, as far as it reaches a quarter of its width to each side."""
    half = ceil(0.5 * radius)
    return [(dy, dx, sqrt(radius * radius - dx * dx - dy * dy)) for dy in range(-half, half + 1) for dx in range(-half, half + 1)]


def rolling_ball(image: DataFrame, radius: float, keys: list[str], value: str = "value") -> DataFrame:
    """image with background: for each pixel the least of the pixels around it less the height of the ball there, itself at most, plus the height of the ball at its top."""
    moved = _moved(image, ball(radius), keys, value)
    least = moved.groupBy(*keys, "y", "x").agg(F.min(F.col("value") - F.col("weight")).alias("__least"))
    joined = image.join(least, [*keys, "y", "x"])
    return joined.select(*image.columns, (F.least(F.col("__least"), F.col(value)) + F.lit(float(radius))).alias("background"))


def labelled_regions(image: DataFrame, threshold: float, keys: list[str], value: str = "value") -> DataFrame:
    """keys, label, n, total, cy, cx: connected regions (8 neighbours) of pixels above the threshold, with sum and weighted centre.

    Regions of each image are numbered from 1 by their first pixel, row by row.
    """
    bright = image.where(F.col(value) > threshold).select(*keys, "y", "x", F.col(value).alias("value"))
    bright = bright.withColumn("node", F.struct(*keys, "y", "x"))
    forward = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))])
    moved = bright.select(*keys, "y", "x", F.col("node").alias("a"), F.explode(forward).alias("s"))
    moved = moved.select(*keys, (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), "a")
    edges = moved.join(bright.select(*keys, "y", "x", F.col("node").alias("b")), [*keys, "y", "x"]).select("a", "b")
    groups = connected_components(edges)
    marked = bright.join(groups, "node", "left").withColumn("first", F.coalesce("component", "node"))
    v = F.col("value")
    regions = marked.groupBy(*keys, "first").agg(F.count("*").alias("n"), F.sum(v).alias("total"), (F.sum(v * F.col("y")) / F.sum(v)).alias("cy"), (F.sum(v * F.col("x")) / F.sum(v)).alias("cx"))
    numbered = Window.partitionBy(*keys).orderBy("first")
    return regions.select(*keys, F.row_number().over(numbered).alias("label"), "n", "total", "cy", "cx")


def calibration(rows: DataFrame, version: int) -> DataFrame:
    """(y, x, offset, variance, gain, rqe) of a sensor calibration of format 0, 1 or 2: 0 is transposed, and only 2 has its own relative efficiency."""
    if version not in (0, 1, 2):
        raise ValueError("unknown calibration format")
    y, x = ("x", "y") if version == 0 else ("y", "x")
    rqe = F.col("rqe") if version == 2 else F.lit(1.0)
    return rows.select(F.col(y).alias("y"), F.col(x).alias("x"), "offset", "variance", "gain", rqe.alias("rqe"))


def reslice(calibrated: DataFrame, x_start: int, y_start: int, width: int, height: int) -> DataFrame:
    """The part of a calibration that a smaller image covers, counted from its corner."""
    inside = (F.col("x") >= x_start) & (F.col("x") < x_start + width) & (F.col("y") >= y_start) & (F.col("y") < y_start + height)
    return calibrated.where(inside).withColumns({"x": F.col("x") - x_start, "y": F.col("y") - y_start})


def channel_offset(a: DataFrame, b: DataFrame, max_lag: int, value: str = "value") -> DataFrame:
    """(lag, score, best): how well frame f of a fits frame f + lag of b, as the mean product of their pixels; the best lag is marked.

    Each frame of a is repeated for the lags, a small parameter, and meets b by equality.
    """
    lags = F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag)))
    left = a.select("frame", "y", "x", F.col(value).alias("va"), lags.alias("lag")).withColumn("frame", F.col("frame") + F.col("lag"))
    scores = left.join(b.select("frame", "y", "x", F.col(value).alias("vb")), ["frame", "y", "x"]).groupBy("lag").agg(F.avg(F.col("va") * F.col("vb")).alias("score"))
    top = scores.agg(F.max_by("lag", F.struct("score", -F.abs("lag"), "lag")).alias("top"))
    return scores.join(F.broadcast(top)).select("lag", "score", (F.col("lag") == F.col("top")).alias("best"))


def rolling_background(image: DataFrame, frames: int, keys: list[str], value: str = "value", skip: DataFrame | None = None) -> DataFrame:
    """image with background: the mean of the pixel over the last `frames` frames up to this one. Frames in skip (frame), such as activation frames, do not count."""
    rows = image if skip is None else image.join(small(skip.select("frame", F.lit(True).alias("__skip"))), "frame", "left").withColumn("__skip", F.coalesce("__skip", F.lit(False)))
    counted = F.col(value) if skip is None else F.when(~F.col("__skip"), F.col(value))
    window = Window.partitionBy(*keys, "y", "x").orderBy("frame").rangeBetween(1 - frames, 0)
    return rows.withColumn("background", F.avg(counted).over(window)).select(*image.columns, "background")


def filtered_changes(movie: DataFrame, kernel: Kernel, height: int, width: int, keys: list[str], frame: str = "frame", max_diff: float = 0.0, value: str = "value") -> DataFrame:
    """keys, y, x, frame, until, value: matched_filter of every frame of a movie, valid from frame to before until, one row for each change.

    A pixel is used anew only where it is more than max_diff away from the value last
    used, so that the filter is off by at most max_diff times the sum of the kernel's
    absolute weights. Only what changed is multiplied with the kernel; sums of changes are
    added up over the frames. Frames are whole numbers; in a frame that has not a pixel,
    that pixel is 0 and starts anew afterwards. Pixels met twice in a frame are added, null
    values count as 0. A pixel's frames pass through one task in order, in batches.
    """
    here = Window.partitionBy(*keys, "y", "x").orderBy(frame)
    once = movie.groupBy(*keys, frame, "y", "x").agg(F.coalesce(F.sum(F.col(value).cast("double")), F.lit(0.0)).alias("value"))
    rows = once.withColumn("__starts", ~F.coalesce(F.lag(frame).over(here) == F.col(frame) - 1, F.lit(False)))
    if max_diff > 0:
        rows = _held(rows, max_diff)
    last, following = F.lag("value").over(here), F.lead(frame).over(here)
    rows = rows.withColumns({"__before": F.when(F.col("__starts"), 0.0).otherwise(last), "__ends": ~F.coalesce(following == F.col(frame) + 1, F.lit(False))})
    ends = F.col("__ends")
    steps = F.array(
        F.struct(F.col(frame).alias("at"), (F.col("value") - F.col("__before")).alias("d"), F.col("__starts").cast("int").alias("n")),
        F.struct((F.col(frame) + 1).alias("at"), F.when(ends, -F.col("value")).otherwise(0.0).alias("d"), (-ends.cast("int")).alias("n")),
    )
    changes = rows.select(*keys, "y", "x", F.explode(steps).alias("s")).where("s.d <> 0 OR s.n <> 0")
    both = F.array(*[F.struct(F.lit(int(dy)).alias("dy"), F.lit(int(dx)).alias("dx"), F.lit(float(w)).alias("w")) for dy, dx, w in kernel])
    moved = changes.select(*keys, "y", "x", "s.*", F.explode(both).alias("k"))
    target = [*keys, F.pmod(F.col("y") + F.col("k.dy"), F.lit(height)).alias("y"), F.pmod(F.col("x") + F.col("k.dx"), F.lit(width)).alias("x"), F.col("at").alias(frame)]
    sums = moved.groupBy(*target).agg(F.sum(F.col("d") * F.col("k.w")).alias("d"), F.sum("n").alias("n"))
    running = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    added = sums.select(*keys, "y", "x", frame, F.lead(frame).over(here).alias("until"), F.sum("d").over(running).alias("value"), F.sum("n").over(running).alias("n"))
    return added.where("n > 0").drop("n")


def each_frame(changes: DataFrame, frame: str = "frame") -> DataFrame:
    """The rows of filtered_changes, one for each frame in which they hold, without until."""
    return changes.withColumn(frame, F.explode(F.sequence(frame, F.col("until") - 1))).drop("until")


def _held(rows: DataFrame, max_diff: float) -> DataFrame:
    """rows, in order of their pixels and frames, with the value last used; a row that starts is used as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = 0.0
        for batch in batches:
            place, out = batch.schema.get_field_index("value"), []
            for v, starts in zip(batch.column(place).to_pylist(), batch.column("__starts").to_pylist(), strict=True):
                if starts or abs(v - used) > max_diff:
                    used = v
                out.append(used)
            yield batch.set_column(place, "value", pa.array(out, pa.float64()))

    return rows.mapInArrow(run, rows.schema)
