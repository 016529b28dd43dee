"""Grids, renderings, statistics and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glintloom.functions.columns import grid_index, render_index
from glintloom.operators.quantile import exact_quantile
from glintloom.operators.shared import small
from glintloom.operators.spatial import nearest_within


def grid_2d(points: DataFrame, width: int, height: int, scale: float = 1.0, dx: float = 0.0, dy: float = 0.0, keys: list[str] = ()) -> DataFrame:  # type: ignore[assignment]
    """(keys, ix, iy, count) of the points inside width x height cells."""
    cells = points.select(*keys, grid_index(F.col("x") + dx, scale).alias("ix"), grid_index(F.col("y") + dy, scale).alias("iy"))
    inside = cells.where((F.col("ix") >= 0) & (F.col("ix") < width) & (F.col("iy") >= 0) & (F.col("iy") < height))
    return inside.groupBy(*keys, "ix", "iy").agg(F.count("*").alias("count"))


def grid_3d(points: DataFrame, width: int, height: int, z_min: float, z_max: float, bins: int, scale: float = 1.0, clamp: bool = False) -> DataFrame:
    """(ix, iy, iz, count); z outside z_min .. z_max (both excluded) is left out, or put into the end bins with clamp."""
    iz = F.floor((F.col("z") - z_min) * (bins / (z_max - z_min))).cast("int")
    rows = points if clamp else points.where((F.col("z") > z_min) & (F.col("z") < z_max))
    iz = F.least(F.greatest(iz, F.lit(0)), F.lit(bins - 1)) if clamp else iz
    cells = rows.select(grid_index(F.col("x"), scale).alias("ix"), grid_index(F.col("y"), scale).alias("iy"), iz.alias("iz"))
    inside = cells.where((F.col("ix") >= 0) & (F.col("ix") < width) & (F.col("iy") >= 0) & (F.col("iy") < height) & (F.col("iz") >= 0) & (F.col("iz") < bins))
    return inside.groupBy("ix", "iy", "iz").agg(F.count("*").alias("count"))


def channel_maxima(grid: DataFrame, channel: str) -> DataFrame:
    """(channel, most, most_of_all): largest count of each channel and of all."""
    per = grid.groupBy(channel).agg(F.max("count").alias("most"))
    return per.join(F.broadcast(per.agg(F.max("most").alias("most_of_all"))))


def render(points: DataFrame, width: int, height: int, scale: float = 1.0, offset: tuple[float, float] = (0.0, 0.0), category: int | None = None, edges: list[float] | None = None) -> DataFrame:
    """Histogram image as (slab, px, py, count): category filter, (x + offset) * scale rounded half to even; slab of z between edges."""
    rows = points if category is None else points.where(F.col("category") == category)
    slab = F.lit(0)
    if edges is not None:
        slab = F.lit(None).cast("int")
        for k in range(len(edges) - 1):
            slab = F.when((F.col("z") >= edges[k]) & (F.col("z") < edges[k + 1]), k).otherwise(slab)
    cells = rows.select(slab.cast("int").alias("slab"), render_index(F.col("x") + offset[0], scale).alias("px"), render_index(F.col("y") + offset[1], scale).alias("py"))
    inside = cells.where((F.col("px") >= 0) & (F.col("px") < width) & (F.col("py") >= 0) & (F.col("py") < height) & F.col("slab").isNotNull())
    return inside.groupBy("slab", "px", "py").agg(F.count("*").alias("count"))


def splat(points: DataFrame, width: int, height: int, sigma: float, height_column: str | None = None, resolution: int = 1) -> DataFrame:
    """Image of Gaussians as (px, py, value): each point is spread over the pixels within five sigma, sampled resolution x resolution times each."""
    half = max(1, int(5 * sigma))
    steps = F.sequence(F.lit(-half), F.lit(half))
    h = F.lit(1.0) if height_column is None else F.col(height_column)
    rows = points.where(h > 0).select("x", "y", h.alias("h"), F.explode(F.transform(steps, lambda k: F.floor("x").cast("int") + k)).alias("px"))
    rows = rows.withColumn("py", F.explode(F.transform(steps, lambda k: F.floor("y").cast("int") + k))).where((F.col("px") >= 0) & (F.col("px") < width) & (F.col("py") >= 0) & (F.col("py") < height))
    value: Column = F.lit(0.0)
    for i in range(resolution):
        for j in range(resolution):
            dx = F.col("px") + (i + 0.5) / resolution - 0.5 - F.col("x")
            dy = F.col("py") + (j + 0.5) / resolution - 0.5 - F.col("y")
            value = value + F.exp(-(dx * dx + dy * dy) / (2 * sigma * sigma))
    return rows.groupBy("px", "py").agg(F.sum(F.col("h") * value / resolution**2).alias("value"))


def track_aggregate(locs: DataFrame, sums: list[str] = (), keys: list[str] = (), has_z: bool = False) -> DataFrame:  # type: ignore[assignment]
    """One row a track: weighted centre (weight 1 + sqrt(sum)), first frame and category, length, and sums of the other fields."""
    w = 1 + F.sqrt("sum") if "sum" in locs.columns else F.lit(1.0)
    centre = [(F.sum(w * F.col(c)) / F.sum(w)).alias(c) for c in ("x", "y")] + [((F.sum(w * F.col("z")) / F.sum(w)) if has_z else F.lit(0.0)).alias("z")]
    first = F.min(F.struct("frame", "category"))
    return (
        locs.groupBy(*keys, "track_id")
        .agg(*centre, first.alias("__f"), F.count("*").cast("int").alias("track_length"), *[F.sum(c).alias(c) for c in sums])
        .select(*keys, "track_id", "x", "y", "z", F.col("__f.frame").alias("frame_number"), F.col("__f.category").alias("category"), "track_length", *sums)
    )


def cluster_stats(members: DataFrame, cluster: str, pixel_size: float) -> DataFrame:
    """Per cluster: category, size, mean, extent and radius of gyration in nm (x, y in pixels, z in microns)."""
    nm = {"x": F.col("x") * pixel_size, "y": F.col("y") * pixel_size, "z": F.col("z") * 1000.0}
    rows = members.select(cluster, "category", *[c.alias(k) for k, c in nm.items()])
    stats = [F.avg(k).alias(f"{k}_mean") for k in nm] + [(F.max(k) - F.min(k)).alias(f"{k}_size") for k in nm]
    gyration = F.sqrt(F.var_pop("x") + F.var_pop("y") + F.var_pop("z")).alias("rg")
    return rows.groupBy(cluster).agg(F.min("category").alias("category"), F.count("*").alias("n"), *stats, gyration)


def cluster_size(members: DataFrame, cluster: str) -> DataFrame:
    """members with size: that of their cluster; 0 for ids up to 1 (noise)."""
    sizes = members.where(F.col(cluster) > 1).groupBy(cluster).agg(F.count("*").alias("size"))
    return members.join(sizes, cluster, "left").withColumn("size", F.coalesce("size", F.lit(0)))


def recategorized(members: DataFrame, cluster: str, least: int) -> DataFrame:
    """members with category 0 where their cluster is smaller than least."""
    sized = cluster_size(members, cluster)
    return sized.withColumn("category", F.when(F.col("size") < least, F.lit(0)).otherwise(F.col("category"))).drop("size")


def matched_fraction(truth: DataFrame, measured: DataFrame, radius: float, truth_id: str, measured_id: str, keys: list[str]) -> DataFrame:
    """(matched, total) over the points of truth with a measured point within radius; swap the sides for the noise fraction."""
    found = nearest_within(truth, measured, radius, truth_id, measured_id, keys)
    return found.agg(F.coalesce(F.sum(F.when(F.col("nearest_id") >= 0, 1).otherwise(0)), F.lit(0)).cast("long").alias("matched"), F.count("*").alias("total"))


def fit_errors(truth: DataFrame, measured: DataFrame, radius: float, truth_id: str, measured_id: str, keys: list[str], pixel_size: float, max_distance: float) -> DataFrame:
    """(truth_id, measured_id, dx, dy, dz) in nm of measured points with their nearest true one, nearer than max_distance in three dimensions."""
    found = nearest_within(measured, truth, radius, measured_id, truth_id, keys).where("nearest_id >= 0").select(*keys, measured_id, F.col("nearest_id").alias("__t"))
    t = truth.select(*keys, F.col(truth_id).alias("__t"), *[F.col(c).alias(f"t_{c}") for c in "xyz"])
    m = measured.select(*keys, measured_id, "x", "y", "z")
    both = found.join(t, [*keys, "__t"]).join(m, [*keys, measured_id])
    d = {"dx": (F.col("x") - F.col("t_x")) * pixel_size, "dy": (F.col("y") - F.col("t_y")) * pixel_size, "dz": (F.col("z") - F.col("t_z")) * 1000.0}
    out = both.select(F.col("__t").alias(f"true_{truth_id}"), measured_id, *[c.alias(k) for k, c in d.items()])
    return out.where(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz") < max_distance * max_distance)


def error_summary(errors: DataFrame) -> DataFrame:
    """Standard deviation and root mean square of each axis."""
    return errors.agg(F.count("*").alias("n"), *[F.stddev_pop(c).alias(f"std_{c}") for c in ("dx", "dy", "dz")], *[F.sqrt(F.avg(F.col(c) * F.col(c))).alias(f"rms_{c}") for c in ("dx", "dy", "dz")])


def field_statistics(locs: DataFrame, fields: list[str]) -> DataFrame:
    """(field, n, mean, std, min, max), one row a field, in one pass."""
    parts = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("v")) for f in fields]))
    rows = locs.select(parts.alias("p")).select("p.*")
    return rows.groupBy("field").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))


def histogram(rows: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, count); the last bin includes high."""
    v = F.col(column)
    index = F.when(v == high, bins - 1).otherwise(F.floor((v - low) * (bins / (high - low)))).cast("int")
    return rows.where((v >= low) & (v <= high)).groupBy(index.alias("bin")).agg(F.count("*").alias("count"))


def pixel_moments(pixels: DataFrame, keys: list[str] = ("y", "x")) -> DataFrame:  # type: ignore[assignment]
    """(y, x, n, mean, variance) over the frames of a movie."""
    return pixels.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("adu").alias("mean"), F.var_pop("adu").alias("variance"))


def gain_slopes(levels: DataFrame) -> DataFrame:
    """(y, x, gain): slope of (variance - dark variance) over (mean - offset) of each pixel; 1 where all is zero."""
    dy, dx = F.col("variance") - F.col("dark_variance"), F.col("mean") - F.col("offset")
    slope = F.regr_slope(dy, dx)
    return levels.groupBy("y", "x").agg(F.coalesce(F.when((F.max(F.abs(dx)) == 0) & (F.max(F.abs(dy)) == 0), 1.0).otherwise(slope), F.lit(1.0)).alias("gain"))


def box_mean(pixels: DataFrame, half: int, value: str) -> DataFrame:
    """(y, x, relative): value over the mean of the pixels at most half away in both directions (a column, then a row at a time)."""
    near = F.sequence(F.lit(-half), F.lit(half))
    spread = pixels.select(F.explode(F.transform(near, lambda k: F.col("y") + k)).alias("y"), "x", F.col(value).alias("v"))
    rows = spread.groupBy("y", "x").agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    rows = rows.select("y", F.explode(F.transform(near, lambda k: F.col("x") + k)).alias("x"), "s", "n").groupBy("y", "x").agg((F.sum("s") / F.sum("n")).alias("box"))
    return pixels.join(rows, ["y", "x"]).select("y", "x", (F.col(value) / F.col("box")).alias("relative"))


def ring_means(pixels: DataFrame, centre: tuple[float, float], value: str) -> DataFrame:
    """(ring, mean, n) by whole distance from the centre, rounded."""
    d = F.sqrt(F.pow(F.col("x") - centre[0], 2) + F.pow(F.col("y") - centre[1], 2))
    return pixels.groupBy(F.floor(d + 0.5).cast("int").alias("ring")).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def lag_correlation(first: DataFrame, second: DataFrame, bins: int, keys: list[str], value: str = "count") -> DataFrame:
    """(lag, score): sum of products of cells of both grids iz and iz + lag, over the planes that overlap."""
    b = second.select(*keys, F.col("iz").alias("__iz"), F.col(value).alias("__v"))
    lag = (F.col("__iz") - F.col("iz")).cast("int")
    sums = first.join(b, keys).groupBy(lag.alias("lag")).agg(F.sum(F.col(value) * F.col("__v")).alias("s"))
    return sums.select("lag", (F.col("s") / (bins - F.abs("lag"))).alias("score"))


def gated(rows: DataFrame, column: str, percentile: float, keys: list[str], limit_category: int = 9) -> DataFrame:
    """rows with category 9 where column is over its percentile of the keys (linear between values)."""
    cut = small(exact_quantile(rows, column, percentile, keys).withColumnRenamed("value", "__cut"))
    return rows.join(cut, keys).withColumn("category", F.when(F.col(column) > F.col("__cut"), F.lit(limit_category)).otherwise(F.col("category"))).drop("__cut")


def above_median(rows: DataFrame, column: str, factor: float, keys: list[str] = ()) -> DataFrame:  # type: ignore[assignment]
    """rows whose column is over factor times its exact median."""
    cut = exact_quantile(rows, column, 0.5, keys).withColumnRenamed("value", "__cut")
    joined = rows.join(small(cut), list(keys)) if keys else rows.join(F.broadcast(cut))
    return joined.where(F.col(column) > factor * F.col("__cut")).drop("__cut")


def nearest_code(rows: DataFrame, codes: list[list[float]], features: list[str]) -> DataFrame:
    """rows with km_color, the nearest row of the codebook, and km_distance."""
    each = F.array(*[F.struct(F.sqrt(sum(((F.col(f) - v) * (F.col(f) - v) for f, v in zip(features, code, strict=True)), F.lit(0.0))).alias("d"), F.lit(k).alias("k")) for k, code in enumerate(codes)])
    best = F.array_min(each)
    return rows.withColumn("__b", best).withColumns({"km_color": F.col("__b.k"), "km_distance": F.col("__b.d")}).drop("__b")


def running_index(rows: DataFrame, order: list[str], keys: list[str]) -> DataFrame:
    """rows with index from 0 within keys."""
    return rows.withColumn("index", (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))


def binned_sum(pixels: DataFrame, binning: int, value: str, keys: list[str] = ()) -> DataFrame:  # type: ignore[assignment]
    """(keys, y, x, value) of a sparse image with binning x binning pixels in one."""
    return pixels.groupBy(*keys, F.floor(F.col("y") / binning).cast("int").alias("y"), F.floor(F.col("x") / binning).cast("int").alias("x")).agg(F.sum(value).alias(value))


def from_linear_index(triples: DataFrame, width: int) -> DataFrame:
    """Sparse triples (fr, i, z) as (frame, y, x, z): x = i modulo width."""
    return triples.select(F.col("fr").alias("frame"), F.floor(F.col("i") / width).cast("int").alias("y"), (F.col("i") % width).cast("int").alias("x"), "z")


def bead_averages(pixels: DataFrame, beads: DataFrame, half: int) -> DataFrame:
    """(z_bin, dy, dx, mean, n): average window around beads (frame, bead_x, bead_y, z_bin), the measured point-spread function."""
    steps = F.sequence(F.lit(-half), F.lit(half))
    wanted = beads.select("frame", "z_bin", "bead_x", "bead_y", F.explode(steps).alias("dy")).withColumn("dx", F.explode(steps))
    wanted = wanted.select("frame", "z_bin", "dy", "dx", (F.col("bead_y") + F.col("dy")).alias("y"), (F.col("bead_x") + F.col("dx")).alias("x"))
    return wanted.join(pixels, ["frame", "y", "x"]).groupBy("z_bin", "dy", "dx").agg(F.avg("adu").alias("mean"), F.count("*").alias("n"))


def cluster_colours(members: DataFrame, cluster: str, scale: float) -> DataFrame:
    """(ix, iy, r, g, b): sums of a colour that each cluster id draws by hash, coordinates cut to whole pixels."""
    shade = lambda k: (F.pmod(F.xxhash64(F.lit(k), F.col(cluster)), F.lit(256)) / 255.0)
    cells = members.select((F.col("x") * scale).cast("int").alias("ix"), (F.col("y") * scale).cast("int").alias("iy"), shade(0).alias("r"), shade(1).alias("g"), shade(2).alias("b"))
    return cells.groupBy("ix", "iy").agg(*[F.sum(c).alias(c) for c in "rgb"])
