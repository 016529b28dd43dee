"""Spatial joins: within a radius, nearest, mutual nearest, k nearest, and what builds on them.

Points meet through square cells as wide as the radius: a left point is repeated for the
nine cells around it and joined by equality, so no pair farther apart than two cells is
ever looked at. Searches for the k nearest, bounded or not, begin at a radius that suits
the densest place and go on with wider ones for those points that have not found k yet;
see _nearest_few().
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glintloom.operators.shared import written

#: Up to so many pairs the k nearest are taken from all pairs within the radius.
FEW_PAIRS = 5_000_000
#: Most places in one cell of the grid that tells the greatest density.
_CELL_PLACES = 64


def _square(dx: Column, dy: Column, dz: Column | None = None) -> Column:
    d = dx * dx + dy * dy
    return d if dz is None else d + dz * dz


def pairs_within(left: DataFrame, right: DataFrame, radius: float, left_id: str, right_id: str, keys: list[str] = (), dims: tuple[str, ...] = ("x", "y")) -> DataFrame:  # type: ignore[assignment]
    """(keys, left_id, right_id, d2) of all pairs at most radius apart; ids named l_<id> and r_<id>. None for radius <= 0."""
    keys = list(keys)
    if radius <= 0:
        left = left.limit(0)
        radius = 1.0
    near = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    cell = lambda c: F.floor(F.col(c) / radius)
    lcols = [F.col(left_id).alias(f"l_{left_id}"), *[F.col(d).alias(f"l_{d}") for d in dims]]
    rcols = [F.col(right_id).alias(f"r_{right_id}"), *[F.col(d).alias(f"r_{d}") for d in dims]]
    a = left.select(*keys, *lcols, F.explode(F.transform(near, lambda k: cell("x") + k)).alias("__cx"), cell("y").alias("__y")).withColumn("__cy", F.explode(F.transform(near, lambda k: F.col("__y") + k))).drop("__y")
    b = right.select(*keys, *rcols, cell("x").alias("__cx"), cell("y").alias("__cy"))
    d2 = _square(*[F.col(f"l_{d}") - F.col(f"r_{d}") for d in dims])
    joined = a.join(b, [*keys, "__cx", "__cy"]).withColumn("d2", d2).where(F.col("d2") <= radius * radius)
    return joined.select(*keys, f"l_{left_id}", f"r_{right_id}", "d2")


def nearest_within(left: DataFrame, right: DataFrame, radius: float, left_id: str, right_id: str, keys: list[str] = ()) -> DataFrame:  # type: ignore[assignment]
    """For every left point its nearest right point at most radius away: (keys, left_id, right_id, distance), -1 and -1 without one. Smallest id of equals."""
    found = pairs_within(left, right, radius, left_id, right_id, keys)
    best = found.groupBy(*keys, f"l_{left_id}").agg(F.min(F.struct("d2", f"r_{right_id}")).alias("b"))
    best = best.select(*keys, F.col(f"l_{left_id}").alias(left_id), F.col(f"b.r_{right_id}").alias("nearest_id"), F.sqrt("b.d2").alias("distance"))
    out = left.select(*keys, left_id).join(best, [*keys, left_id], "left")
    return out.select(*keys, left_id, F.coalesce("nearest_id", F.lit(-1)).alias("nearest_id"), F.coalesce("distance", F.lit(-1.0)).alias("distance"))


def _extent(points: DataFrame) -> tuple[int, float]:
    """Number of points, and the diagonal of their bounding box."""
    n, *ends = points.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    return n, math.hypot(ends[1] - ends[0], ends[3] - ends[2]) if n and None not in ends else 0.0


def _density(points: DataFrame, keys: list[str], n: int, extent: float) -> float:
    """About the greatest density of places, in a grid fine enough for no cell to hold many."""
    places = written(points.select(*keys, "x", "y").distinct())
    width = extent / math.sqrt(n) * 4
    for _ in range(40):
        most = places.groupBy(*keys, F.floor(F.col("x") / width), F.floor(F.col("y") / width)).count().agg(F.max("count")).first()[0]
        if most <= _CELL_PLACES:
            break
        width /= 2
    return most / (width * width)


def _nearest_few(left: DataFrame, right: DataFrame, k: int, radius: float, left_id: str, right_id: str, keys: list[str], among: Column, min_distance: float = 0.0) -> DataFrame:
    """(keys, l_<id>, r_<id>, d2, rank from 1) of the k nearest right points within radius, of the pairs that `among` holds for.

    All pairs within a radius hold the k nearest of every left point that has k of them;
    the others are searched again in a ring of four times the area beyond min_distance.
    So each round moves some pairs for a point, however many lie within the last radius.
    """
    l_id, r_id = f"l_{left_id}", f"r_{right_id}"
    order = Window.partitionBy(*keys, l_id).orderBy("d2", r_id)
    ranked = lambda points, width: pairs_within(points, right, width, left_id, right_id, keys).where(among).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    (n, extent), many = _extent(right), left.count()
    if many * n <= FEW_PAIRS or not 0 < extent < math.inf or radius <= 0:
        return ranked(left, radius)
    area = 4 * k / math.pi / _density(right, keys, n, extent)
    least = max(0.0, min_distance) ** 2
    open_, out = left.select(*keys, left_id, "x", "y"), None
    while True:
        width = math.sqrt(least + area)
        last = width >= radius
        found = written(ranked(open_, radius if last else width))
        done = found.where(F.col("rank") == k).select(*keys, F.col(l_id).alias(left_id))
        kept = found if last else found.join(done.withColumnRenamed(left_id, l_id), [*keys, l_id], "left_semi")
        out = kept if out is None else out.unionByName(kept)
        if last:
            return out
        open_ = written(open_.join(done, [*keys, left_id], "left_anti"))
        if open_.isEmpty():
            return out
        area *= 4


def nearest(left: DataFrame, right: DataFrame, left_id: str, right_id: str, keys: list[str]) -> DataFrame:
    """For every left point the nearest right point of its keys, however far; of equals the one with the smallest id. Keys (a frame) are asked for."""
    keys = list(keys)
    if not keys:
        raise ValueError("an unbounded search needs keys")
    sided = left.join(right.select(*keys).distinct(), keys, "left_semi")
    _, extent = _extent(left.select("x", "y").unionByName(right.select("x", "y")))
    best = _nearest_few(sided, right, 1, 1.001 * extent or 1.0, left_id, right_id, keys, F.lit(True))
    return best.select(*keys, F.col(f"l_{left_id}").alias(left_id), F.col(f"r_{right_id}").alias("nearest_id"), F.sqrt("d2").alias("distance"))


def mutual_nearest(left: DataFrame, right: DataFrame, radius: float, left_id: str, right_id: str, keys: list[str] = ()) -> DataFrame:  # type: ignore[assignment]
    """Pairs that are each other's nearest point within radius: (keys, l_<id>, r_<id>, d2)."""
    found = pairs_within(left, right, radius, left_id, right_id, keys)
    l_id, r_id = f"l_{left_id}", f"r_{right_id}"
    of_left = found.groupBy(*keys, l_id).agg(F.min(F.struct("d2", r_id)).alias("b")).select(*keys, l_id, f"b.{r_id}", "b.d2")
    of_right = found.groupBy(*keys, r_id).agg(F.min(F.struct("d2", l_id)).alias("b")).select(*keys, r_id, f"b.{l_id}")
    return of_left.join(of_right, [*keys, l_id, r_id])


def k_nearest(points: DataFrame, k: int, max_distance: float, point_id: str, keys: list[str] = (), min_distance: float = 0.0) -> DataFrame:  # type: ignore[assignment]
    """The k nearest other points of each with min_distance < d <= max_distance: (keys, l_<id>, r_<id>, d2, rank from 1)."""
    among = (F.col(f"l_{point_id}") != F.col(f"r_{point_id}")) & (F.col("d2") > min_distance * min_distance)
    return _nearest_few(points, points, k, max_distance, point_id, point_id, list(keys), among, min_distance)


def isolated(points: DataFrame, radius: float, point_id: str, keys: list[str] = ()) -> DataFrame:  # type: ignore[assignment]
    """Points without another point nearer than radius."""
    found = pairs_within(points, points, radius, point_id, point_id, keys).where(f"l_{point_id} <> r_{point_id} AND d2 < {radius * radius!r}")
    near = found.select(*keys, F.col(f"l_{point_id}").alias(point_id)).distinct()
    return points.join(near, [*keys, point_id], "left_anti")


def dimmer_neighbours(points: DataFrame, radius: float, point_id: str, brightness: str, keys: list[str] = ()) -> DataFrame:  # type: ignore[assignment]
    """Points with a brighter point within radius."""
    found = pairs_within(points, points, radius, point_id, point_id, keys).where(f"l_{point_id} <> r_{point_id}")
    bright = points.select(*keys, F.col(point_id).alias(f"r_{point_id}"), F.col(brightness).alias("__other"))
    own = points.select(*keys, F.col(point_id).alias(f"l_{point_id}"), F.col(brightness).alias("__own"))
    dim = found.join(bright, [*keys, f"r_{point_id}"]).join(own, [*keys, f"l_{point_id}"]).where("__other > __own")
    return points.join(dim.select(*keys, F.col(f"l_{point_id}").alias(point_id)).distinct(), [*keys, point_id], "left_semi")


def running_near(peaks: DataFrame, new: DataFrame, radius: float, peak_id: str, keys: list[str] = ()) -> DataFrame:  # type: ignore[assignment]
    """peaks whose status CONVERGED becomes RUNNING where a new peak is within radius."""
    near = pairs_within(peaks, new, radius, peak_id, peak_id, keys).select(*keys, F.col(f"l_{peak_id}").alias(peak_id)).distinct().withColumn("__near", F.lit(True))
    status = F.when(F.col("__near") & (F.col("status") == "CONVERGED"), F.lit("RUNNING")).otherwise(F.col("status"))
    return peaks.join(near, [*keys, peak_id], "left").withColumn("status", status).drop("__near")


def low_significance(peaks: DataFrame, least: float, radius: float, peak_id: str, keys: list[str] = ()) -> DataFrame:  # type: ignore[assignment]
    """peaks with status ERROR where significance <= least, and RUNNING where they converged near such a peak."""
    low = peaks.where(F.col("significance") <= least)
    near = pairs_within(peaks, low, radius, peak_id, peak_id, keys).where(f"l_{peak_id} <> r_{peak_id}")
    near = near.select(*keys, F.col(f"l_{peak_id}").alias(peak_id)).distinct().withColumn("__near", F.lit(True))
    status = F.when(F.col("significance") <= least, "ERROR").when(F.col("__near") & (F.col("status") == "CONVERGED"), "RUNNING").otherwise(F.col("status"))
    return peaks.join(near, [*keys, peak_id], "left").withColumn("status", status).drop("__near")


def local_maxima(pixels: DataFrame, radius: float, threshold: float, keys: list[str], z_range: int = 0) -> DataFrame:
    """Pixels (z, y, x, value) above threshold with no greater pixel within radius (and z_range planes); of equals the one last in (y, x, z) order."""
    bright = pixels.where(F.col("value") > threshold)
    r = int(radius)
    steps = [(dy, dx, dz) for dy in range(-r, r + 1) for dx in range(-r, r + 1) for dz in range(-z_range, z_range + 1) if dx * dx + dy * dy <= radius * radius and (dy, dx, dz) != (0, 0, 0)]
    around = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx"), F.lit(c).alias("dz")) for a, b, c in steps])
    reach = bright.select(*keys, F.col("value").alias("__v"), F.col("y").alias("__y"), F.col("x").alias("__x"), F.col("z").alias("__z"), F.explode(around).alias("s"))
    reach = reach.select(*keys, (F.col("__y") + F.col("s.dy")).alias("y"), (F.col("__x") + F.col("s.dx")).alias("x"), (F.col("__z") + F.col("s.dz")).alias("z"), F.struct("__v", "__y", "__x", "__z").alias("__o"))
    best = reach.groupBy(*keys, "y", "x", "z").agg(F.max("__o").alias("__o"))
    own = F.struct(F.col("value").alias("__v"), F.col("y").alias("__y"), F.col("x").alias("__x"), F.col("z").alias("__z"))
    return bright.join(best, [*keys, "y", "x", "z"], "left").where(F.col("__o").isNull() | (own > F.col("__o"))).drop("__o")


def quads(points: DataFrame, point_id: str, min_size: float, max_size: float, neighbours: int = 10, keys: list[str] = ()) -> DataFrame:  # type: ignore[assignment]
    """Four-point hashes: A and B span a circle, C and D lie in it; their places in the frame of A and B are the hash (xc, yc, xd, yd).

    B, C and D are among the nearest neighbours of A that agree with it in keys. Of the two orders of C and D, and
    of A and B, the one with xc <= xd and xc + xd <= 1 is kept.
    """
    keys = list(keys)
    near = k_nearest(points, neighbours, max_size, point_id, keys, min_distance=min_size).select(*keys, F.col(f"l_{point_id}").alias("a"), F.col(f"r_{point_id}").alias("b"))
    place = lambda n: points.select(*keys, F.col(point_id).alias(n), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}"))
    abcd = near.join(near.withColumnRenamed("b", "c"), [*keys, "a"]).where("b <> c").join(near.withColumnRenamed("b", "d"), [*keys, "a"]).where("d <> b AND d <> c")
    for n in "abcd":
        abcd = abcd.join(place(n), [*keys, n])
    inside = " AND ".join(f"pow(x{n} - (xa + xb) / 2, 2) + pow(y{n} - (ya + yb) / 2, 2) <= (pow(xb - xa, 2) + pow(yb - ya, 2)) / 4" for n in "cd")
    framed = abcd.where(inside)
    # rotated by 45 degrees and scaled so that A is (0, 0) and B is (1, 1)
    for n in "cd":
        u = F.expr(f"((x{n} - xa) * (xb - xa) + (y{n} - ya) * (yb - ya)) / (pow(xb - xa, 2) + pow(yb - ya, 2))")
        v = F.expr(f"((y{n} - ya) * (xb - xa) - (x{n} - xa) * (yb - ya)) / (pow(xb - xa, 2) + pow(yb - ya, 2))")
        framed = framed.withColumns({f"h_x{n}": u - v, f"h_y{n}": u + v})
    return framed.where("h_xc <= h_xd AND h_xc + h_xd <= 1").select(*keys, "a", "b", "c", "d", "h_xc", "h_yc", "h_xd", "h_yd")


def quad_matches(first: DataFrame, second: DataFrame, tolerance: float, keys: list[str] = ()) -> DataFrame:  # type: ignore[assignment]
    """Pairs of quads of the same keys whose hashes differ by less than tolerance in every number: (keys, a1 .. d1, a2 .. d2)."""
    dims = ("h_xc", "h_yc", "h_xd", "h_yd")
    near = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    cell = lambda c: F.floor(F.col(c) / tolerance)
    one = first.select(*keys, *[F.col(c).alias(f"{c}1") for c in "abcd"], *[F.col(d).alias(f"{d}1") for d in dims], F.explode(F.transform(near, lambda k: cell(dims[0]) + k)).alias("__p"), cell(dims[1]).alias("__q0"))
    one = one.withColumn("__q", F.explode(F.transform(near, lambda k: F.col("__q0") + k))).drop("__q0")
    two = second.select(*keys, *[F.col(c).alias(f"{c}2") for c in "abcd"], *[F.col(d).alias(f"{d}2") for d in dims], cell(dims[0]).alias("__p"), cell(dims[1]).alias("__q"))
    close = " AND ".join(f"abs({d}1 - {d}2) < {tolerance!r}" for d in dims)
    return one.join(two, [*keys, "__p", "__q"]).where(close).select(*keys, *[f"{c}{n}" for n in (1, 2) for c in "abcd"])


def control_points(first: DataFrame, second: DataFrame, cx: tuple, cy: tuple, max_distance: float, first_id: str, second_id: str) -> DataFrame:
    """Points of the second list, moved by the affine map, with the nearest point of the first list nearer than max_distance."""
    x, y = F.col("x"), F.col("y")
    moved = second.select(second_id, (cx[0] + cx[1] * x + cx[2] * y).alias("x"), (cy[0] + cy[1] * x + cy[2] * y).alias("y"))
    return nearest_within(moved, first, max_distance, second_id, first_id).where("nearest_id >= 0")


def affine_fit(pairs: DataFrame) -> dict[str, tuple[float, float, float]]:
    """Least squares of x1, y1 on (1, x2, y2) over all pairs, from sums that Spark makes; 3 x 3 equations are solved here."""
    import numpy as np

    sums = pairs.agg(F.count("*").alias("n"), *[F.sum(F.expr(e)).alias(a) for a, e in (("sx", "x2"), ("sy", "y2"), ("sxx", "x2*x2"), ("sxy", "x2*y2"), ("syy", "y2*y2"), ("x0", "x1"), ("xx", "x1*x2"), ("xy", "x1*y2"), ("y0", "y1"), ("yx", "y1*x2"), ("yy", "y1*y2"))]).first()
    m = np.array([[sums["n"], sums["sx"], sums["sy"]], [sums["sx"], sums["sxx"], sums["sxy"]], [sums["sy"], sums["sxy"], sums["syy"]]], dtype=float)
    solve = lambda v: tuple(np.linalg.solve(m, np.array(v, dtype=float)).tolist())
    return {"x": solve([sums["x0"], sums["xx"], sums["xy"]]), "y": solve([sums["y0"], sums["yx"], sums["yy"]])}
