"""Cells of the plane around points (a Voronoi tessellation), and clusters of small cells that touch.

Points are dealt to square tiles with a border of one small cell around them. A task
finds the cell of each of its points from the points nearby. The cell is certain if no
point that the task does not see can reach it: every corner is the centre of an empty
circle through the point, and twice the largest radius must fit into the border. Certain
points leave, together with their neighbours, which stay as known neighbours of those
that are not certain yet; these are tried again with tiles twice as wide, among
themselves only. So wide tiles never hold more than the rims of gaps, and the last tile
the points around the whole.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintloom.operators.cluster import neighbour_clusters
from glintloom.operators.shared import checkpointed, written

#: Most points in one small cell of the first round, and small cells along the side of a tile.
CELL_POINTS, TILE_CELLS = 24, 8
#: So few points left are settled in one tile.
LAST_POINTS = 2_000
#: More points than this on the rim of the whole are refused, as they would meet in one task.
MOST_LAST = 50_000
_NEAREST = 32
_FLAT = 1e-12


def _hull(points: list[tuple[float, float, int]]) -> list[tuple[float, float, int]]:
    """Corners of the convex hull against the clock; points are sorted by place."""

    def half(run: list[tuple[float, float, int]]) -> list[tuple[float, float, int]]:
        out: list[tuple[float, float, int]] = []
        for p in run:
            while len(out) > 1:
                ax, ay = out[-1][0] - out[-2][0], out[-1][1] - out[-2][1]
                bx, by = p[0] - out[-2][0], p[1] - out[-2][1]
                if ax * by - ay * bx > _FLAT * math.sqrt((ax * ax + ay * ay) * (bx * bx + by * by)):
                    break
                out.pop()
            out.append(p)
        return out

    low, high = half(points), half(points[::-1])
    return low[:-1] + high[:-1] if len(points) > 1 else points


def cell_of(dx: np.ndarray, dy: np.ndarray) -> tuple[list[int], float, float]:
    """(neighbours, area, reach) of the cell around the origin among points (dx, dy), none of them at the origin.

    reach is twice the distance of the farthest corner: points beyond it cannot change
    the cell. Area and reach are infinite where the cell is open. Neighbours share a side.

    A point u cuts the plane at x . 2u/|u|^2 = 1; the sides of the cell are the corners
    of the hull of these 2u/|u|^2, and the cell is open if the origin is one of them.
    """
    d = dx * dx + dy * dy
    several = len(d) > 2 * _NEAREST
    near = np.argpartition(d, _NEAREST)[:_NEAREST] if several else np.arange(len(d))
    while True:
        s = 2 / d[near]
        dual = sorted(zip((dx[near] * s).tolist(), (dy[near] * s).tolist(), near.tolist(), strict=True))
        where = 0
        while where < len(dual) and (dual[where][0], dual[where][1]) < (0.0, 0.0):
            where += 1
        corners = _hull([*dual[:where], (0.0, 0.0, -1), *dual[where:]])
        inside = len(corners) > 2 and all(k >= 0 for _, _, k in corners)
        area, most = 0.0, 0.0
        if inside:
            xs, ys = [], []
            for (ax, ay, _), (bx, by, _) in zip(corners, corners[1:] + corners[:1], strict=True):
                cross = ax * by - ay * bx
                if cross <= 0:
                    inside = False
                    break
                x, y = (by - ay) / cross, (ax - bx) / cross
                xs.append(x)
                ys.append(y)
                most = max(most, x * x + y * y)
            area = sum(xs[i - 1] * ys[i] - xs[i] * ys[i - 1] for i in range(len(xs))) / 2 if inside else 0.0
        if not inside:
            area = most = math.inf
        if not several or 4 * most <= d[near].max():
            return [k for _, _, k in corners if k >= 0], area, 2 * math.sqrt(most)
        # all points that may still reach the cell
        near, several = (np.flatnonzero(d <= 4 * most * (1 + 1e-9)) if inside else np.arange(len(d))), False


def _tile_cells(pdf: pd.DataFrame, own: np.ndarray, width: float, last: bool) -> pd.DataFrame:
    """Cells of the points marked own; those that are not certain have done = False and no neighbours."""
    x, y = pdf["x"].to_numpy(float), pdf["y"].to_numpy(float)
    place = pdf["place"].to_numpy()
    if last:
        cells = {(0, 0): np.arange(len(x))}
        at = np.zeros((len(x), 2), np.int64)
    else:
        at = np.stack([np.floor(x / width), np.floor(y / width)], axis=1).astype(np.int64)
        order = np.lexsort((at[:, 1], at[:, 0]))
        cuts = np.flatnonzero(np.any(np.diff(at[order], axis=0) != 0, axis=1)) + 1
        cells = {tuple(at[part[0]].tolist()): part for part in np.split(order, cuts)}
    around: dict[tuple[int, int], np.ndarray] = {}
    rows = []
    for i in np.flatnonzero(own).tolist():
        cx, cy = at[i].tolist()
        if (cx, cy) not in around:
            found = [cells[c] for c in ((cx + a, cy + b) for a in (-1, 0, 1) for b in (-1, 0, 1)) if c in cells]
            around[cx, cy] = np.concatenate(found)
        near = around[cx, cy]
        near = near[near != i]
        kx, ky, kp = (pdf[c].iat[i] for c in ("known_x", "known_y", "known"))
        dx, dy = np.concatenate([x[near], kx]) - x[i], np.concatenate([y[near], ky]) - y[i]
        if len(dx) == 0:
            rows.append((i, last, math.inf, [], [], []))
            continue
        sides, area, reach = cell_of(dx, dy)
        if not last and reach > width:
            rows.append((i, False, math.inf, [], [], []))
            continue
        names = [place[near[k]] if k < len(near) else kp[k - len(near)] for k in sides]
        rows.append((i, True, area, names, (dx[sides] + x[i]).tolist(), (dy[sides] + y[i]).tolist()))
    out = pdf.iloc[[r[0] for r in rows]].drop(columns=["known", "known_x", "known_y"])
    for k, (name, kind) in enumerate((("done", bool), ("area", float), ("neighbours", object), ("neighbours_x", object), ("neighbours_y", object)), 1):
        out[name] = pd.Series([r[k] for r in rows], index=out.index, dtype=kind)
    return out


def _round(open_: DataFrame, keys: list[str], width: float, last: bool) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in open_.schema.fields}
    schema = ", ".join([f"{k} {kinds[k]}" for k in (*keys, "place", "x", "y")] + [f"done boolean, area double, neighbours array<{kinds['place']}>, neighbours_x array<double>, neighbours_y array<double>"])
    columns = [*keys, "place", "x", "y"]
    if last:
        groups, tile = open_.withColumn("own", F.lit(True)), []
    else:
        side = width * TILE_CELLS
        near = F.array(*[F.lit(k * width) for k in (-1.0, 0.0, 1.0)])
        reach = lambda c: F.array_distinct(F.transform(near, lambda k: F.floor((F.col(c) + k) / side)))
        groups = open_.withColumn("tx", F.explode(reach("x"))).withColumn("ty", F.explode(reach("y")))
        groups = groups.withColumn("own", (F.col("tx") == F.floor(F.col("x") / side)) & (F.col("ty") == F.floor(F.col("y") / side)))
        tile = ["tx", "ty"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = _tile_cells(pdf, pdf["own"].to_numpy(bool), width, last)
        return found[[*columns, "done", "area", "neighbours", "neighbours_x", "neighbours_y"]]

    return groups.groupBy(*keys, *tile).applyInPandas(run, schema)


def _first_width(places: DataFrame, keys: list[str], extent: float, n: int) -> float:
    """A cell width at which no cell holds more than CELL_POINTS places; places differ, so there is one."""
    width = extent / max(1.0, math.sqrt(n)) * 2
    for _ in range(60):
        most = places.groupBy(*keys, F.floor(F.col("x") / width), F.floor(F.col("y") / width)).count().agg(F.max("count")).first()[0]
        if most <= CELL_POINTS or width < extent * 1e-14:
            break
        width *= max(0.05, min(0.7, math.sqrt(CELL_POINTS / most) * 0.8))
    return width


def cells(points: DataFrame, point_id: str, keys: list[str] = (), last_points: int = LAST_POINTS) -> DataFrame:  # type: ignore[assignment]
    """(keys, place, x, y, copies, area, neighbours): the cell of every place of each key.

    place is the smallest id of the points that stand there and copies their number;
    area is null for cells without an end; neighbours are the places that share a side.
    Points without finite coordinates have no cell. A key of one place has an open cell
    without neighbours, and an empty table no cells.
    """
    keys = list(keys)
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    named = points.select(*keys, F.col(point_id).alias("place"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where(finite("x") & finite("y"))
    places = checkpointed(named.groupBy(*keys, "x", "y").agg(F.min("place").alias("place"), F.count("*").alias("copies")))
    ends = places.agg(F.count("*").alias("n"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    kind = places.schema["place"].dataType.simpleString()
    empty = lambda t: F.array().cast(f"array<{t}>")
    open_ = places.select(*keys, "place", "x", "y", empty(kind).alias("known"), empty("double").alias("known_x"), empty("double").alias("known_y"))
    extent = max(ends[2] - ends[1], ends[4] - ends[3], 1e-300) if ends["n"] else 1.0
    left, width, settled = ends["n"], 0.0, []
    while left:
        last = left <= last_points or width > 2 * extent
        if last and left > MOST_LAST:
            most = open_.groupBy(*keys).count().agg(F.max("count")).first()[0]
            if most > MOST_LAST:
                raise ValueError(f"{most} points lie on the rim of the whole; at most {MOST_LAST} fit one task")
        if not last and not width:
            width = _first_width(places, keys, extent, left)
        tried = checkpointed(_round(open_, keys, width, last))
        done = tried.where("done")
        settled.append(done.drop("done"))
        if last:
            break
        again = tried.where("NOT done").select(*keys, "place", "x", "y")
        # what certain cells say of their open neighbours
        told = done.select(*keys, F.col("place").alias("by"), F.col("x").alias("by_x"), F.col("y").alias("by_y"), F.explode("neighbours").alias("place"))
        told = told.groupBy(*keys, "place").agg(F.collect_list(F.struct("by", "by_x", "by_y")).alias("told"))
        before = open_.select(*keys, "place", "known", "known_x", "known_y")
        joined = again.join(before, [*keys, "place"]).join(told, [*keys, "place"], "left")
        more = lambda old, new: F.concat(F.col(old), F.coalesce(F.col(f"told.{new}"), F.array().cast(joined.schema[old].dataType)))
        open_ = written(joined.select(*keys, "place", "x", "y", more("known", "by").alias("known"), more("known_x", "by_x").alias("known_x"), more("known_y", "by_y").alias("known_y")))
        left = open_.count()
        width *= 2
    if not settled:
        return places.select(*keys, "place", "x", "y", "copies", F.lit(None).cast("double").alias("area"), empty(kind).alias("neighbours"))
    every = settled[0]
    for part in settled[1:]:
        every = every.unionByName(part)
    area = F.when(F.col("area") < float("inf"), F.col("area"))
    return every.select(*keys, "place", area.alias("area"), "neighbours").join(places, [*keys, "place"]).select(*keys, "place", "x", "y", "copies", "area", "neighbours")


def densities(points: DataFrame, tessellation: DataFrame, point_id: str) -> DataFrame:
    """(node, density) of every point: points of its place over the area of its cell, 0 where the cell is open or there is none."""
    at = tessellation.select("x", "y", (F.col("copies") / F.col("area")).alias("density"))
    named = points.select(F.col(point_id).alias("node"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return named.join(at, ["x", "y"], "left").select("node", F.coalesce("density", F.lit(0.0)).alias("density"))


def edges(points: DataFrame, tessellation: DataFrame, point_id: str) -> DataFrame:
    """(a, b) of places that share a side, once for each pair, and of points with the place that they stand on."""
    sides = tessellation.select(F.col("place").alias("a"), F.explode("neighbours").alias("b"))
    sides = sides.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    several = tessellation.where("copies > 1").select("x", "y", F.col("place").alias("a"))
    named = points.select(F.col(point_id).alias("b"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return sides.unionByName(named.join(several, ["x", "y"]).where("a <> b").select("a", "b"))


def voronoi_clusters(points: DataFrame, point_id: str, factor: float, least: int, pixel_size: float = 1.0) -> DataFrame:
    """points with density (in 1 over the square of pixel_size's unit) and cluster_id.

    Clusters are connected cells denser than factor times the median density, more than
    `least` of them; they are numbered from 0 in the order of their smallest id, and
    other points have -1.
    """
    scaled = points.withColumns({"x": F.col("x") * pixel_size, "y": F.col("y") * pixel_size})
    found = checkpointed(cells(scaled, point_id))
    dense = checkpointed(densities(scaled, found, point_id))
    named = neighbour_clusters(dense, edges(scaled, found, point_id), factor, least).select(F.col("node").alias(point_id), "cluster_id")
    out = points.join(dense.withColumnRenamed("node", point_id), point_id, "left").join(named, point_id, "left")
    return out.withColumn("cluster_id", F.coalesce(F.col("cluster_id") - 1, F.lit(-1)).cast("int"))
