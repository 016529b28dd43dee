"""Maps between two lists of points by geometric hashing: hypotheses, their scores, the best of them, and its refinement.

Many pairs of lists can be mapped at once: keys (a field of view, a frame) name the
pair, and every step is one plan over all keys. A hypothesis is the affine map of four
matching points; its score compares all points of the second list, moved by it, with
the first list through cells, so no pair of far points is looked at. Maps are rows:
x1 = x0 + xx * x2 + xy * y2 and y1 = y0 + yx * x2 + yy * y2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glintloom.operators.shared import checkpointed, written
from glintloom.operators.spatial import pairs_within, quad_matches, quads

MAP = ("x0", "xx", "xy", "y0", "yx", "yy")
#: Beyond so many pixels exp(-d * d / 2) adds less than 1e-14 to a score.
FAR = 8.0
#: Fixed value: a map is good if its score is over this.
GOOD = 10.0
MAX_ROUNDS = 20
#: Up to so many pairs of a map and a point all maps are scored on all points at once.
FEW_SCORES = 5_000_000
#: Points of a key, about, on which every map is looked at first.
_FIRST_POINTS = 8


def affine_columns(n: Column, s: dict[str, Column]) -> dict[str, Column]:
    """Least squares of x1 and y1 on (1, x2, y2) from sums: s has x1, y1, x2, y2, x2x2, x2y2, y2y2, x2x1, y2x1, x2y1, y2y1. Null where the points lie on a line."""
    spread = lambda a, b: s[a + b] - s[a] * s[b] / n
    xx, xy, yy = spread("x2", "x2"), spread("x2", "y2"), spread("y2", "y2")
    det = xx * yy - xy * xy
    safe = F.when(F.abs(det) > 1e-12 * xx * yy, det)
    out = {}
    for c in "xy":
        u, v = spread("x2", f"{c}1"), spread("y2", f"{c}1")
        a, b = (u * yy - v * xy) / safe, (v * xx - u * xy) / safe
        out |= {f"{c}0": (s[f"{c}1"] - a * s["x2"] - b * s["y2"]) / n, f"{c}x": a, f"{c}y": b}
    return out


_PAIRS = ("x2x2", "x2y2", "y2y2", "x2x1", "y2x1", "x2y1", "y2y1")


def all_matches(first: DataFrame, second: DataFrame, tolerance: float, keys: list[str] = ()) -> DataFrame:  # type: ignore[assignment]
    """(keys, a1 .. d1, a2 .. d2) of quads that match as they are or with x and y swapped (a mirrored map), each pair once."""
    mirrored = second.withColumns({"h_xc": F.col("h_yc"), "h_yc": F.col("h_xc"), "h_xd": F.col("h_yd"), "h_yd": F.col("h_xd")})
    return quad_matches(first, second.unionByName(mirrored), tolerance, list(keys)).distinct()


def hypotheses(matches: DataFrame, first: DataFrame, second: DataFrame, point_id: str, keys: list[str] = ()) -> DataFrame:  # type: ignore[assignment]
    """(keys, a1 .. d2, x0 .. yy): the affine map from the second list to the first by the four points of each match. Matches on a line have none."""
    keys = list(keys)
    corners = F.array(*[F.struct(F.col(f"{c}1").alias("p1"), F.col(f"{c}2").alias("p2")) for c in "abcd"])
    quad = [f"{c}{k}" for k in (1, 2) for c in "abcd"]
    each = matches.select(*keys, *quad, F.explode(corners).alias("c")).select(*keys, *quad, "c.*")
    place = lambda t, k: t.select(*keys, F.col(point_id).alias(f"p{k}"), F.col("x").cast("double").alias(f"x{k}"), F.col("y").cast("double").alias(f"y{k}"))
    met = each.join(place(first, 1), [*keys, "p1"]).join(place(second, 2), [*keys, "p2"])
    sums = {c: F.sum(c) for c in ("x1", "y1", "x2", "y2")} | {p: F.sum(F.col(p[:2]) * F.col(p[2:])) for p in _PAIRS}
    fitted = met.groupBy(*keys, *quad).agg(*[v.alias(f"s_{k}") for k, v in sums.items()])
    maps = affine_columns(F.lit(4.0), {k: F.col(f"s_{k}") for k in sums})
    return fitted.select(*keys, *quad, *[maps[m].alias(m) for m in MAP]).where(F.col("xx").isNotNull())


def moved(points: DataFrame) -> DataFrame:
    """points with columns of a map beside them, their x and y moved by it."""
    x, y = F.col("x"), F.col("y")
    return points.withColumns({"x": F.col("x0") + F.col("xx") * x + F.col("xy") * y, "y": F.col("y0") + F.col("yx") * x + F.col("yy") * y})


def _hits(maps: DataFrame, first: DataFrame, points: DataFrame, point_id: str, map_id: str, keys: list[str]) -> DataFrame:
    """(keys, map_id, hits): sum of exp(-d * d / 2) over points, moved by each map, that have one of the first list nearby; maps without such points have no row."""
    there = moved(maps.select(*keys, map_id, *MAP).join(points, keys)).select(*keys, F.struct(map_id, point_id).alias("at"), "x", "y")
    # the points of first are repeated for the cells around them, the far more moved ones are not
    near = pairs_within(first, there, FAR, point_id, "at", keys).groupBy(*keys, "r_at").agg(F.min("d2").alias("d2"))
    return near.groupBy(*keys, F.col(f"r_at.{map_id}").alias(map_id)).agg(F.sum(F.exp(-F.col("d2") / 2)).alias("hits"))


def contenders(maps: DataFrame, first: DataFrame, second: DataFrame, point_id: str, keys: list[str]) -> DataFrame:
    """Of maps (keys, corners, x0 .. yy) those that can have the highest score of their key; the others cannot.

    A point adds at most 1 to the hits of a map. So a map is out once its hits so far and
    the points not yet looked at together are less than all hits of the map that has led
    so far. Points come in rounds, drawn by hash, each as many as all before; where one map fits
    nearly all points, few are needed to tell most maps off. Without such a map none is
    left out before about all points are looked at.
    Of maps that agree in ten decimals (seven of the shift), as those of one true map do, the one with the smallest corners is taken.
    """
    points = second.select(*keys, point_id, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    sizes = written(points.groupBy(*keys).agg(F.count("*").alias("n")))
    few = lambda t: (t.groupBy(*keys).agg(F.count("*").alias("maps")).join(sizes, keys).agg(F.sum(F.col("maps") * F.col("n"))).first()[0] or 0) <= FEW_SCORES
    if few(maps):
        return maps
    alike = [F.round(m, 7 if m in ("x0", "y0") else 10).alias(f"r_{m}") for m in MAP]
    one = maps.groupBy(*keys, *alike).agg(F.min(F.struct("corners", *MAP)).alias("t")).select(*keys, "t.*")
    now = written(one.withColumns({"hits": F.lit(0.0), "seen": F.lit(0).cast("long")}))
    drawn = F.pmod(F.xxhash64(point_id), F.lit(1 << 40)) / (1 << 40) * F.col("n") / _FIRST_POINTS
    turn = F.when(drawn < 1, 0).otherwise(F.floor(F.log2(drawn)) + 1).cast("int")
    points = written(points.join(sizes, keys).withColumn("turn", turn).drop("n"))
    last, best, k = points.agg(F.max("turn")).first()[0], None, 0
    while k <= last and not few(now):
        some = points.where(F.col("turn") == k).drop("turn")
        more = _hits(now, first, some, point_id, "corners", keys).withColumnRenamed("hits", "more")
        many = some.groupBy(*keys).agg(F.count("*").alias("many"))
        now = now.join(more, [*keys, "corners"], "left").join(many, keys, "left")
        now = written(now.select(*keys, "corners", *MAP, (F.col("hits") + F.coalesce("more", F.lit(0.0))).alias("hits"), (F.col("seen") + F.coalesce("many", F.lit(0))).alias("seen")))
        leads = now.groupBy(*keys).agg(F.max(F.struct("hits", "corners", *MAP)).alias("t")).select(*keys, "t.*").drop("hits")
        sure = _hits(written(leads), first, points.drop("turn"), point_id, "corners", keys).select(*keys, F.col("hits").alias("sure"))
        best = written((sure if best is None else sure.unionByName(best)).groupBy(*keys).agg(F.max("sure").alias("sure")))
        open_ = F.col("hits") + F.col("n") - F.col("seen") >= F.coalesce("sure", F.lit(0.0)) - 1e-9 * F.col("n")
        now = written(now.join(sizes, keys).join(best, keys, "left").where(open_).select(*now.columns))
        k += 1
    return now.select(*keys, "corners", *MAP)


def scores(maps: DataFrame, first: DataFrame, second: DataFrame, point_id: str, map_id: str, background: float, keys: list[str]) -> DataFrame:
    """(keys, map_id, score): log of foreground over background probability of each map.

    The foreground is background + (1 - background) * mean of exp(-d * d / 2) over the
    points of the second list, d being the distance to the nearest point of the first.
    background is one over the pixels of the image.
    """
    points = second.select(*keys, point_id, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    sizes = second.groupBy(*keys).agg(F.count("*").alias("n"))
    hits = _hits(maps, first, points, point_id, map_id, keys)
    rated = maps.select(*keys, map_id).join(hits, [*keys, map_id], "left").join(sizes, keys)
    share = F.coalesce("hits", F.lit(0.0)) / F.col("n")
    return rated.select(*keys, map_id, F.log((F.lit(background) + (1 - background) * share) / background).alias("score"))


def best_maps(first: DataFrame, second: DataFrame, point_id: str, keys: list[str], background: float, min_size: float = 5.0, max_size: float = 100.0, neighbours: int = 20, tolerance: float = 0.01) -> DataFrame:
    """(keys, score, x0 .. yy): for each key the map with the highest score among all matches of quads; of equals the one with the smallest corners. Keys without a match have no row.

    A score over GOOD stands for a map; random points reach up to some 9.7.
    """
    sides = [checkpointed(quads(p, point_id, min_size, max_size, neighbours, keys)) for p in (first, second)]
    found = hypotheses(all_matches(*sides, tolerance, keys), first, second, point_id, keys)
    corners = [f"{c}{k}" for k in (1, 2) for c in "abcd"]
    maps = written(found.withColumn("corners", F.struct(*corners)).drop(*corners))
    maps = contenders(maps, first, second, point_id, keys)
    rated = scores(maps, first, second, point_id, "corners", background, keys)
    top = rated.groupBy(*keys).agg(F.min(F.struct((-F.col("score")).alias("score"), "corners")).alias("t"))
    top = top.select(*keys, (-F.col("t.score")).alias("score"), "t.corners")
    return top.join(maps, [*keys, "corners"]).select(*keys, "score", *MAP)


def control_pairs(maps: DataFrame, first: DataFrame, second: DataFrame, point_id: str, keys: list[str], max_distance: float = 1.0) -> DataFrame:
    """(keys, x1, y1, x2, y2): points of the second list that the key's map moves to less than max_distance of a point of the first."""
    points = second.select(*keys, point_id, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    there = moved(maps.select(*keys, *MAP).join(points, keys)).select(*keys, point_id, "x", "y")
    within = pairs_within(there, first, max_distance, point_id, point_id, keys).where(F.col("d2") < max_distance * max_distance)
    near = within.groupBy(*keys, F.col(f"l_{point_id}").alias(point_id)).agg(F.min(F.struct("d2", F.col(f"r_{point_id}").alias("nearest_id"))).alias("b"))
    near = near.select(*keys, point_id, "b.nearest_id")
    own = points.select(*keys, point_id, F.col("x").alias("x2"), F.col("y").alias("y2"))
    other = first.select(*keys, F.col(point_id).alias("nearest_id"), F.col("x").cast("double").alias("x1"), F.col("y").cast("double").alias("y1"))
    return near.join(own, [*keys, point_id]).join(other, [*keys, "nearest_id"]).select(*keys, "x1", "y1", "x2", "y2")


def fitted_maps(pairs: DataFrame, keys: list[str], back: bool = False) -> DataFrame:
    """(keys, n, x0 .. yy): affine map of each key by least squares over its control points; with back the map from the first list to the second."""
    pairs = pairs.select(*keys, F.col("x2").alias("x1"), F.col("y2").alias("y1"), F.col("x1").alias("x2"), F.col("y1").alias("y2")) if back else pairs
    sums = {c: F.sum(c) for c in ("x1", "y1", "x2", "y2")} | {p: F.sum(F.col(p[:2]) * F.col(p[2:])) for p in _PAIRS}
    summed = pairs.groupBy(*keys).agg(F.count("*").alias("n"), *[v.alias(f"s_{k}") for k, v in sums.items()])
    maps = affine_columns(F.col("n").cast("double"), {k: F.col(f"s_{k}") for k in sums})
    return summed.select(*keys, "n", *[maps[m].alias(m) for m in MAP]).where(F.col("xx").isNotNull())


def refined_maps(maps: DataFrame, first: DataFrame, second: DataFrame, point_id: str, keys: list[str], max_distance: float = 1.0, settled: float = 1e-9) -> DataFrame:
    """(keys, n, x0 .. yy, back_x0 .. back_yy): maps fitted to their control points again and again until none moves by more than `settled`, and the maps back.

    A key with under three control points, or with all of them on a line, drops out.
    """
    now = checkpointed(maps.select(*keys, F.lit(0).cast("long").alias("n"), *MAP))
    for _ in range(MAX_ROUNDS):
        after = checkpointed(fitted_maps(control_pairs(now, first, second, point_id, keys, max_distance), keys))
        step = F.greatest(*[F.abs(F.col(m) - F.col(f"was_{m}")) for m in MAP])
        moving = after.join(now.select(*keys, F.col("n").alias("was_n"), *[F.col(m).alias(f"was_{m}") for m in MAP]), keys).where((F.col("n") != F.col("was_n")) | (step > settled))
        now = after
        if moving.isEmpty():
            break
    pairs = control_pairs(now, first, second, point_id, keys, max_distance)
    back = fitted_maps(pairs, keys, back=True).drop("n")
    return now.join(back.select(*keys, *[F.col(m).alias(f"back_{m}") for m in MAP]), keys)
