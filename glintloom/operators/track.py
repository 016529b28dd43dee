"""Tracking over frames, where each step depends on the one before.

A short movie is one task's work; a long one is not tracked as a whole. The centre of a track is never farther than the
radius from the localization that was added last, and a track that goes on has one in
the last max_gap + 1 frames that count. So a localization can only meet tracks whose
last localization lies within two radii and so many frames: the connected components of
this relation do not touch each other. They are dealt to buckets, each bucket is tracked
in order by one task, and the tracks of all buckets are numbered afterwards as one pass
over the movie would have numbered them. Only a movie whose components hang together
throughout is still one bucket's work.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glintloom.operators.graph import connected_components
from glintloom.operators.shared import checkpointed, small

#: Buckets to which the components of all movies are dealt.
BUCKETS = 256
#: Points of a dataset that one task tracks without a look at what hangs together.
TOGETHER = 200_000


def _nearest(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray, radius: float) -> np.ndarray:
    """For each a the index of the nearest b at most radius away, else -1; first of equals. Cells as wide as the radius keep candidates few."""
    out = np.full(len(ax), -1, dtype=np.int64)
    if radius <= 0 or not len(ax) or not len(bx):
        return out
    if len(ax) * len(bx) <= 250_000:
        d2 = (ax[:, None] - bx[None, :]) ** 2 + (ay[:, None] - by[None, :]) ** 2
        best = d2.argmin(axis=1)
        near = d2[np.arange(len(ax)), best] <= radius * radius
        out[near] = best[near]
        return out
    cells: dict[tuple[int, int], list[int]] = {}
    for j, key in enumerate(zip((bx // radius).astype(int).tolist(), (by // radius).astype(int).tolist(), strict=True)):
        cells.setdefault(key, []).append(j)
    for i, (cx, cy) in enumerate(zip((ax // radius).astype(int).tolist(), (ay // radius).astype(int).tolist(), strict=True)):
        near = sorted(j for u in (-1, 0, 1) for v in (-1, 0, 1) for j in cells.get((cx + u, cy + v), ()))
        if near:
            d2 = (bx[near] - ax[i]) ** 2 + (by[near] - ay[i]) ** 2
            k = int(d2.argmin())
            if d2[k] <= radius * radius:
                out[i] = near[k]
    return out


class TrackState:
    """Live tracks of one movie: sums for the weighted centres, ids and frames since the last localization."""

    def __init__(self) -> None:
        self.w = np.zeros(0)
        self.wx = np.zeros(0)
        self.wy = np.zeros(0)
        self.ids = np.zeros(0, dtype=np.int64)
        self.age = np.zeros(0, dtype=np.int64)
        self.next_id = 0
        #: Of the last frame, which localizations were refused by their nearest track.
        self.refused = np.zeros(0, dtype=bool)

    def pass_frames(self, n: int, max_gap: int) -> None:
        """Ages the tracks by n frames without localizations."""
        self.age = self.age + n
        self._keep(self.age <= max_gap)

    def _keep(self, alive: np.ndarray) -> None:
        self.w, self.wx, self.wy, self.ids, self.age = self.w[alive], self.wx[alive], self.wy[alive], self.ids[alive], self.age[alive]

    def _start(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        ids = np.arange(self.next_id, self.next_id + len(x), dtype=np.int64)
        self.next_id += len(x)
        self.w, self.wx, self.wy = np.concatenate([self.w, w]), np.concatenate([self.wx, w * x]), np.concatenate([self.wy, w * y])
        self.ids, self.age = np.concatenate([self.ids, ids]), np.concatenate([self.age, np.zeros(len(x), dtype=np.int64)])
        return ids

    def frame(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, radius: float, max_gap: int) -> np.ndarray:
        """Track ids of the localizations of the next frame that counts."""
        out = np.full(len(x), -1, dtype=np.int64)
        self.age = self.age + 1
        to_track = np.full(len(x), -1, dtype=np.int64)
        self.refused = np.zeros(len(x), dtype=bool)
        if len(x) and len(self.ids):
            cx, cy = self.wx / self.w, self.wy / self.w
            to_track = _nearest(x, y, cx, cy, radius)
            to_loc = _nearest(cx, cy, x, y, radius)
            mutual = np.array([t >= 0 and to_loc[t] == i for i, t in enumerate(to_track)], dtype=bool)
            hit = to_track[mutual]
            self.w[hit] += w[mutual]
            self.wx[hit] += w[mutual] * x[mutual]
            self.wy[hit] += w[mutual] * y[mutual]
            self.age[hit] = 0
            out[mutual] = self.ids[hit]
            # a localization whose nearest track has a nearer one starts a track at once
            refused = self.refused = (to_track >= 0) & ~mutual
            out[refused] = self._start(x[refused], y[refused], w[refused])
        self._keep(self.age <= max_gap)
        rest = to_track < 0
        out[rest] = self._start(x[rest], y[rest], w[rest])
        return out


def follow(fx: np.ndarray, fy: np.ndarray, age: np.ndarray, ids: np.ndarray, x: np.ndarray, y: np.ndarray, radius: float) -> np.ndarray:
    """Moves each fiducial to the nearest localization within radius, where its age starts anew, and gives the fiducial of each localization, else -1; of two that take the same one the later is written."""
    out = np.full(len(x), -1, dtype=np.int64)
    hit = _nearest(fx, fy, x, y, radius)
    took = np.flatnonzero(hit >= 0)
    fx[took], fy[took], age[took] = x[hit[took]], y[hit[took]], 0
    for k in took:
        out[hit[k]] = ids[k]
    return out


def _components(points: DataFrame, reach: float, steps: int) -> DataFrame:
    """points (dataset_id, t, loc_id, x, y, ..) with bucket: the same for all that hang together over points at most `reach` apart and at most `steps` apart in t.

    Points are linked along t within each pair of neighbouring square cells as wide as
    the reach: two points that can meet lie in such a pair, and those between them in t
    are no farther apart. So there are nine rows and as many links at most for each
    point, however dense they are; points that are linked without need only make
    components larger.
    """
    node = F.struct("dataset_id", "t", "loc_id")
    cell = lambda c: F.floor(F.col(c) / (reach * (1 + 1e-9))).cast("long")
    # a pair of cells is named by its first cell and the way to the second
    ways = [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)]
    own = [F.struct(F.col("cx").alias("px"), F.col("cy").alias("py"), F.lit(k).alias("way")) for k in range(5)]
    other = [F.struct((F.col("cx") - dx).alias("px"), (F.col("cy") - dy).alias("py"), F.lit(k).alias("way")) for k, (dx, dy) in enumerate(ways) if k]
    each = points.select(node.alias("b"), "dataset_id", "t", "loc_id", cell("x").alias("cx"), cell("y").alias("cy")).withColumn("p", F.explode(F.array(*own, *other)))
    along = Window.partitionBy("dataset_id", "p").orderBy("t", "loc_id")
    links = each.select("b", "t", F.lag("b").over(along).alias("a"), F.lag("t").over(along).alias("ta")).where(F.col("t") - F.col("ta") <= steps)
    groups = connected_components(links.select("a", "b").distinct())
    joined = points.withColumn("node", node).join(groups, "node", "left")
    return joined.withColumn("bucket", F.pmod(F.xxhash64(F.coalesce("component", "node")), F.lit(BUCKETS)).cast("int")).drop("node", "component")


def _by_size(rows: DataFrame, whole: Callable[[DataFrame], DataFrame], cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """whole() of the datasets with up to TOGETHER rows, and cut() of the others; both give the same results."""
    large = checkpointed(rows.groupBy("dataset_id").count().where(F.col("count") > TOGETHER).select("dataset_id"))
    if large.isEmpty():
        return whole(rows)
    parts = [rows.join(small(large), "dataset_id", how).select(*rows.columns) for how in ("left_anti", "left_semi")]
    return whole(parts[0]).unionByName(cut(parts[1]))


def _counted(frame: Column, descriptor: str) -> Column:
    """How many frames before this one count."""
    before = [sum(c != "0" for c in descriptor[:k]) for k in range(len(descriptor) + 1)]
    within = F.array(*[F.lit(n) for n in before])
    return (F.floor(frame / len(descriptor)) * before[-1] + within[F.pmod(frame, F.lit(len(descriptor))).cast("int")]).cast("long")


def _bucket_tracks(pdf: pd.DataFrame, radius: float, max_gap: int) -> pd.DataFrame:
    """Rows of one bucket in order with local_id, and phase at the first row of a track: 0 if its localization was refused by another track, else 1."""
    pdf = pdf.sort_values(["t", "loc_id"], kind="stable").reset_index(drop=True)
    x, y, w = (pdf[c].to_numpy(float) for c in ("x", "y", "w"))
    t, ids, refused, live = pdf["t"].to_numpy(), np.full(len(pdf), -1, np.int64), np.zeros(len(pdf), bool), TrackState()
    starts = np.flatnonzero(np.r_[True, t[1:] != t[:-1]]) if len(t) else np.zeros(0, np.int64)
    last = None
    for a, b in pairwise([*starts.tolist(), len(t)]):
        if last is not None and t[a] - last > 1:
            live.pass_frames(int(t[a] - last) - 1, max_gap)
        ids[a:b] = live.frame(x[a:b], y[a:b], w[a:b], radius, max_gap)
        refused[a:b], last = live.refused, t[a]
    first = np.zeros(len(ids), bool)
    first[np.unique(ids, return_index=True)[1]] = True
    return pdf.assign(local_id=ids, phase=np.where(first, np.where(refused, 0, 1), -1).astype(np.int32))


def tracker(locs: DataFrame, radius: float, max_gap: int = 0, descriptor: str = "1", analysed_empty: bool = True) -> DataFrame:
    """locs (dataset_id, frame, loc_id, x, y, sum if there) with category and track_id of each localization.

    In each frame a localization and a track that are each other's nearest within radius
    join; other localizations start tracks. A track ends after more than max_gap frames
    without one. The centre is weighted by 1 + sqrt(sum). The descriptor gives the
    category of each frame plus 1; frames with 0 neither age nor feed tracks. Frames
    without rows count as analysed, unless analysed_empty is False. Radius 0 sets
    categories only and leaves track_id at -1. Tracks are numbered in each dataset from
    0 on in the order of their first frames; loc_ids tell the rows of a frame apart.
    """
    kept = locs.drop("category", "track_id")
    kinds = F.array(*[F.lit(int(c)) for c in descriptor])
    kind = kinds[F.pmod(F.col("frame"), F.lit(len(descriptor))).cast("int")]
    marked = kept.withColumn("category", (kind - 1).cast("int"))
    if radius <= 0:
        return marked.withColumn("track_id", F.lit(-1).cast("long"))
    weight = 1 + F.sqrt(F.col("sum").cast("double")) if "sum" in kept.columns else F.lit(1.0)
    names = [f.name for f in marked.schema.fields]
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in marked.schema.fields], "track_id long"])

    def whole(rows: DataFrame) -> DataFrame:
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            at = np.flatnonzero(pdf["category"].to_numpy() >= 0)
            part = pdf.iloc[at]
            points = pd.DataFrame({"row": at, "t": part["__t"].to_numpy(), "loc_id": part["loc_id"].to_numpy(), "x": part["x"].to_numpy(float), "y": part["y"].to_numpy(float), "w": part["__w"].to_numpy(float)})
            if not analysed_empty:
                points["t"] = np.unique(part["frame"].to_numpy(), return_inverse=True)[1]
            found, ids = _bucket_tracks(points, radius, max_gap), np.full(len(pdf), -1, np.int64)
            ids[found["row"].to_numpy()] = found["local_id"].to_numpy()
            return pdf[names].assign(track_id=ids)

        return rows.withColumns({"__t": _counted(F.col("frame"), descriptor), "__w": weight.cast("double")}).groupBy("dataset_id").applyInPandas(run, schema)

    return _by_size(marked, whole, lambda rows: _cut_tracks(rows, weight, radius, max_gap, descriptor, analysed_empty))


def _cut_tracks(marked: DataFrame, weight: Column, radius: float, max_gap: int, descriptor: str, analysed_empty: bool) -> DataFrame:
    """marked with track_id, movies being tracked by components."""
    points = marked.where("category >= 0").select("dataset_id", "frame", "loc_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), weight.cast("double").alias("w"))
    if analysed_empty:
        points = points.withColumn("t", _counted(F.col("frame"), descriptor))
    else:
        # frames that are there, a row for each frame of a movie
        there = points.select("dataset_id", "frame").distinct().withColumn("t", F.row_number().over(Window.partitionBy("dataset_id").orderBy("frame")).cast("long"))
        points = points.join(there, ["dataset_id", "frame"])
    dealt = _components(points, 2 * radius, max_gap + 1)
    ids = {k: marked.schema[k].dataType.simpleString() for k in ("dataset_id", "frame", "loc_id")}
    schema = ", ".join([*[f"{k} {v}" for k, v in ids.items()], "bucket int, local_id long, phase int"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _bucket_tracks(pdf, radius, max_gap)[[*ids, "bucket", "local_id", "phase"]]

    tracked = checkpointed(dealt.groupBy("dataset_id", "bucket").applyInPandas(run, schema))
    # the number of a track: those that start in earlier frames, and in its own before it
    starts = tracked.where("phase >= 0")
    before = starts.groupBy("dataset_id", "frame").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("dataset_id").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("dataset_id", "frame", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    here = Window.partitionBy("dataset_id", "frame").orderBy("phase", "loc_id")
    named = starts.withColumn("place", F.row_number().over(here) - 1).join(before, ["dataset_id", "frame"])
    named = named.select("dataset_id", "bucket", "local_id", (F.col("before") + F.col("place")).cast("long").alias("track_id"))
    found = tracked.join(named, ["dataset_id", "bucket", "local_id"]).select(*ids, "track_id")
    return marked.join(found, list(ids), "left").select(*marked.columns, F.coalesce("track_id", F.lit(-1).cast("long")).alias("track_id"))


def _bucket_fiducials(pdf: pd.DataFrame, radius: float, max_gap: int) -> pd.DataFrame:
    """Rows of one bucket in order with fiducial_id; seeds are the rows with t = -1 and have their id in `seed`."""
    pdf = pdf.sort_values(["t", "loc_id"], kind="stable").reset_index(drop=True)
    t, x, y = pdf["t"].to_numpy(), pdf["x"].to_numpy(float), pdf["y"].to_numpy(float)
    n = int((t == -1).sum())
    by = np.argsort(pdf["seed"].to_numpy()[:n], kind="stable")
    ids, fx, fy, age = pdf["seed"].to_numpy()[:n][by].astype(np.int64), x[:n][by], y[:n][by], np.zeros(n, np.int64)
    out, last = np.full(len(pdf), -1, np.int32), -1
    starts = n + np.flatnonzero(np.r_[True, t[n + 1 :] != t[n:-1]]) if len(t) > n else np.zeros(0, np.int64)
    for a, b in pairwise([*starts.tolist(), len(t)]):
        age = age + (int(t[a]) - last - 1)
        alive = age <= max_gap
        fx, fy, ids, age = fx[alive], fy[alive], ids[alive], age[alive] + 1
        out[a:b] = follow(fx, fy, age, ids, x[a:b], y[a:b], radius)
        alive, last = age <= max_gap, int(t[a])
        fx, fy, ids, age = fx[alive], fy[alive], ids[alive], age[alive]
        if not len(ids):
            break
    return pdf.assign(fiducial_id=out)


def fiducials(locs: DataFrame, radius: float, max_gap: int, reference_frame: int = 0) -> DataFrame:
    """locs (dataset_id, frame, loc_id, x, y) with fiducial_id: the reference each localization follows, else -1.

    Each live fiducial takes the nearest localization within radius and moves there; of
    two that take the same one the higher id is written. A fiducial is lost after more
    than max_gap frames without a localization. Fiducials are followed from the first
    frame of a dataset on. They are numbered by their loc_ids in the reference frame.
    """
    kept = locs.drop("fiducial_id")
    names = [f.name for f in kept.schema.fields]
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields], "fiducial_id int"])

    def whole(rows: DataFrame) -> DataFrame:
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            points = pd.DataFrame({"row": np.arange(len(pdf)), "t": pdf["frame"].to_numpy() - pdf["frame"].min(), "loc_id": pdf["loc_id"].to_numpy(), "x": pdf["x"].to_numpy(float), "y": pdf["y"].to_numpy(float), "seed": np.nan})
            seeds = points[pdf["frame"].to_numpy() == reference_frame].sort_values("loc_id", kind="stable")
            seeds = seeds.assign(t=-1, row=-1, seed=np.arange(len(seeds), dtype=float))
            found = _bucket_fiducials(pd.concat([points, seeds]), radius, max_gap)
            found, ids = found[found["row"] >= 0], np.full(len(pdf), -1, np.int32)
            ids[found["row"].to_numpy()] = found["fiducial_id"].to_numpy()
            return pdf[names].assign(fiducial_id=ids)

        return rows.groupBy("dataset_id").applyInPandas(run, schema)

    return _by_size(kept, whole, lambda rows: _cut_fiducials(rows, radius, max_gap, reference_frame))


def _cut_fiducials(kept: DataFrame, radius: float, max_gap: int, reference_frame: int) -> DataFrame:
    """kept with fiducial_id, movies being followed by components."""
    spans = kept.groupBy("dataset_id").agg(F.min("frame").alias("first"))
    points = kept.join(spans, "dataset_id").select("dataset_id", (F.col("frame") - F.col("first")).cast("long").alias("t"), "frame", "loc_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.lit(None).cast("int").alias("seed"))
    # the localizations of the reference frame stand once more before the first frame
    order = Window.partitionBy("dataset_id").orderBy("loc_id")
    seeds = points.where(F.col("frame") == reference_frame).withColumns({"t": F.lit(-1).cast("long"), "seed": (F.row_number().over(order) - 1).cast("int")})
    dealt = checkpointed(_components(points.unionByName(seeds), radius, max_gap + 1))
    # buckets without a seed have no fiducial
    used = dealt.join(dealt.where("t = -1").select("dataset_id", "bucket").distinct(), ["dataset_id", "bucket"], "left_semi")
    ids = {k: kept.schema[k].dataType.simpleString() for k in ("dataset_id", "frame", "loc_id")}
    schema = ", ".join([*[f"{k} {v}" for k, v in ids.items()], "fiducial_id int"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = _bucket_fiducials(pdf, radius, max_gap)
        return found[(found["t"] >= 0) & (found["fiducial_id"] >= 0)][[*ids, "fiducial_id"]]

    found = used.groupBy("dataset_id", "bucket").applyInPandas(run, schema)
    return kept.join(found, list(ids), "left").select(*kept.columns, F.coalesce("fiducial_id", F.lit(-1)).alias("fiducial_id"))


def average_fiducials(locs: DataFrame, length: int, fields: list[str], min_fraction: float) -> DataFrame:
    """(frame, fields): mean over the fiducials that are in at least int(min_fraction * length) frames, missing frames filled linearly."""
    from glintloom.operators.windows import filled

    marked = locs.where("fiducial_id >= 0")
    enough = marked.groupBy("fiducial_id").agg(F.count_distinct("frame").alias("n")).where(F.col("n") >= int(min_fraction * length)).select("fiducial_id")
    rows = marked.join(enough, "fiducial_id", "left_semi")
    out = None
    for f in fields:
        mean = filled(rows.select("fiducial_id", "frame", f), length, f, "fiducial_id").groupBy("frame").agg(F.avg(f).alias(f))
        out = mean if out is None else out.join(mean, "frame")
    return out
