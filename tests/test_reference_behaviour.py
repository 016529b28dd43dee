"""Behaviour of the localization operators on hand-made rows, written from the fixture list."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from glintloom.functions import columns as C
import simulate

from glintloom.operators import aggregate, cluster, colour, drift, filters, graph, peaks, scan, setops, spatial, track, windows
from glintloom.sources import molecules, movies, text


def locs(spark, rows):
    """rows of (frame, x) -> localizations with y = 1 and sum = 4."""
    at = {}
    out = []
    for f, x in rows:
        out.append((0, f, at.setdefault(f, 0), float(x), 1.0, 4.0))
        at[f] += 1
    return spark.createDataFrame(out, "dataset_id int, frame int, loc_id long, x double, y double, sum double")


def tracked(df, **settings):
    rows = track.tracker(df, **settings).orderBy("frame", "loc_id").collect()
    lengths = {}
    for r in rows:
        lengths.setdefault(r.track_id, []).append(r)
    return rows, lengths


def test_tracks_grow(spark):
    rows, tracks = tracked(locs(spark, [(f, x) for f in range(3) for x in [1, 2, 3][f:]]), radius=0.1)
    assert [r.track_id for r in rows] == [0, 1, 2, 1, 2, 2]
    assert sorted(len(t) for t in tracks.values()) == [1, 2, 3]


def test_descriptor_and_activation_frames(spark):
    rows, _ = tracked(locs(spark, [(f, x) for f in range(4) for x in [1, 2, 3][: f]]), radius=0.1, descriptor="1212")
    assert {(r.frame, r.category) for r in rows} == {(1, 1), (2, 0), (3, 1)}
    rows, tracks = tracked(locs(spark, [(f, x) for f in (0, 2) for x in (1, 2, 3)]), radius=0.1, descriptor="101")
    assert sorted(len(t) for t in tracks.values()) == [2, 2, 2]
    rows, _ = tracked(locs(spark, [(0, 1), (1, 1)]), radius=0.1, descriptor="10")
    assert [(r.category, r.track_id) for r in rows] == [(0, 0), (-1, -1)]


def test_nearest_localization_and_nearest_track_win(spark):
    rows, _ = tracked(locs(spark, [(0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (1, 2.1), (1, 3)]), radius=0.5)
    assert [r.track_id for r in rows] == [0, 1, 2, 0, 1, 3, 2]
    rows, _ = tracked(locs(spark, [(0, 1), (0, 2), (0, 3), (1, 2)]), radius=1.1)
    assert rows[-1].track_id == 1


@pytest.mark.parametrize(("gap", "n"), [(0, 6), (1, 3)])
def test_gaps(spark, gap, n):
    _, tracks = tracked(locs(spark, [(f, x) for f in (0, 2) for x in (1, 2, 3)]), radius=0.1, max_gap=gap)
    assert len(tracks) == n


def test_radius_zero_only_sets_categories(spark):
    rows, _ = tracked(locs(spark, [(0, 1), (1, 1)]), radius=0.0, descriptor="12")
    assert [(r.category, r.track_id) for r in rows] == [(0, -1), (1, -1)]


def test_tracker_does_not_depend_on_row_order(spark):
    rng = np.random.default_rng(0)
    df = locs(spark, [(int(f), float(x)) for f in range(30) for x in rng.uniform(0, 40, 12)])
    a = track.tracker(df, radius=0.7, max_gap=2).orderBy("frame", "loc_id").collect()
    b = track.tracker(df.orderBy(F.rand(1)).repartition(5), radius=0.7, max_gap=2).orderBy("frame", "loc_id").collect()
    assert a == b


def test_fiducials(spark):
    df = track.fiducials(locs(spark, [(f, x) for f in range(3) for x in (1, 2, 3)]), radius=0.1, max_gap=0)
    assert [r.fiducial_id for r in df.orderBy("frame", "loc_id").collect()] == [0, 1, 2] * 3
    lost = track.fiducials(locs(spark, [(0, 1), (0, 2), (1, 2), (3, 1), (3, 2)]), radius=0.1, max_gap=1)
    assert [r.fiducial_id for r in lost.orderBy("frame", "loc_id").collect()] == [0, 1, 1, -1, 1]
    mean = track.average_fiducials(df, 3, ["x"], 0.5).orderBy("frame").collect()
    assert [r.x for r in mean] == [2.0, 2.0, 2.0]


def test_track_aggregate_weights(spark):
    df = spark.createDataFrame([(0, 5, 1.0, 1.0, 4.0, 1), (0, 6, 4.0, 1.0, 9.0, 2)], "track_id long, frame int, x double, y double, sum double, category int")
    r = aggregate.track_aggregate(df, ["sum"]).first()
    assert math.isclose(r.x, (3 * 1 + 4 * 4) / 7) and (r.frame_number, r.category, r.track_length, r.sum) == (5, 1, 2, 13.0)


# storage views


def test_ranges_channels_and_drift(spark):
    df = spark.createDataFrame([(f, i, float(i)) for f in range(10) for i in range(10)], "frame int, loc_id long, x double")
    assert scan.frame_range(df, 0, 5).count() == 50
    with pytest.raises(ValueError):
        scan.frame_range(df, 5, 5)
    one = spark.createDataFrame([(1, 0.0, 1.0)], "frame int, x double, y double")
    moved = scan.drift_corrected(one, spark.createDataFrame([(1, 1.0, -1.0, 0.0)], "frame int, dx double, dy double, dz double")).first()
    assert (moved.x, moved.y) == (1.0, 0.0)
    wide = spark.createDataFrame([(1, 0.0, 1.0, 2.0)], "frame int, x double, c1_x double, c2_x double")
    long = scan.split_channels(wide, 3, ["x"], ["frame"])
    assert [r.x for r in long.orderBy("channel").collect()] == [0.0, 1.0, 2.0]
    assert scan.join_channels(long, 3, ["x"], ["frame"]).first().asDict() == wide.first().asDict()
    assert scan.resume_point(df) == 10 and scan.resume_point(df.limit(0)) == 0
    assert [r.n_locs for r in scan.frame_sizes(df.where("frame <> 1"), 3).orderBy("frame").collect()] == [10, 0, 10]


def test_grids_and_rendering(spark):
    df = spark.createDataFrame([(10.0, 10.0, -0.2), (20.0, 10.0, 0.0), (30.0, 10.0, 0.2), (30.0, 10.0, 9.0), (-0.5, 3.0, 0.0)], "x double, y double, z double")
    assert aggregate.grid_2d(df, 40, 40).count() == 3
    assert {(r.ix, r.iz) for r in aggregate.grid_3d(df, 40, 40, -0.3, 0.3, 3).collect()} == {(10, 0), (20, 1), (30, 2)}
    assert aggregate.grid_3d(df, 40, 40, -0.3, 0.3, 3, clamp=True).agg(F.sum("count")).first()[0] == 4
    image = aggregate.render(spark.createDataFrame([(10.0, 20.0), (10.5, 20.0), (11.5, 20.0)], "x double, y double"), 40, 30)
    assert {(r.px, r["count"]) for r in image.collect()} == {(10, 2), (12, 1)}
    spot = aggregate.splat(spark.createDataFrame([(4.0, 4.0)], "x double, y double"), 9, 9, 1.0)
    assert abs(spot.agg(F.sum("value")).first()[0] - 2 * math.pi) < 0.05


def test_dbscan_on_seeded_clusters(spark):
    points = simulate.in_clusters(spark, 6, 60, 400, 400, 0.1, seed=1).select(F.col("emitter").alias("id"), "cluster", "x", "y", "z").withColumn("category", F.lit(1))
    out = cluster.dbscan(points, 2.0, 10, "id")
    pairs = out.groupBy("cluster", "label").count().collect()
    assert len(pairs) == 6 and {r["count"] for r in pairs} == {60} and {r.label for r in pairs} == set(range(2, 8))
    stats = aggregate.cluster_stats(out, "label", 1.0).collect()
    assert all(r.n == 60 and 0.05 < r.rg / math.sqrt(2) < 12 for r in stats)
    assert {r.cluster_id for r in cluster.renumbered(out).select("cluster_id").distinct().collect()} == set(range(1, 7))


def brute_dbscan(xy, eps, least):
    near = [[j for j in range(len(xy)) if ((xy[i] - xy[j]) ** 2).sum() <= eps * eps] for i in range(len(xy))]
    label, n = [0] * len(xy), 1
    for i in range(len(xy)):
        if label[i] or len(near[i]) < least:
            continue
        n += 1
        todo = [i]
        while todo:
            k = todo.pop()
            if label[k]:
                continue
            label[k] = n
            if len(near[k]) >= least:
                todo += near[k]
    return [v or -1 for v in label]


def test_dbscan_matches_brute_force(spark):
    xy = np.random.default_rng(3).uniform(0, 8, (90, 2))
    df = spark.createDataFrame([(i, 0, float(a), float(b), 0.0) for i, (a, b) in enumerate(xy)], "id long, category int, x double, y double, z double")
    got = [r.label for r in cluster.dbscan(df, 0.8, 4, "id").orderBy("id").collect()]
    assert got == brute_dbscan(xy, 0.8, 4)


def test_neighbour_clusters(spark):
    density = spark.createDataFrame([(i, 10.0 if i < 6 else 1.0) for i in range(20)], "node long, density double")
    edges = spark.createDataFrame([(i, i + 1) for i in range(19) if i != 3], "a long, b long")
    got = cluster.neighbour_clusters(density, edges, 2.0, 2).collect()
    assert {(r.node, r.cluster_id) for r in got} == {(0, 1), (1, 1), (2, 1), (3, 1)}


def test_components_on_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in graph.connected_components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_spatial_joins_match_brute_force(spark):
    rng = np.random.default_rng(5)
    a, b = rng.uniform(-5, 5, (60, 2)), rng.uniform(-5, 5, (70, 2))
    make = lambda p: spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "id long, x double, y double")
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
    got = spatial.nearest_within(make(a), make(b), 0.8, "id", "id").orderBy("id").collect()
    want = [int(r.argmin()) if r.min() <= 0.8 else -1 for r in d]
    assert [r.nearest_id for r in got] == want
    mutual = {(r.l_id, r.r_id) for r in spatial.mutual_nearest(make(a), make(b), 0.8, "id", "id").collect()}
    assert mutual == {(i, j) for i, j in enumerate(want) if j >= 0 and int(d[:, j].argmin()) == i}
    own = np.sqrt(((a[:, None] - a[None]) ** 2).sum(-1)) + np.eye(60) * 99
    assert {r.id for r in spatial.isolated(make(a), 0.6, "id").collect()} == {i for i in range(60) if own[i].min() >= 0.6}
    assert spatial.pairs_within(make(a), make(b), 0.0, "id", "id").count() == 0


def test_quads_find_an_affine_copy(spark):
    p = np.random.default_rng(0).uniform(0, 512, (14, 2))
    q = p @ np.array([[0.98, 0.03], [-0.03, 0.98]]) + [5.0, -3.0]
    make = lambda v: spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(v)], "id long, x double, y double")
    one, two = spatial.quads(make(p), "id", 5, 400, 6), spatial.quads(make(q), "id", 5, 400, 6)
    matches = spatial.quad_matches(one, two, 1e-3)
    assert matches.where("a1 = a2 AND b1 = b2 AND c1 = c2 AND d1 = d2").count() >= 0.9 * one.count() > 0
    pairs = make(p).select("id", F.col("x").alias("x1"), F.col("y").alias("y1")).join(make(q).select("id", F.col("x").alias("x2"), F.col("y").alias("y2")), "id")
    fit = spatial.affine_fit(pairs)
    back = np.array([[fit["x"][1], fit["x"][2]], [fit["y"][1], fit["y"][2]]])
    assert np.allclose(q @ back.T + [fit["x"][0], fit["y"][0]], p, atol=1e-6)


def test_quad_hashes_cover_all_categories(spark, tmp_path):
    from itertools import permutations

    from glintloom.plans import catalog

    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(v)) for v in rng.uniform(0, 0.5, 3)], i % 3) for i in range(45)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    at, want = {i: 10 * np.array(e[:2]) for i, e, _ in rows}, set()
    for a, _, label in rows:
        far = sorted((float(((at[a] - at[i]) ** 2).sum()), i) for i, _, k in rows if k == label and i != a)
        near = [i for d2, i in far if 0.01 < d2 <= 16.0][:5]
        for b, c, d in permutations(near, 3):
            (ux, uy), size = at[b] - at[a], float(((at[b] - at[a]) ** 2).sum())
            if all(float(((at[n] - (at[a] + at[b]) / 2) ** 2).sum()) <= size / 4 for n in (c, d)):
                xc, xd = (float((p[0] * ux + p[1] * uy) - (p[1] * ux - p[0] * uy)) / size for p in (at[c] - at[a], at[d] - at[a]))
                if xc <= xd and xc + xd <= 1:
                    want.add((a, b, c, d))
    got = {(r.a, r.b, r.c, r.d) for r in catalog.QUERIES["quad_hashes"](spark, str(tmp_path)).collect()}
    assert got == want and {a % 3 for a, *_ in want} == {0, 1, 2}


def test_z_fit_and_cutoff(spark):
    wx, wy = [300.0, -150.0, 400.0, 0.0, 0.0, 0.0, 0.0], [300.0, 150.0, 400.0, 0.0, 0.0, 0.0, 0.0]
    grid = C.z_grid(wx, wy, -300.0, 300.0, 1.0)
    df = spark.createDataFrame([(float(z),) for z in range(-250, 251, 50)], "z double")
    got = df.select("z", C.best_z(C.defocus_width(F.col("z"), *wx), C.defocus_width(F.col("z"), *wy), grid, 1.5, -300.0).alias("f")).collect()
    assert all(abs(r.z - r.f) <= 1.0 for r in got)
    assert df.limit(1).select(C.best_z(F.lit(5000.0), F.lit(1.0), grid, 1.5, -300.0).alias("f")).first().f == -301.0


def test_error_bound_falls_with_light(spark):
    r = spark.range(1).select(C.mortensen_bound(F.lit(500.0), F.lit(10.0), 100.0, 120.0).alias("a"), C.mortensen_bound(F.lit(5000.0), F.lit(10.0), 100.0, 120.0).alias("b"), C.mortensen_bound(F.lit(500.0), F.lit(10.0), 100.0, 120.0, True).alias("c")).first()
    assert r.a > 3 * r.b and math.isclose(r.c, r.a * math.sqrt(2))


def test_interpolation_and_filling(spark):
    knots = spark.createDataFrame([(2.0, 1.0), (4.0, 3.0), (8.0, 3.0)], "t double, v double")
    assert [round(r.v, 6) for r in windows.interpolated(knots, 10, ["v"]).orderBy("frame").collect()] == [-1.0, 0.0, 1.0, 2.0, 3.0, 3.0, 3.0, 3.0, 3.0, 3.0]
    series = spark.createDataFrame([(7, 1, 1.0), (7, 3, 3.0)], "id int, frame int, v double")
    assert [r.v for r in windows.filled(series, 5, "v", "id").orderBy("frame").collect()] == [0.0, 1.0, 2.0, 3.0, 4.0]


def test_scores(spark):
    truth = spark.createDataFrame([(0, i, float(i), 1.0, 0.0) for i in range(10)], "frame int, id long, x double, y double, z double")
    seen = truth.where("id < 6").withColumn("y", F.lit(1.05))
    assert tuple(aggregate.matched_fraction(truth, seen, 0.1, "id", "id", ["frame"]).first()) == (6, 10)
    assert tuple(aggregate.matched_fraction(seen.limit(0), truth, 0.1, "id", "id", ["frame"]).first()) == (0, 0)
    errors = aggregate.fit_errors(truth, seen, 0.1, "id", "id", ["frame"], 100.0, 200.0)
    assert errors.count() == 6 and math.isclose(aggregate.error_summary(errors).first().rms_dy, 5.0, abs_tol=1e-9)


def test_set_operations(spark):
    a = spark.createDataFrame([(1, 1.0)], "track_id int, x double")
    assert setops.union_tables([a, a.withColumn("z", F.lit(1.0)), a]).count() == 3
    with pytest.raises(ValueError):
        setops.merge_shards(a, spark.createDataFrame([(1, False)], "track_id int, analysis_finished boolean"), "track_id")
    tracks = spark.createDataFrame([(1, 5, 3, 1.0, 2.0, 0.1)], "track_id int, frame_number int, track_length int, x double, y double, z double")
    assert [r.frame for r in setops.expand_tracks(tracks, 100.0).orderBy("frame").collect()] == [5, 6, 7]


def test_filters(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1), (2.0, 2.0, 9), (3.0, 3.0, 1)], "x double, y double, category int").withColumn("frame", F.lit(1))
    assert filters.roi(df, (1.0, 3.0)).count() == 1 and filters.good_only(df).count() == 2
    assert filters.area_mask(df, (1.0, 1.0), 1.5).count() == 2


def test_camera(spark):
    df = spark.createDataFrame([(0, 0, m, 5.0 + 2.0 * (m - 10.0)) for m in (10.0, 20.0, 30.0)], "y int, x int, mean double, variance double").withColumns({"offset": F.lit(10.0), "dark_variance": F.lit(5.0)})
    assert math.isclose(aggregate.gain_slopes(df).first().gain, 2.0)


# drift and resolution


def test_offset_of_shifted_images():
    rng = np.random.default_rng(0)
    at = rng.uniform(15, 65, (120, 2))
    gx, gy = np.meshgrid(np.arange(80), np.arange(80), indexing="ij")
    image = lambda s: sum(np.exp(-((gx - x - s[0]) ** 2 + (gy - y - s[1]) ** 2) / 4) for x, y in at)
    dx, dy, ok = drift.image_offset(image((0, 0)), image((1.3, -2.4)))
    assert ok and abs(dx + 1.3) < 0.05 and abs(dy - 2.4) < 0.05


def test_drift_is_recovered(spark):
    emitters = simulate.uniform(spark, 150, 60, 60, seed=3)
    film = simulate.blinking(emitters, 500, 0.1, 1000.0, 0.1, drift=(1.5, -0.8), seed=4)
    found = drift.estimate_drift(film, 100, 500, 64, 64, 2).orderBy("frame").toPandas()
    frames = np.arange(500)
    assert np.abs(found.dx + 1.5 * (frames - 50) / 500).max() < 0.25 and np.abs(found.dy - 0.8 * (frames - 50) / 500).max() < 0.25
    assert drift.estimate_drift(film.limit(5), 200, 500, 64, 64).agg(F.max(F.abs("dx"))).first()[0] == 0.0


def test_redundant_drift_drops_bad_pairs():
    import pandas as pd

    truth = np.array([0.0, 0.5, 0.9, 1.6, 2.0])
    rows = [(i, j, truth[j] - truth[i], 0.0, True) for i in range(5) for j in range(i + 1, 5)]
    rows[3] = (0, 4, 9.0, 0.0, True)
    out = drift.redundant_drift(pd.DataFrame(rows, columns=["i", "j", "dx", "dy", "success"]), 5)
    assert np.allclose(out.dx, truth, atol=1e-6)


def test_ring_correlation(spark):
    points = simulate.uniform(spark, 400, 60, 60, seed=5).select("x", "y", F.explode(F.array(F.lit(0), F.lit(1))).alias("half")).withColumn("movie", F.lit(0))
    same = drift.fourier_ring(points, "half", 64, 64, 1, 100.0, ["movie"]).collect()
    assert len(same) == 32 and all(r.correlation > 0.999 for r in same)


# peaks, movies and files


def make_movie(spark, spots, frames=2, size=48):
    rng = np.random.default_rng(1)
    gy, gx = np.mgrid[:size, :size]
    rows = []
    for f in range(frames):
        image = 20.0 + sum(h * np.exp(-((gx - x) ** 2 + (gy - y) ** 2) / (2 * 1.2**2)) for x, y, h in spots)
        rows.append(("m.dax", f, size, size, bytearray(rng.poisson(image).astype("<i4").tobytes())))
    return spark.createDataFrame(rows, movies.FRAMES)


@pytest.mark.parametrize("model", ["2dfixed", "2d", "3d"])
def test_peaks_are_found_where_they_are(spark, model):
    spots = [(12.3, 15.6, 400.0), (30.0, 33.4, 300.0), (34.5, 12.2, 500.0)]
    found = peaks.localize(make_movie(spark, spots), sigma=1.2, model=model).toPandas()
    assert len(found) == 6
    for x, y, h in spots:
        near = found[((found.x - x) ** 2 + (found.y - y) ** 2) < 0.05]
        assert len(near) == 2 and (abs(near.height - h) < 0.2 * h).all()


def test_movie_round_trip(spark, tmp_path):
    frames = make_movie(spark, [(20.0, 20.0, 100.0)])
    out = movies.encode_dax(frames).first()
    (tmp_path / "m.dax").write_bytes(out.content)
    (tmp_path / "m.inf").write_text(out.header)
    back = movies.read_frames(spark, str(tmp_path))
    assert back.count() == 2 and [bytes(r.pixels) for r in back.orderBy("frame").collect()] == [bytes(r.pixels) for r in frames.orderBy("frame").collect()]
    assert movies.pixels(back).count() == 2 * 48 * 48
    assert scan.average_frames(movies.pixels(back), 0, 2).count() == 48 * 48


def test_other_movie_formats():
    import struct

    image = np.arange(12, dtype="<u2").reshape(3, 4)
    head = bytearray(4100)
    struct.pack_into("<H", head, 42, 4), struct.pack_into("<H", head, 656, 3), struct.pack_into("<I", head, 1446, 1), struct.pack_into("<H", head, 108, 3)
    assert (next(movies.spe_frames(bytes(head) + image.tobytes())) == image).all()
    cards = "".join(f"{k:<8}= {v:>20}".ljust(80) for k, v in (("SIMPLE", "T"), ("BITPIX", 16), ("NAXIS", 2), ("NAXIS1", 4), ("NAXIS2", 3), ("BZERO", 32768))) + "END".ljust(80)
    data = cards.ljust(2880).encode() + (image.astype(np.int32) - 32768).astype(">i2").tobytes()
    assert (next(movies.fits_frames(data)) == image).all()
    tags = [(256, 3, 1, 4), (257, 3, 1, 3), (258, 3, 1, 16), (259, 3, 1, 1), (273, 4, 1, 8), (279, 4, 1, 24)]
    tiff = b"II*\0" + struct.pack("<I", 32) + image.tobytes() + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + struct.pack("<I", 0)
    assert (next(movies.tiff_frames(tiff)) == image).all()
    assert movies.dax_header("frame dimensions = 256 x 128\nnumber of frames = 10\nbig endian") == (128, 256, 10, ">u2")


def test_molecule_lists(spark, tmp_path):
    rows = spark.createDataFrame([(0, 1.5, 2.5, 0.1, 1.0, 1.2, 50.0, 5.0, 1), (1, 3.5, 4.5, -0.2, 1.1, 0.9, 60.0, 6.0, 9)], "frame int, x double, y double, z double, xsigma double, ysigma double, height double, background double, category int")
    out = molecules.encode_molecules(molecules.to_molecules(rows, 160.0).withColumn("movie", F.lit("a")), "movie").first()
    (tmp_path / "a.bin").write_bytes(bytes(out.content) + b"<settings/>")
    back = molecules.read_molecules(spark, str(tmp_path))
    again = molecules.from_molecules(back, 160.0).orderBy("frame").collect()
    for a, b in zip(rows.orderBy("frame").collect(), again, strict=True):
        assert all(abs(a[c] - b[c]) < 1e-4 for c in ("x", "y", "z", "xsigma", "ysigma", "height"))
    assert molecules.read_molecules(spark, str(tmp_path), good_only=True).count() == 1
    assert molecules.read_metadata(spark, str(tmp_path)).first().metadata == "<settings/>"


def test_text_forms(spark, tmp_path):
    (tmp_path / "p.txt").write_text("1.0 2.0 1000.0 100.0\n2.0 3.0 500.0 50.0\n")
    assert text.read_peaks(spark, str(tmp_path / "p.txt")).count() == 2
    values = {"radius": 0.5, "max_gap": 3, "model": "2d", "ids": [1, 2]}
    assert text.read_parameters(text.write_parameters(values)) == values
    d = spark.createDataFrame([(0, 1.0, -2.0, 0.0)], "frame int, dx double, dy double, dz double")
    assert text.drift_lines(d).first().value == "1\t-1.000\t2.000\t-0.000"
    row = text.export_rows(d.withColumn("movie", F.lit(1)), ["frame"], ["movie"]).first()
    assert (row["index"], row.dx, row.frame) == (0, "1.000", 0)


def test_colours(spark):
    rng = np.random.default_rng(2)
    rows = [(i % 2, i, float(100 + 5 * rng.normal()), float(20 + rng.normal())) if i % 3 else (i % 2, i, float(20 + rng.normal()), float(100 + 5 * rng.normal())) for i in range(120)]
    df = spark.createDataFrame(rows, "block_id int, track_id long, h0 double, h1 double")
    codes = colour.codebook(df, ["h0", "h1"], 2)
    out = colour.classified(df, codes, ["h0", "h1"]).collect()
    assert sum(r.km_color == 9 for r in out) == 24
    kept = {(r.track_id % 3 == 0, r.km_color) for r in out if r.km_color != 9}
    assert len(kept) == 2


def test_statuses(spark):
    df = spark.createDataFrame([(0, 0.0, 0.0, 9.0, "CONVERGED"), (1, 0.1, 0.0, 1.0, "CONVERGED"), (2, 5.0, 0.0, 9.0, "CONVERGED")], "id long, x double, y double, significance double, status string")
    assert [r.status for r in spatial.low_significance(df, 2.0, 0.5, "id").orderBy("id").collect()] == ["RUNNING", "ERROR", "CONVERGED"]
    image = spark.createDataFrame([(0, 10, 20, 0, 1.3), (0, 10, 20, 1, 1.2), (0, 10, 20, 2, 1.5), (0, 40, 40, 0, 0.5)], "image int, y int, x int, z int, value double")
    assert [(r.z, r.value) for r in spatial.local_maxima(image, 2.0, 1.0, ["image"], 2).collect()] == [(2, 1.5)]


# streaming


def test_stream_equals_batch(spark, tmp_path):
    from glintloom.streaming import tracking

    rng = np.random.default_rng(0)
    df = locs(spark, [(int(f), float(x)) for f in range(12) for x in rng.uniform(0, 20, 6)])
    for k in range(3):
        df.where((F.col("frame") >= 4 * k) & (F.col("frame") < 4 * k + 4)).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = tracking.stream_tracker(stream, 0.8, 1).writeStream.outputMode("append").format("memory").queryName("tracked").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.frame, r.loc_id, r.track_id) for r in spark.table("tracked").collect())
    want = sorted((r.frame, r.loc_id, r.track_id) for r in track.tracker(df, radius=0.8, max_gap=1).collect())
    assert got == want
    timed = tracking.with_event_time(stream.withColumn("category", F.lit(0)))
    q = tracking.stream_counts(timed, 4).writeStream.outputMode("complete").format("memory").queryName("counted").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.start, r.n) for r in spark.table("counted").collect()) == [(0, 24), (4, 24), (8, 24)]


def test_whole_path(spark):
    from glintloom.plans.flagship import analyse

    locs, found, tracks = analyse(make_movie(spark, [(12.3, 15.6, 400.0), (30.0, 33.4, 300.0)], frames=3), 3, 48, 48, sigma=1.2)
    assert found.count() == 3
    rows = tracks.collect()
    assert len(rows) == 2 and {r.track_length for r in rows} == {3}


def test_axial_calibration(spark):
    from glintloom.operators import calibrate

    z = F.col("id") / 400.0 - 0.5
    rows = spark.range(400).select(z.alias("stage_z"), (C.defocus_width(z, 3.0, -0.15, 0.4) / 2).alias("xsigma"), (C.defocus_width(z, 2.8, 0.15, 0.4) / 2).alias("ysigma"))
    wx, wy = calibrate.calibrate(rows, terms=0, outliers=5.0)
    assert np.allclose(wx, [3.0, -0.15, 0.4], atol=0.01) and np.allclose([abs(v) for v in wy], [2.8, 0.15, 0.4], atol=0.01)
    tilted = spark.createDataFrame([(float(x), float(y), 0.1 * x, 0.1 * x + 0.5 + 0.01 * x - 0.02 * y) for x in range(6) for y in range(6)], "x double, y double, z double, stage_z double")
    assert np.allclose(calibrate.fit_tilt(tilted), [0.5, 0.01, -0.02], atol=1e-9)
