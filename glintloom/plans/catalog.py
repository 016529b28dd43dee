"""Registered queries over the reference operators, with their SQL twins.

Localizations are read from ``events`` and points from ``embeddings`` (see
``glintloom.sources.views``); pixels are made from ``lineitem`` by part and supplier.
Floats are rounded at the edge of each query, nowhere else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glintloom.functions import columns as C
from glintloom.operators import aggregate, cluster, filters, image, scan, setops, spatial, track, windows
from glintloom.sources.views import LOCS_SQL, PTS_SQL, drift, locs, pts, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PIXELS_SQL = """pixels AS (SELECT CAST(l_linenumber AS INTEGER) AS frame, CAST(l_partkey % 16 AS INTEGER) AS y, CAST(l_suppkey % 16 AS INTEGER) AS x, l_quantity AS adu FROM lineitem)"""
#: Calibration curves of an astigmatic lens, in nm, used by the z queries.
WX = [300.0, -150.0, 400.0, 0.1, 0.05]
WY = [300.0, 150.0, 400.0, -0.1, 0.05]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def r(column: str, digits: int = 6):
    return F.round(column, digits).alias(column)


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").cast("int").alias("frame"), (F.col("l_partkey") % 16).cast("int").alias("y"), (F.col("l_suppkey") % 16).cast("int").alias("x"), F.col("l_quantity").alias("adu")
    )


# scans


@query("scan_range", f"WITH {LOCS_SQL} SELECT frame, loc_id, x, category FROM locs WHERE frame >= 100 AND frame < 200")
def _(spark, sf):
    return scan.frame_range(locs(spark, sf), 100, 200, ["frame", "loc_id", "x", "category"])


@query("drift_scan", f"WITH {LOCS_SQL} SELECT frame, loc_id, round(x + 0.001 * frame, 6) AS x, round(y - 0.002 * frame, 6) AS y FROM locs")
def _(spark, sf):
    attributes = spark.range(800).select(F.col("id").cast("int").alias("frame")).select("frame", *[c.alias(k) for k, c in drift().items()])
    return scan.drift_corrected(locs(spark, sf).select("frame", "loc_id", "x", "y"), attributes).select("frame", "loc_id", r("x"), r("y"))


@query("frame_sizes", f"WITH {LOCS_SQL} SELECT CAST(f AS INTEGER) AS frame, count(loc_id) AS n_locs FROM range(800) t(f) LEFT JOIN locs ON frame = f GROUP BY f")
def _(spark, sf):
    return scan.frame_sizes(locs(spark, sf), 800)


@query("calibrated_emccd", f"WITH {PIXELS_SQL} SELECT frame, y, x, adu, round(greatest((adu - 10) * 0.5, 1), 6) AS photons FROM pixels")
def _(spark, sf):
    return scan.calibrated(pixels(spark, sf), 0.5, 10.0).select("frame", "y", "x", "adu", r("photons"))


@query("calibrated_scmos", f"WITH {PIXELS_SQL} SELECT frame, y, x, adu, round(greatest((adu - (5 + y % 3)) * ((1 + 0.1 * (x % 4)) * 0.9), 1), 6) AS photons FROM pixels")
def _(spark, sf):
    sensor = spark.range(256).select((F.col("id") % 16).cast("int").alias("y"), F.floor(F.col("id") / 16).cast("int").alias("x"))
    sensor = sensor.select("y", "x", (5 + F.col("y") % 3).cast("double").alias("offset"), (1 + 0.1 * (F.col("x") % 4)).alias("gain"), F.lit(0.9).alias("rqe"))
    return scan.calibrated_scmos(pixels(spark, sf), sensor).select("frame", "y", "x", "adu", r("photons"))


@query("frame_average", f"WITH {PIXELS_SQL} SELECT y, x, round(avg(adu), 6) AS mean FROM pixels WHERE frame >= 1 AND frame < 5 GROUP BY y, x")
def _(spark, sf):
    return scan.average_frames(pixels(spark, sf), 1, 5).select("y", "x", r("mean"))


@query("aligned_planes", f"WITH {LOCS_SQL} SELECT a.frame, a.loc_id, a.x, b.x AS c1_x FROM locs a JOIN locs b ON b.frame = a.frame + 1 AND a.loc_id = b.loc_id")
def _(spark, sf):
    rows = locs(spark, sf).select("frame", "loc_id", "x")
    return scan.aligned_planes(rows, rows, 1, ["loc_id"])


@query("channel_unpivot", f"WITH {LOCS_SQL} SELECT frame, loc_id, 0 AS channel, x FROM locs UNION ALL SELECT frame, loc_id, 1, x + 1 FROM locs UNION ALL SELECT frame, loc_id, 2, x + 2 FROM locs")
def _(spark, sf):
    wide = locs(spark, sf).select("frame", "loc_id", "x", (F.col("x") + 1).alias("c1_x"), (F.col("x") + 2).alias("c2_x"))
    return scan.split_channels(wide, 3, ["x"], ["frame", "loc_id"])


@query("channel_pivot", f"WITH {LOCS_SQL} SELECT frame, max(CASE WHEN category = 0 THEN x END) AS x, max(CASE WHEN category = 1 THEN x END) AS c1_x, max(CASE WHEN category = 2 THEN x END) AS c2_x FROM locs GROUP BY frame")
def _(spark, sf):
    return scan.join_channels(locs(spark, sf).withColumnRenamed("category", "channel"), 3, ["x"], ["frame"])


@query("cluster_scan", f"WITH {PTS_SQL} SELECT vec_id, category FROM pts WHERE category > 0 AND category IN (SELECT category FROM pts GROUP BY category HAVING count(*) >= 50)")
def _(spark, sf):
    return scan.clusters_of_size(pts(spark, sf), 50, "category").select("vec_id", "category")


@query("cluster_fetch", f"WITH {LOCS_SQL} SELECT frame, loc_id, CAST((frame + loc_id) % 7 AS INTEGER) AS cluster_id, x, k FROM locs")
def _(spark, sf):
    rows = locs(spark, sf)
    members = rows.select("frame", "loc_id", ((F.col("frame") + F.col("loc_id")) % 7).cast("int").alias("cluster_id"))
    return scan.fetch_members(members, rows, ["frame", "loc_id"], ["x", "k"])


# projections


@query("to_nm", f"WITH {PTS_SQL} SELECT vec_id, round(x * 160, 6) AS x, round(y * 160, 6) AS y, round(z * 1000, 6) AS z FROM pts")
def _(spark, sf):
    return pts(spark, sf).select("vec_id", F.round(C.to_nm(F.col("x"), 160.0), 6).alias("x"), F.round(C.to_nm(F.col("y"), 160.0), 6).alias("y"), F.round(F.col("z") * 1000, 6).alias("z"))


@query("descriptor_category", f"WITH {LOCS_SQL} SELECT frame, loc_id, CAST(substr('01123', frame % 5 + 1, 1) AS INTEGER) - 1 AS category FROM locs")
def _(spark, sf):
    return locs(spark, sf).select("frame", "loc_id", C.descriptor_category(F.col("frame"), "01123").alias("category"))


@query("z_check", f"WITH {PTS_SQL} SELECT vec_id, CASE WHEN z < -0.1 OR z > 0.1 THEN 9 ELSE category END AS category FROM pts")
def _(spark, sf):
    return pts(spark, sf).select("vec_id", C.z_checked(F.col("category"), F.col("z"), -0.1, 0.1).alias("category"))


@query("affine_map", f"WITH {PTS_SQL} SELECT vec_id, round(2 + 0.9 * x + 0.1 * y, 6) AS x, round(-1 - 0.1 * x + 0.9 * y, 6) AS y FROM pts")
def _(spark, sf):
    x, y = F.col("x"), F.col("y")
    return pts(spark, sf).select("vec_id", F.round(C.affine(x, y, (2.0, 0.9, 0.1)), 6).alias("x"), F.round(C.affine(x, y, (-1.0, -0.1, 0.9)), 6).alias("y"))


def _width_sql(z: str, p: list[float]) -> str:
    u = f"(({z} - {p[1]}) / {p[2]})"
    return f"({p[0]} * sqrt(1 + {u} * {u} + {p[3]} * pow({u}, 3) + {p[4]} * pow({u}, 4)))"


_Z_SQL = f"""WITH w AS (SELECT p_partkey, 200.0 + 10 * p_size AS wx, 700.0 - 10 * p_size AS wy FROM part),
 g AS (SELECT -500.0 + 10.0 * i AS z, sqrt({_width_sql("(-500.0 + 10.0 * i)", WX)}) AS gx, sqrt({_width_sql("(-500.0 + 10.0 * i)", WY)}) AS gy FROM range(101) t(i)),
 d AS (SELECT p_partkey, z, round(pow(sqrt(wx) - gx, 2) + pow(sqrt(wy) - gy, 2), 9) AS d FROM w, g)"""


@query("z_fit", f"{_Z_SQL} SELECT p_partkey, CAST(round(CASE WHEN min(d) > 30 THEN -501.0 ELSE arg_min(z, (d, z)) END, 6) AS DOUBLE) AS z FROM d GROUP BY p_partkey")
def _(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", (200.0 + 10 * F.col("p_size")).alias("wx"), (700.0 - 10 * F.col("p_size")).alias("wy"))
    grid = C.z_grid(WX, WY, -500.0, 500.0, 10.0)
    return part.select("p_partkey", F.round(C.best_z(F.col("wx"), F.col("wy"), grid, 30.0, -500.0), 6).alias("z"))


@query("curve_distance", f"{_Z_SQL} SELECT p_partkey, round(min(d), 6) AS d2 FROM d GROUP BY p_partkey")
def _(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", (200.0 + 10 * F.col("p_size")).alias("wx"), (700.0 - 10 * F.col("p_size")).alias("wy"))
    return part.select("p_partkey", F.round(C.curve_distance(F.col("wx"), F.col("wy"), C.z_grid(WX, WY, -500.0, 500.0, 10.0)), 6).alias("d2"))


@query("tilt_compensation", f"WITH {PTS_SQL} SELECT vec_id, round(z + 0.1 + 0.01 * x - 0.02 * y, 6) AS z FROM pts")
def _(spark, sf):
    return pts(spark, sf).select("vec_id", F.round(C.tilt_compensated(F.col("x"), F.col("y"), F.col("z"), (0.1, 0.01, -0.02)), 6).alias("z"))


@query("colour_moment", "SELECT l_orderkey, l_linenumber, round((l_extendedprice + 2 * l_discount) / (l_quantity + l_extendedprice + l_discount), 6) AS height_moment, round(l_quantity + l_extendedprice + l_discount, 4) AS height_total FROM lineitem")
def _(spark, sf):
    moment, total = C.colour_moment(F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_discount"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(moment, 6).alias("height_moment"), F.round(total, 4).alias("height_total"))


@query("insight3_shape", "SELECT p_partkey, round(sqrt((2 * p_size * 160.0) * (2 * (p_size + 5) * 160.0)), 6) AS w, round((2 * (p_size + 5) * 160.0) / (2 * p_size * 160.0), 6) AS ax FROM part")
def _(spark, sf):
    w, ax = C.insight3_shape(F.col("p_size").cast("double"), (F.col("p_size") + 5).cast("double"), 160.0)
    return table(spark, sf, "part").select("p_partkey", F.round(w, 6).alias("w"), F.round(ax, 6).alias("ax"))


@query("anscombe", f"WITH {PIXELS_SQL} SELECT frame, y, x, round(2 * sqrt(greatest(adu, 0) + 0.375), 6) AS a FROM pixels")
def _(spark, sf):
    return pixels(spark, sf).select("frame", "y", "x", F.round(C.anscombe(F.col("adu")), 6).alias("a"))


@query("csv_index", f"WITH {LOCS_SQL} SELECT frame, row_number() OVER (PARTITION BY frame ORDER BY loc_id) - 1 AS index, printf('%.3f', x) AS x FROM locs")
def _(spark, sf):
    return aggregate.running_index(locs(spark, sf), ["loc_id"], ["frame"]).select("frame", "index", F.format_string("%.3f", "x").alias("x"))


# filters


@query("roi_filter", f"WITH {LOCS_SQL} SELECT frame, loc_id FROM locs WHERE x > 10 AND x < 100 AND y > 5 AND frame > 50 AND frame < 400")
def _(spark, sf):
    return filters.roi(locs(spark, sf), (10, 100), (5, None), (50, 400)).select("frame", "loc_id")


@query("good_only", f"WITH {PTS_SQL} SELECT vec_id FROM pts WHERE category <> 9")
def _(spark, sf):
    return filters.good_only(pts(spark, sf)).select("vec_id")


@query("edge_exclusion", f"WITH {LOCS_SQL} SELECT frame, loc_id FROM locs WHERE x >= 5 AND y >= 5 AND x + 5 < 400 AND y + 5 < 140 AND x + 3 >= 5 AND 0.9 * y >= 5 AND x + 3 + 5 < 400 AND 0.9 * y + 5 < 140")
def _(spark, sf):
    maps = [((0.0, 1.0, 0.0), (0.0, 0.0, 1.0)), ((3.0, 1.0, 0.0), (0.0, 0.0, 0.9))]
    return filters.inside_all_channels(locs(spark, sf), maps, 5, 400, 140).select("frame", "loc_id")


@query("outlier_removal", f"WITH {PTS_SQL} SELECT vec_id FROM pts, (SELECT stddev_pop(x) AS sx, stddev_pop(y) AS sy FROM pts) WHERE abs(x) < 1.5 * sx AND abs(y) < 1.5 * sy")
def _(spark, sf):
    return filters.without_outliers(pts(spark, sf), ["x", "y"], 1.5).select("vec_id")


@query("frame_validity", f"WITH {LOCS_SQL} SELECT frame, loc_id, CAST(round(0.01 * frame, 6) AS DOUBLE) AS stage_z FROM locs WHERE frame % 3 <> 0")
def _(spark, sf):
    z = spark.range(800).select(F.col("id").cast("int").alias("frame"), (F.col("id") % 3).alias("valid"), F.round(0.01 * F.col("id"), 6).alias("z"))
    return filters.valid_frames(locs(spark, sf), z).select("frame", "loc_id", "stage_z")


@query("fiducial_occupancy", f"WITH {LOCS_SQL} SELECT frame, loc_id, y FROM locs WHERE y IN (SELECT y FROM locs GROUP BY y HAVING count(DISTINCT frame) >= 60)")
def _(spark, sf):
    return filters.frequent(locs(spark, sf), "y", 60).select("frame", "loc_id", "y")


@query("isolation_antijoin", f"WITH {PTS_SQL} SELECT vec_id FROM pts a WHERE NOT EXISTS (SELECT 1 FROM pts b WHERE b.vec_id <> a.vec_id AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) < 0.04)")
def _(spark, sf):
    return spatial.isolated(pts(spark, sf), 0.2, "vec_id").select("vec_id")


@query("dimmer_semijoin", f"WITH {PTS_SQL} SELECT vec_id FROM pts a WHERE EXISTS (SELECT 1 FROM pts b WHERE b.vec_id <> a.vec_id AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 0.09 AND b.z > a.z)")
def _(spark, sf):
    return spatial.dimmer_neighbours(pts(spark, sf), 0.3, "vec_id", "z").select("vec_id")


@query("percentile_cut", "SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice > quantile_cont(l_extendedprice, 0.8) OVER (PARTITION BY l_linenumber) THEN 9 ELSE l_linenumber END AS category FROM lineitem")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").alias("category"), "l_extendedprice")
    return aggregate.gated(rows, "l_extendedprice", 0.8, ["l_linenumber"]).select("l_orderkey", "l_linenumber", "category")


# joins

_SIDES_SQL = f"{PTS_SQL}, t AS (SELECT * FROM pts WHERE vec_id % 2 = 0), m AS (SELECT * FROM pts WHERE vec_id % 2 = 1)"


def _sides(spark, sf):
    p = pts(spark, sf)
    return p.where("vec_id % 2 = 0"), p.where("vec_id % 2 = 1")


def _nearest_sql(where: str) -> str:
    return f"""WITH {_SIDES_SQL}, c AS (SELECT t.vec_id, t.category, m.vec_id AS mid, pow(t.x - m.x, 2) + pow(t.y - m.y, 2) AS d2 FROM t JOIN m ON t.category = m.category WHERE {where}),
 b AS (SELECT vec_id, mid, d2 FROM c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d2, mid) = 1)"""


@query("nn_bounded", _nearest_sql("pow(t.x - m.x, 2) + pow(t.y - m.y, 2) <= 0.25") + " SELECT t.category, t.vec_id, coalesce(mid, -1) AS nearest_id, round(coalesce(sqrt(d2), -1), 6) AS distance FROM t LEFT JOIN b USING (vec_id)")
def _(spark, sf):
    t, m = _sides(spark, sf)
    return spatial.nearest_within(t, m, 0.5, "vec_id", "vec_id", ["category"]).select("category", "vec_id", "nearest_id", r("distance"))


@query("nn_unbounded", _nearest_sql("true") + " SELECT t.category, t.vec_id, mid AS nearest_id, round(sqrt(d2), 6) AS distance FROM t JOIN b USING (vec_id)")
def _(spark, sf):
    t, m = _sides(spark, sf)
    return spatial.nearest(t, m, "vec_id", "vec_id", ["category"]).select("category", "vec_id", "nearest_id", r("distance"))


@query("mutual_nn", _nearest_sql("pow(t.x - m.x, 2) + pow(t.y - m.y, 2) <= 0.25") + ", e AS (SELECT vec_id, mid FROM c QUALIFY row_number() OVER (PARTITION BY mid ORDER BY d2, vec_id) = 1) SELECT category, vec_id AS l_vec_id, mid AS r_vec_id, round(d2, 6) AS d2 FROM c JOIN b USING (vec_id, mid, d2) JOIN e USING (vec_id, mid)")
def _(spark, sf):
    t, m = _sides(spark, sf)
    return spatial.mutual_nearest(t, m, 0.5, "vec_id", "vec_id", ["category"]).select("category", "l_vec_id", "r_vec_id", r("d2"))


@query("knn", f"WITH {PTS_SQL}, c AS (SELECT a.vec_id AS l_vec_id, b.vec_id AS r_vec_id, pow(a.x - b.x, 2) + pow(a.y - b.y, 2) AS d2 FROM pts a JOIN pts b ON a.vec_id <> b.vec_id WHERE pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 1) SELECT l_vec_id, r_vec_id, round(d2, 6) AS d2, CAST(row_number() OVER (PARTITION BY l_vec_id ORDER BY d2, r_vec_id) AS INTEGER) AS rank FROM c WHERE d2 > 0 QUALIFY row_number() OVER (PARTITION BY l_vec_id ORDER BY d2, r_vec_id) <= 3")
def _(spark, sf):
    return spatial.k_nearest(pts(spark, sf), 3, 1.0, "vec_id").select("l_vec_id", "r_vec_id", r("d2"), "rank")


@query("eps_pairs", f"WITH {PTS_SQL} SELECT a.category, a.vec_id AS l_vec_id, b.vec_id AS r_vec_id FROM pts a JOIN pts b ON a.category = b.category WHERE pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2) <= 0.64")
def _(spark, sf):
    return cluster.eps_pairs(pts(spark, sf), 0.8, "vec_id").select("category", "l_vec_id", "r_vec_id")


@query("control_points", f"WITH {_SIDES_SQL}, mv AS (SELECT vec_id, 0.1 + 1.01 * x AS x, -0.1 + 0.99 * y AS y FROM m), c AS (SELECT mv.vec_id, t.vec_id AS nearest_id, pow(t.x - mv.x, 2) + pow(t.y - mv.y, 2) AS d2 FROM mv, t WHERE pow(t.x - mv.x, 2) + pow(t.y - mv.y, 2) <= 0.09) SELECT vec_id, nearest_id, round(sqrt(d2), 6) AS distance FROM c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d2, nearest_id) = 1")
def _(spark, sf):
    t, m = _sides(spark, sf)
    return spatial.control_points(t, m, (0.1, 1.01, 0.0), (-0.1, 0.0, 0.99), 0.3, "vec_id", "vec_id").select("vec_id", "nearest_id", r("distance"))


@query("running_neighbours", f"WITH {_SIDES_SQL} SELECT vec_id, CASE WHEN category % 2 = 0 AND EXISTS (SELECT 1 FROM m WHERE pow(t.x - m.x, 2) + pow(t.y - m.y, 2) <= 0.01) THEN 'RUNNING' WHEN category % 2 = 0 THEN 'CONVERGED' ELSE 'ERROR' END AS status FROM t")
def _(spark, sf):
    t, m = _sides(spark, sf)
    peaks = t.withColumn("status", F.when(F.col("category") % 2 == 0, "CONVERGED").otherwise("ERROR"))
    return spatial.running_near(peaks, m, 0.1, "vec_id").select("vec_id", "status")


@query("rcc_pairs", "SELECT CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j FROM range(20) a(i) JOIN range(20) b(i) ON a.i < b.i")
def _(spark, sf):
    return windows.shifted_pairs(spark.range(20).select(F.col("id").cast("int").alias("bin")), "bin")


@query("local_maxima", f"WITH {PIXELS_SQL}, v AS (SELECT y, x, CAST(sum(adu) AS DOUBLE) AS value FROM pixels GROUP BY y, x) SELECT y, x, value FROM v a WHERE value > 100 AND NOT EXISTS (SELECT 1 FROM v b WHERE (a.y, a.x) <> (b.y, b.x) AND pow(a.y - b.y, 2) + pow(a.x - b.x, 2) <= 4 AND (b.value, b.y, b.x) > (a.value, a.y, a.x))")
def _(spark, sf):
    image = pixels(spark, sf).groupBy("y", "x").agg(F.sum("adu").alias("value")).withColumns({"z": F.lit(0), "image": F.lit(0)})
    return spatial.local_maxima(image, 2.0, 100.0, ["image"]).select("y", "x", "value")


# grids, renderings and scores


@query("grid2d", f"WITH {LOCS_SQL} SELECT CAST(floor(x * 0.5) AS INTEGER) AS ix, CAST(floor(y * 0.5) AS INTEGER) AS iy, count(*) AS count FROM locs WHERE floor(x * 0.5) < 200 AND floor(y * 0.5) < 75 GROUP BY 1, 2")
def _(spark, sf):
    return aggregate.grid_2d(locs(spark, sf), 200, 75, 0.5)


@query("grid2d_drift", f"WITH {LOCS_SQL} SELECT CAST(substr('123', frame % 3 + 1, 1) AS INTEGER) - 1 AS category, CAST(floor((x + 0.001 * frame) * 0.25) AS INTEGER) AS ix, CAST(floor((y - 0.002 * frame) * 0.25) AS INTEGER) AS iy, count(*) AS count FROM locs WHERE floor((y - 0.002 * frame) * 0.25) >= 0 AND floor((x + 0.001 * frame) * 0.25) < 125 AND floor((y - 0.002 * frame) * 0.25) < 40 GROUP BY 1, 2, 3")
def _(spark, sf):
    attributes = spark.range(800).select(F.col("id").cast("int").alias("frame")).select("frame", *[c.alias(k) for k, c in drift().items()])
    moved = scan.drift_corrected(locs(spark, sf).select("frame", "x", "y"), attributes)
    moved = moved.withColumn("category", C.descriptor_category(F.col("frame"), "123"))
    return aggregate.grid_2d(moved, 125, 40, 0.25, keys=["category"])


_G3 = "CAST(floor((z + 0.3) * (6 / 0.6)) AS INTEGER)"


@query("grid3d", f"WITH {PTS_SQL} SELECT CAST(floor(x) AS INTEGER) AS ix, CAST(floor(y) AS INTEGER) AS iy, {_G3} AS iz, count(*) AS count FROM pts WHERE x >= 0 AND y >= 0 AND x < 10 AND y < 10 AND z > -0.3 AND z < 0.3 GROUP BY 1, 2, 3")
def _(spark, sf):
    return aggregate.grid_3d(pts(spark, sf), 10, 10, -0.3, 0.3, 6)


@query("grid3d_clamped", f"WITH {PTS_SQL} SELECT CAST(floor(x) AS INTEGER) AS ix, CAST(floor(y) AS INTEGER) AS iy, CAST(least(greatest(floor((z + 0.1) * (4 / 0.2)), 0), 3) AS INTEGER) AS iz, count(*) AS count FROM pts WHERE x >= 0 AND y >= 0 AND x < 10 AND y < 10 GROUP BY 1, 2, 3")
def _(spark, sf):
    return aggregate.grid_3d(pts(spark, sf), 10, 10, -0.1, 0.1, 4, clamp=True)


@query("grid_channel_max", f"WITH {LOCS_SQL}, g AS (SELECT category, floor(x) AS ix, floor(y) AS iy, count(*) AS n FROM locs WHERE x < 500 AND y < 200 GROUP BY ALL), p AS (SELECT category, max(n) AS most FROM g GROUP BY category) SELECT category, most, (SELECT max(most) FROM p) AS most_of_all FROM p")
def _(spark, sf):
    return aggregate.channel_maxima(aggregate.grid_2d(locs(spark, sf), 500, 200, keys=["category"]), "category")


@query("render_slabs", f"WITH {PTS_SQL}, s AS (SELECT CASE WHEN z >= -0.2 AND z < 0 THEN 0 WHEN z >= 0 AND z < 0.2 THEN 1 END AS slab, CAST(round_even((x + 5) * 2, 0) AS INTEGER) AS px, CAST(round_even((y + 5) * 2, 0) AS INTEGER) AS py FROM pts) SELECT slab, px, py, count(*) AS count FROM s WHERE slab IS NOT NULL AND px >= 0 AND py >= 0 AND px < 20 AND py < 20 GROUP BY ALL")
def _(spark, sf):
    return aggregate.render(pts(spark, sf), 20, 20, 2.0, (5.0, 5.0), edges=[-0.2, 0.0, 0.2])


@query("render_category", f"WITH {LOCS_SQL} SELECT 0 AS slab, CAST(round_even(x * 0.1, 0) AS INTEGER) AS px, CAST(round_even(y * 0.1, 0) AS INTEGER) AS py, count(*) AS count FROM locs WHERE category = 1 AND round_even(x * 0.1, 0) < 40 AND round_even(y * 0.1, 0) < 16 GROUP BY ALL")
def _(spark, sf):
    return aggregate.render(locs(spark, sf), 40, 16, 0.1, category=1)


@query("splat", f"WITH {PTS_SQL}, w AS (SELECT x, y, CAST(floor(x) AS INTEGER) + dx AS px, CAST(floor(y) AS INTEGER) + dy AS py FROM pts, (SELECT CAST(unnest(range(-2, 3)) AS INTEGER) AS dx), (SELECT CAST(unnest(range(-2, 3)) AS INTEGER) AS dy)) SELECT px, py, round(sum(exp(-(pow(px - x, 2) + pow(py - y, 2)) / 0.5)), 6) AS value FROM w WHERE px >= 0 AND py >= 0 AND px < 8 AND py < 8 GROUP BY px, py")
def _(spark, sf):
    return aggregate.splat(pts(spark, sf), 8, 8, 0.5).select("px", "py", r("value"))


@query("track_aggregate", f"WITH {LOCS_SQL}, t AS (SELECT *, CAST(y AS BIGINT) AS track_id, 1 + sqrt(sum) AS w FROM locs) SELECT track_id, round(sum(w * x) / sum(w), 6) AS x, round(sum(w * y) / sum(w), 6) AS y, CAST(0.0 AS DOUBLE) AS z, min(frame) AS frame_number, arg_min(category, (frame, category)) AS category, CAST(count(*) AS INTEGER) AS track_length, round(sum(sum), 4) AS sum FROM t GROUP BY track_id")
def _(spark, sf):
    rows = locs(spark, sf).withColumn("track_id", F.col("y").cast("long"))
    return aggregate.track_aggregate(rows, ["sum"]).select("track_id", r("x"), r("y"), "z", "frame_number", "category", "track_length", r("sum", 4))


@query("cluster_stats", f"WITH {PTS_SQL}, n AS (SELECT category AS cluster_id, category, x * 160 AS x, y * 160 AS y, z * 1000 AS z FROM pts) SELECT cluster_id, min(category) AS category, count(*) AS n, round(avg(x), 4) AS x_mean, round(avg(y), 4) AS y_mean, round(avg(z), 4) AS z_mean, round(max(x) - min(x), 4) AS x_size, round(max(y) - min(y), 4) AS y_size, round(max(z) - min(z), 4) AS z_size, round(sqrt(var_pop(x) + var_pop(y) + var_pop(z)), 4) AS rg FROM n GROUP BY cluster_id")
def _(spark, sf):
    out = aggregate.cluster_stats(pts(spark, sf).withColumn("cluster_id", F.col("category")), "cluster_id", 160.0)
    return out.select("cluster_id", "category", "n", *[r(c, 4) for c in out.columns[3:]])


@query("cluster_size", f"WITH {PTS_SQL} SELECT vec_id, CASE WHEN category > 1 THEN count(*) OVER (PARTITION BY category) ELSE 0 END AS size FROM pts")
def _(spark, sf):
    return aggregate.cluster_size(pts(spark, sf), "category").select("vec_id", "size")


@query("recategorize", f"WITH {PTS_SQL} SELECT vec_id, CASE WHEN label <= 1 OR count(*) OVER (PARTITION BY label) < 52 THEN 0 ELSE label END AS category FROM (SELECT vec_id, category AS label FROM pts)")
def _(spark, sf):
    rows = pts(spark, sf).withColumn("label", F.col("category"))
    return aggregate.recategorized(rows, "label", 52).select("vec_id", "category")


@query("recall", f"WITH {_SIDES_SQL}, e AS (SELECT a.vec_id, count(b.vec_id) AS n FROM t a LEFT JOIN m b ON a.category = b.category AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 0.25 GROUP BY a.vec_id) SELECT count(*) FILTER (n > 0) AS matched, count(*) AS total FROM e")
def _(spark, sf):
    t, m = _sides(spark, sf)
    return aggregate.matched_fraction(t, m, 0.5, "vec_id", "vec_id", ["category"])


@query("noise", f"WITH {_SIDES_SQL}, e AS (SELECT a.vec_id, count(b.vec_id) AS n FROM m a LEFT JOIN t b ON a.category = b.category AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 0.25 GROUP BY a.vec_id) SELECT count(*) FILTER (n = 0) AS unmatched, count(*) AS total FROM e")
def _(spark, sf):
    t, m = _sides(spark, sf)
    found = aggregate.matched_fraction(m, t, 0.5, "vec_id", "vec_id", ["category"])
    return found.select((F.col("total") - F.col("matched")).alias("unmatched"), "total")


_ERRORS_SQL = f"""WITH {_SIDES_SQL}, c AS (SELECT m.vec_id, t.vec_id AS tid, pow(t.x - m.x, 2) + pow(t.y - m.y, 2) AS d2, (m.x - t.x) * 160 AS dx, (m.y - t.y) * 160 AS dy, (m.z - t.z) * 1000 AS dz FROM t JOIN m ON t.category = m.category WHERE pow(t.x - m.x, 2) + pow(t.y - m.y, 2) <= 0.25),
 b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d2, tid) = 1), e AS (SELECT * FROM b WHERE dx * dx + dy * dy + dz * dz < 90000)"""


@query("fit_error", _ERRORS_SQL + " SELECT tid AS true_vec_id, vec_id, round(dx, 6) AS dx, round(dy, 6) AS dy, round(dz, 6) AS dz FROM e")
def _(spark, sf):
    t, m = _sides(spark, sf)
    return aggregate.fit_errors(t, m, 0.5, "vec_id", "vec_id", ["category"], 160.0, 300.0).select("true_vec_id", "vec_id", r("dx"), r("dy"), r("dz"))


@query("error_summary", _ERRORS_SQL + " SELECT count(*) AS n, " + ", ".join(f"round(stddev_pop({c}), 4) AS std_{c}" for c in ("dx", "dy", "dz")) + ", " + ", ".join(f"round(sqrt(avg({c} * {c})), 4) AS rms_{c}" for c in ("dx", "dy", "dz")) + " FROM e")
def _(spark, sf):
    t, m = _sides(spark, sf)
    out = aggregate.error_summary(aggregate.fit_errors(t, m, 0.5, "vec_id", "vec_id", ["category"], 160.0, 300.0))
    return out.select("n", *[r(c, 4) for c in out.columns[1:]])


@query("field_statistics", f"WITH {LOCS_SQL}, u AS (SELECT 'x' AS field, x AS v FROM locs UNION ALL SELECT 'y', y FROM locs UNION ALL SELECT 'k', CAST(k AS DOUBLE) FROM locs) SELECT field, count(v) AS n, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std, min(v) AS min, max(v) AS max FROM u GROUP BY field")
def _(spark, sf):
    return aggregate.field_statistics(locs(spark, sf), ["x", "y", "k"]).select("field", "n", r("mean", 4), r("std", 4), "min", "max")


@query("histogram", "SELECT CAST(CASE WHEN l_discount = 0.1 THEN 9 ELSE floor(l_discount * (10 / 0.1)) END AS INTEGER) AS bin, count(*) AS count FROM lineitem WHERE l_discount >= 0 AND l_discount <= 0.1 GROUP BY 1")
def _(spark, sf):
    return aggregate.histogram(table(spark, sf, "lineitem"), "l_discount", 0.0, 0.1, 10)


@query("pixel_moments", f"WITH {PIXELS_SQL} SELECT y, x, count(*) AS n, round(avg(adu), 4) AS mean, round(var_pop(adu), 4) AS variance FROM pixels GROUP BY y, x")
def _(spark, sf):
    return aggregate.pixel_moments(pixels(spark, sf)).select("y", "x", "n", r("mean", 4), r("variance", 4))


@query("gain_slope", f"WITH {PIXELS_SQL}, l AS (SELECT y, x, frame, avg(adu) AS mean, var_pop(adu) AS variance FROM pixels GROUP BY ALL) SELECT y, x, round(coalesce(regr_slope(variance - 5, mean - 10), 1), 4) AS gain FROM l GROUP BY y, x")
def _(spark, sf):
    levels = aggregate.pixel_moments(pixels(spark, sf), ["y", "x", "frame"]).withColumns({"dark_variance": F.lit(5.0), "offset": F.lit(10.0)})
    return aggregate.gain_slopes(levels).select("y", "x", r("gain", 4))


@query("relative_efficiency", f"WITH {PIXELS_SQL}, v AS (SELECT y, x, avg(adu) AS m FROM pixels GROUP BY y, x) SELECT a.y, a.x, round(any_value(a.m) / avg(b.m), 6) AS relative FROM v a JOIN v b ON abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 GROUP BY a.y, a.x")
def _(spark, sf):
    means = pixels(spark, sf).groupBy("y", "x").agg(F.avg("adu").alias("m"))
    return aggregate.box_mean(means, 2, "m").select("y", "x", r("relative"))


@query("density_median", f"WITH {PTS_SQL} SELECT vec_id FROM pts, (SELECT median(x) AS m FROM pts) WHERE x > 1.1 * m")
def _(spark, sf):
    return aggregate.above_median(pts(spark, sf), "x", 1.1).select("vec_id")


@query("ring_means", f"WITH {PIXELS_SQL} SELECT CAST(floor(sqrt(pow(x - 7.5, 2) + pow(y - 7.5, 2)) + 0.5) AS INTEGER) AS ring, round(avg(adu), 6) AS mean, count(*) AS n FROM pixels GROUP BY 1")
def _(spark, sf):
    return aggregate.ring_means(pixels(spark, sf), (7.5, 7.5), "adu").select("ring", r("mean"), "n")


_LAG_GRID = "SELECT CAST(floor(x / 4) AS INTEGER) AS ix, CAST(floor(y / 4) AS INTEGER) AS iy, CAST(floor((z + 0.5) * 10) AS INTEGER) AS iz, count(*) AS n FROM {} WHERE z > -0.5 AND z < 0.5 GROUP BY ALL"


@query("z_lags", f"WITH {_SIDES_SQL}, a AS ({_LAG_GRID.format('t')}), b AS ({_LAG_GRID.format('m')}) SELECT b.iz - a.iz AS lag, round(sum(a.n * b.n) / (10 - abs(b.iz - a.iz)), 6) AS score FROM a JOIN b USING (ix, iy) GROUP BY b.iz - a.iz")
def _(spark, sf):
    g = [s.where("z > -0.5 AND z < 0.5").groupBy(F.floor(F.col("x") / 4).alias("ix"), F.floor(F.col("y") / 4).alias("iy"), F.floor((F.col("z") + 0.5) * 10).cast("int").alias("iz")).agg(F.count("*").alias("count")) for s in _sides(spark, sf)]
    return aggregate.lag_correlation(g[0], g[1], 10, ["ix", "iy"]).select("lag", r("score"))


@query("kmeans_assign", f"WITH {PTS_SQL}, d AS (SELECT vec_id, [sqrt(pow(x - 1, 2) + pow(y - 1, 2)), sqrt(pow(x + 1, 2) + pow(y - 1, 2)), sqrt(x * x + pow(y + 1, 2))] AS d FROM pts) SELECT vec_id, CAST(list_position(d, list_min(d)) - 1 AS INTEGER) AS km_color, round(list_min(d), 6) AS km_distance FROM d")
def _(spark, sf):
    return aggregate.nearest_code(pts(spark, sf), [[1.0, 1.0], [-1.0, 1.0], [0.0, -1.0]], ["x", "y"]).select("vec_id", "km_color", r("km_distance"))


# windows


@query("time_bins", f"WITH {LOCS_SQL} SELECT CAST(least(floor(frame / 100), 6) AS INTEGER) AS bin, count(*) AS n FROM locs GROUP BY 1")
def _(spark, sf):
    return locs(spark, sf).groupBy(C.time_bin(F.col("frame"), 100, 720).alias("bin")).agg(F.count("*").alias("n"))


_STEPS_SQL = f"WITH {LOCS_SQL}, s AS (SELECT CAST(floor(frame / 50) AS INTEGER) AS bin, avg(x) / 1000 AS dx, avg(y) / 1000 AS dy FROM locs GROUP BY 1)"


def _steps(spark, sf):
    return locs(spark, sf).groupBy(F.floor(F.col("frame") / 50).cast("int").alias("bin")).agg((F.avg("x") / 1000).alias("dx"), (F.avg("y") / 1000).alias("dy"))


@query("cumulative_drift", _STEPS_SQL + " SELECT bin, round(coalesce(sum(dx) OVER w, 0), 6) AS dx, round(coalesce(sum(dy) OVER w, 0), 6) AS dy FROM s WINDOW w AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def _(spark, sf):
    out = windows.cumulative_drift(_steps(spark, sf).withColumn("movie", F.lit(0)), ["dx", "dy"], "bin", ["movie"])
    return out.select("bin", r("dx"), r("dy"))


@query("interpolated_drift", _STEPS_SQL + ", k AS (SELECT bin * 50 + 25 AS t, dx, lead(bin * 50 + 25) OVER (ORDER BY bin) AS t2, lead(dx) OVER (ORDER BY bin) AS dx2, row_number() OVER (ORDER BY bin) AS i, count(*) OVER () AS n FROM s) SELECT CAST(f AS INTEGER) AS frame, round(dx + (f - t) * (dx2 - dx) / (t2 - t), 6) AS dx FROM range(720) r(f) JOIN k ON t2 IS NOT NULL AND (f >= t OR i = 1) AND (f < t2 OR i = n - 1)")
def _(spark, sf):
    knots = _steps(spark, sf).select((F.col("bin") * 50 + 25).alias("t"), "dx")
    return windows.interpolated(knots, 720, ["dx"]).select("frame", r("dx"))


@query("fill_missing", f"""WITH {LOCS_SQL}, s AS (SELECT CAST(y AS BIGINT) AS id, frame, max(x) AS v FROM locs GROUP BY ALL), g AS (SELECT id, CAST(f AS INTEGER) AS frame FROM (SELECT DISTINCT id FROM s), range(720) r(f)),
 k AS (SELECT id, frame, v, lead(frame) OVER w AS f2, lead(v) OVER w AS v2, row_number() OVER w AS i, count(*) OVER (PARTITION BY id) AS n FROM s WINDOW w AS (PARTITION BY id ORDER BY frame))
 SELECT g.id, g.frame, round(v + (g.frame - k.frame) * (v2 - v) / (f2 - k.frame), 8) AS x FROM g JOIN k ON g.id = k.id AND f2 IS NOT NULL AND (g.frame >= k.frame OR i = 1) AND (g.frame < f2 OR i = n - 1)""")
def _(spark, sf):
    series = locs(spark, sf).groupBy(F.col("y").cast("long").alias("id"), "frame").agg(F.max("x").alias("x"))
    return windows.filled(series, 720, "x", "id").select("id", "frame", r("x", 8))


@query("sliding_background", f"WITH {PIXELS_SQL}, p AS (SELECT frame, y, x, avg(adu) AS adu FROM pixels GROUP BY ALL) SELECT frame, y, x, round(avg(adu) OVER (PARTITION BY y, x ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS background FROM p")
def _(spark, sf):
    image = pixels(spark, sf).groupBy("frame", "y", "x").agg(F.avg("adu").alias("adu"))
    return windows.sliding_background(image, 2, ["y", "x"]).select("frame", "y", "x", r("background"))


@query("track_sessions", f"WITH {LOCS_SQL}, g AS (SELECT frame, loc_id, y, CASE WHEN frame - lag(frame) OVER w > 3 THEN 1 ELSE 0 END AS n FROM locs WINDOW w AS (PARTITION BY y ORDER BY frame, loc_id)) SELECT frame, loc_id, y, CAST(sum(n) OVER (PARTITION BY y ORDER BY frame, loc_id) AS INTEGER) AS session FROM g")
def _(spark, sf):
    return windows.sessions(locs(spark, sf), ["y"], 2).select("frame", "loc_id", "y", "session")


# set operations


@query("merge_union", "SELECT o_orderkey AS id, o_totalprice AS x, CAST(NULL AS DOUBLE) AS y FROM orders UNION ALL SELECT l_orderkey, l_extendedprice, l_quantity FROM lineitem")
def _(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("x"))
    b = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"))
    return setops.union_tables([a, b])


@query("merge_shards", f"WITH {LOCS_SQL} SELECT frame, loc_id, CAST(floor(frame / 100) AS INTEGER) AS shard FROM locs")
def _(spark, sf):
    rows = locs(spark, sf).select("frame", "loc_id", F.floor(F.col("frame") / 100).cast("int").alias("shard"))
    shards = spark.range(8).select(F.col("id").cast("int").alias("shard"), F.lit(True).alias("analysis_finished"))
    return setops.merge_shards(rows, shards, "shard").select("frame", "loc_id", "shard")


@query("shifted_union", f"WITH {_SIDES_SQL} SELECT vec_id, round(x, 6) AS x, round(z, 6) AS z FROM t UNION ALL SELECT vec_id, round(x - 1, 6), round(z + 0.3, 6) FROM m")
def _(spark, sf):
    t, m = _sides(spark, sf)
    return setops.shifted_union(t, m, -1.0, 0.0, 0.3).select("vec_id", r("x"), r("z"))


@query("expand_tracks", "SELECT l_orderkey AS track_id, CAST(l_linenumber + j AS INTEGER) AS frame, round(l_quantity * 160, 6) AS x, round(l_tax * 160, 6) AS y, round(l_discount * 1000, 6) AS z FROM lineitem, unnest(range(0, CAST(l_quantity AS BIGINT) % 4)) t(j)")
def _(spark, sf):
    tracks = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("track_id"), F.col("l_linenumber").cast("int").alias("frame_number"), F.col("l_quantity").alias("x"), F.col("l_tax").alias("y"), F.col("l_discount").alias("z"), (F.col("l_quantity").cast("int") % 4).alias("track_length"))
    return setops.expand_tracks(tracks, 160.0).select("track_id", "frame", r("x"), r("y"), r("z"))


@query("frc_split", f"WITH {LOCS_SQL} SELECT CAST(event_id % 2 AS INTEGER) AS half, CAST(floor(x * 0.1) AS INTEGER) AS ix, CAST(floor(y * 0.1) AS INTEGER) AS iy, count(*) AS count FROM locs WHERE floor(x * 0.1) < 50 AND floor(y * 0.1) < 16 GROUP BY ALL")
def _(spark, sf):
    return aggregate.grid_2d(setops.odd_even(locs(spark, sf).withColumnRenamed("event_id", "track_id")), 50, 16, 0.1, keys=["half"])


# clustering and tracking

_DBSCAN_SQL = f"""WITH RECURSIVE {PTS_SQL}, pr AS (SELECT a.vec_id AS l, b.vec_id AS r FROM pts a JOIN pts b ON a.category = b.category WHERE pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2) <= 0.64),
 core AS (SELECT l AS c FROM pr GROUP BY l HAVING count(*) >= 3), e AS (SELECT l, r FROM pr WHERE l IN (SELECT c FROM core) AND r IN (SELECT c FROM core)),
 reach AS (SELECT c AS a, c AS b FROM core UNION SELECT reach.a, e.r FROM reach JOIN e ON e.l = reach.b), comp AS (SELECT a AS c, min(b) AS root FROM reach GROUP BY a),
 num AS (SELECT c, CAST(dense_rank() OVER (ORDER BY root) + 1 AS INTEGER) AS label FROM comp)"""


@query("dbscan_core", f"WITH {PTS_SQL} SELECT a.vec_id, count(*) AS n FROM pts a JOIN pts b ON a.category = b.category WHERE pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2) <= 0.64 GROUP BY a.vec_id HAVING count(*) >= 3")
def _(spark, sf):
    return cluster.eps_pairs(pts(spark, sf), 0.8, "vec_id").groupBy(F.col("l_vec_id").alias("vec_id")).agg(F.count("*").alias("n")).where("n >= 3")


@query("dbscan", _DBSCAN_SQL + " SELECT vec_id, coalesce(num.label, (SELECT min(n2.label) FROM pr JOIN num n2 ON pr.r = n2.c WHERE pr.l = vec_id), -1) AS label FROM pts LEFT JOIN num ON c = vec_id")
def _(spark, sf):
    return cluster.dbscan(pts(spark, sf), 0.8, 3, "vec_id").select("vec_id", "label")


@query("cluster_renumber", _DBSCAN_SQL + " SELECT vec_id, coalesce(label - 1, 0) AS cluster_id FROM pts LEFT JOIN num ON c = vec_id")
def _(spark, sf):
    labels = cluster.dbscan(pts(spark, sf), 0.8, 3, "vec_id", core="is_core")
    marked = labels.withColumn("label", F.when(F.col("is_core"), F.col("label")).otherwise(-1))
    return cluster.renumbered(marked).select("vec_id", F.col("cluster_id").cast("int").alias("cluster_id"))


@query("tracker")
def _(spark, sf):
    rows = locs(spark, sf).select(F.col("k").alias("dataset_id"), "frame", "loc_id", "x", "y", "sum")
    out = track.tracker(rows, radius=20.0, max_gap=5, descriptor="1")
    return out.select("dataset_id", "frame", "loc_id", "category", "track_id")


@query("fiducials")
def _(spark, sf):
    rows = locs(spark, sf).select(F.col("k").alias("dataset_id"), "frame", "loc_id", "x", "y")
    first = rows.groupBy("dataset_id").agg(F.min("frame").alias("reference"))
    shifted = rows.join(first, "dataset_id").withColumn("frame", F.col("frame") - F.col("reference")).drop("reference")
    return track.fiducials(shifted, radius=50.0, max_gap=200)


# sparse images, measured spots, noise, z bins


@query("binned_image", f"WITH {PIXELS_SQL} SELECT frame, CAST(floor(y / 4) AS INTEGER) AS y, CAST(floor(x / 4) AS INTEGER) AS x, sum(adu) AS adu FROM pixels GROUP BY ALL")
def _(spark, sf):
    return aggregate.binned_sum(pixels(spark, sf), 4, "adu", ["frame"])


@query("sparse_triples", "SELECT CAST(o_orderkey % 10 AS INTEGER) AS frame, CAST(floor(o_custkey / 64) AS INTEGER) AS y, CAST(o_custkey % 64 AS INTEGER) AS x, o_totalprice AS z FROM orders")
def _(spark, sf):
    rows = table(spark, sf, "orders").select((F.col("o_orderkey") % 10).cast("int").alias("fr"), F.col("o_custkey").alias("i"), F.col("o_totalprice").alias("z"))
    return aggregate.from_linear_index(rows, 64)


@query("bead_average", f"WITH {PIXELS_SQL}, im AS (SELECT frame, y, x, avg(adu) AS adu FROM pixels GROUP BY ALL), b AS (SELECT CAST(f AS INTEGER) AS frame, CAST(f % 2 AS INTEGER) AS z_bin, CAST(3 + f AS INTEGER) AS bead_x, 7 AS bead_y FROM range(1, 8) t(f)) SELECT z_bin, y - bead_y AS dy, x - bead_x AS dx, round(avg(adu), 6) AS mean, count(*) AS n FROM b JOIN im ON im.frame = b.frame AND abs(y - bead_y) <= 2 AND abs(x - bead_x) <= 2 GROUP BY ALL")
def _(spark, sf):
    image = pixels(spark, sf).groupBy("frame", "y", "x").agg(F.avg("adu").alias("adu"))
    beads = spark.range(1, 8).select(F.col("id").cast("int").alias("frame"), (F.col("id") % 2).cast("int").alias("z_bin"), (F.col("id") + 3).cast("int").alias("bead_x"), F.lit(7).alias("bead_y"))
    return aggregate.bead_averages(image, beads, 2).select("z_bin", "dy", "dx", r("mean"), "n")


@query("z_bins", f"WITH {PTS_SQL} SELECT vec_id, CASE WHEN z > -0.2 AND z < 0.2 THEN CAST(floor((z + 0.2) / (0.4 / 8)) AS INTEGER) ELSE -1 END AS bin FROM pts")
def _(spark, sf):
    return pts(spark, sf).select("vec_id", C.z_bin(F.col("z"), -0.2, 0.2, 8).alias("bin"))


@query("area_mask", f"WITH {LOCS_SQL} SELECT frame, loc_id FROM locs WHERE pow(x - 100, 2) + pow(y - 75, 2) <= 2500")
def _(spark, sf):
    return filters.area_mask(locs(spark, sf), (100.0, 75.0), 50.0).select("frame", "loc_id")


@query("low_significance", f"WITH {PTS_SQL} SELECT vec_id, CASE WHEN z <= -0.2 THEN 'ERROR' WHEN EXISTS (SELECT 1 FROM pts b WHERE b.vec_id <> a.vec_id AND b.z <= -0.2 AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 0.09) THEN 'RUNNING' ELSE 'CONVERGED' END AS status FROM pts a")
def _(spark, sf):
    peaks = pts(spark, sf).withColumn("status", F.lit("CONVERGED")).withColumnRenamed("z", "significance")
    return spatial.low_significance(peaks, -0.2, 0.3, "vec_id").select("vec_id", "status")


@query("significance", "SELECT l_orderkey, l_linenumber, round(l_extendedprice / sqrt(l_quantity), 6) AS s FROM lineitem")
def _(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(C.significance(F.col("l_extendedprice"), F.col("l_quantity")), 6).alias("s"))


@query("frame_hash", "SELECT CAST(p_partkey % 50 AS INTEGER) AS movie_id, md5(p_name) AS hash FROM part WHERE p_size = 1")
def _(spark, sf):
    frames = table(spark, sf, "part").select((F.col("p_partkey") % 50).cast("int").alias("movie_id"), (F.col("p_size") - 1).alias("frame"), F.col("p_name").cast("binary").alias("pixels"))
    return scan.movie_hash(frames)


@query("average_fiducials", f"""WITH {LOCS_SQL}, s AS (SELECT CAST(y AS INTEGER) AS id, frame, max(x) AS v FROM locs GROUP BY ALL), e AS (SELECT id FROM s GROUP BY id HAVING count(*) >= 60),
 k AS (SELECT id, frame, v, lead(frame) OVER w AS f2, lead(v) OVER w AS v2, row_number() OVER w AS i, count(*) OVER (PARTITION BY id) AS n FROM s WHERE id IN (SELECT id FROM e) WINDOW w AS (PARTITION BY id ORDER BY frame))
 SELECT CAST(f AS INTEGER) AS frame, round(avg(v + (f - frame) * (v2 - v) / (f2 - frame)), 4) AS x FROM range(720) r(f) JOIN k ON f2 IS NOT NULL AND (f >= frame OR i = 1) AND (f < f2 OR i = n - 1) GROUP BY f""")
def _(spark, sf):
    rows = locs(spark, sf).groupBy(F.col("y").cast("int").alias("fiducial_id"), "frame").agg(F.max("x").alias("x"))
    return track.average_fiducials(rows, 720, ["x"], 60 / 720).select("frame", r("x", 4))


@query("order_rollup", "SELECT c_mktsegment, n_name, round(sum(o_totalprice), 2) AS revenue, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (c_mktsegment, n_name)")
def _(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.rollup("c_mktsegment", "n_name").agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"), F.count("*").alias("n"))


@query("drift_estimate")
def _(spark, sf):
    from glintloom.operators import drift as estimation

    return estimation.estimate_drift(locs(spark, sf).select("frame", (F.col("x") / 8).alias("x"), (F.col("y") / 3).alias("y")), 100, 720, 64, 64, 1)


@query("fourier_ring")
def _(spark, sf):
    from glintloom.operators import drift as estimation

    rows = setops.odd_even(locs(spark, sf).withColumnRenamed("event_id", "track_id")).withColumns({"x": F.col("x") / 8, "y": F.col("y") / 3})
    return estimation.fourier_ring(rows, "half", 64, 64, 1, 160.0, ["category"])


@query("quad_hashes", f"""WITH {PTS_SQL}, near AS (SELECT a.vec_id AS a, b.vec_id AS b FROM pts a JOIN pts b ON a.category = b.category AND a.vec_id <> b.vec_id AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) > 0.1 * 0.1 AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 16.0
   QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY pow(a.x - b.x, 2) + pow(a.y - b.y, 2), b.vec_id) <= 5),
 q AS (SELECT n.a, n.b, m.b AS c, o.b AS d FROM near n JOIN near m ON m.a = n.a AND m.b <> n.b JOIN near o ON o.a = n.a AND o.b <> n.b AND o.b <> m.b),
 f AS (SELECT q.*, pc.x AS xc, pc.y AS yc, pd.x AS xd, pd.y AS yd, pa.x AS xa, pa.y AS ya, pb.x - pa.x AS ex, pb.y - pa.y AS ey FROM q JOIN pts pa ON pa.vec_id = a JOIN pts pb ON pb.vec_id = b JOIN pts pc ON pc.vec_id = c JOIN pts pd ON pd.vec_id = d),
 i AS (SELECT *, ex * ex + ey * ey AS s FROM f WHERE pow(xc - xa - ex / 2, 2) + pow(yc - ya - ey / 2, 2) <= (ex * ex + ey * ey) / 4 AND pow(xd - xa - ex / 2, 2) + pow(yd - ya - ey / 2, 2) <= (ex * ex + ey * ey) / 4),
 u AS (SELECT a, b, c, d, ((xc - xa) * ex + (yc - ya) * ey) / s AS uc, ((yc - ya) * ex - (xc - xa) * ey) / s AS vc, ((xd - xa) * ex + (yd - ya) * ey) / s AS ud, ((yd - ya) * ex - (xd - xa) * ey) / s AS vd FROM i)
 SELECT a, b, c, d, round(uc - vc, 6) AS h_xc, round(uc + vc, 6) AS h_yc, round(ud - vd, 6) AS h_xd, round(ud + vd, 6) AS h_yd FROM u WHERE uc - vc <= ud - vd AND uc - vc + ud - vd <= 1""")
def _(spark, sf):
    found = spatial.quads(pts(spark, sf), "vec_id", 0.1, 4.0, 5, ["category"])
    return found.select("a", "b", "c", "d", r("h_xc"), r("h_yc"), r("h_xd"), r("h_yd"))


# images

IMAGE_SQL = f"{PIXELS_SQL}, img AS (SELECT frame, y, x, CAST(sum(adu) AS DOUBLE) AS value FROM pixels GROUP BY ALL)"


def summed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).groupBy("frame", "y", "x").agg(F.sum("adu").cast("double").alias("value"))


def _kernel_sql(kernel: image.Kernel) -> str:
    return "k(dy, dx, w) AS (VALUES " + ", ".join(f"({dy}, {dx}, {w!r}::DOUBLE)" for dy, dx, w in kernel) + ")"


_PSF = image.gaussian_kernel(1.0, 2)


@query("matched_filter", f"WITH {IMAGE_SQL}, {_kernel_sql(_PSF)} SELECT frame, CAST((y + dy + 16) % 16 AS INTEGER) AS y, CAST((x + dx + 16) % 16 AS INTEGER) AS x, round(sum(value * w), 4) AS value FROM img, k GROUP BY ALL")
def _(spark, sf):
    return image.matched_filter(summed(spark, sf), _PSF, 16, 16, ["frame"]).select("frame", "y", "x", r("value", 4))


@query("rolling_ball", f"WITH {IMAGE_SQL}, {_kernel_sql(image.ball(6.0))}, m AS (SELECT frame, y + dy AS y, x + dx AS x, min(value - w) AS least FROM img, k GROUP BY ALL) SELECT frame, y, x, value, round(least(value, least) + 6.0, 6) AS background FROM img JOIN m USING (frame, y, x)")
def _(spark, sf):
    return image.rolling_ball(summed(spark, sf), 6.0, ["frame"]).select("frame", "y", "x", "value", r("background"))


@query("labelled_regions", f"""WITH RECURSIVE {IMAGE_SQL}, cut AS (SELECT frame, avg(value) + 1.2 * stddev_pop(value) AS t FROM img GROUP BY frame), b AS (SELECT frame, y, x, value - t AS value, y * 16 + x AS id FROM img JOIN cut USING (frame) WHERE value > t),
 e AS (SELECT p.frame, p.id AS a, q.id AS b FROM b p JOIN b q ON p.frame = q.frame AND abs(p.y - q.y) <= 1 AND abs(p.x - q.x) <= 1), reach AS (SELECT frame, id AS a, id AS b FROM b UNION SELECT r.frame, r.a, e.b FROM reach r JOIN e ON e.frame = r.frame AND e.a = r.b),
 c AS (SELECT frame, a AS id, min(b) AS f FROM reach GROUP BY ALL), g AS (SELECT frame, f, count(*) AS n, sum(value) AS total, sum(value * y) / sum(value) AS cy, sum(value * x) / sum(value) AS cx FROM b JOIN c USING (frame, id) GROUP BY ALL)
 SELECT frame, CAST(row_number() OVER (PARTITION BY frame ORDER BY f) AS INTEGER) AS label, n, round(total, 4) AS total, round(cy, 6) AS cy, round(cx, 6) AS cx FROM g""")
def _(spark, sf):
    rows = summed(spark, sf)
    cut = rows.groupBy("frame").agg((F.avg("value") + 1.2 * F.stddev_pop("value")).alias("t"))
    above = rows.join(cut, "frame").select("frame", "y", "x", (F.col("value") - F.col("t")).alias("value"))
    return image.labelled_regions(above, 0.0, ["frame"]).select("frame", "label", "n", r("total", 4), r("cy"), r("cx"))


@query("rolling_background", f"WITH {IMAGE_SQL} SELECT frame, y, x, round(avg(CASE WHEN frame <> 3 THEN value END) OVER (PARTITION BY y, x ORDER BY frame RANGE BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS background FROM img")
def _(spark, sf):
    skip = spark.range(3, 4).select(F.col("id").cast("int").alias("frame"))
    return image.rolling_background(summed(spark, sf), 3, [], skip=skip).select("frame", "y", "x", r("background"))


@query("channel_offset", f"WITH {IMAGE_SQL}, s AS (SELECT CAST(b.frame - a.frame AS INTEGER) AS lag, avg(a.value * b.value) AS score FROM img a JOIN img b ON a.y = b.y AND a.x = b.x AND abs(b.frame - a.frame) <= 2 GROUP BY 1) SELECT lag, round(score / 1e4, 4) AS score, lag = (SELECT arg_max(lag, score) FROM s) AS best FROM s")
def _(spark, sf):
    rows = summed(spark, sf)
    return image.channel_offset(rows, rows, 2).select("lag", F.round(F.col("score") / 1e4, 4).alias("score"), "best")


CALIBRATION_SQL = "cal AS (SELECT CAST(p_partkey % 40 AS INTEGER) AS y, CAST(p_partkey // 40 AS INTEGER) AS x, CAST(p_size AS DOUBLE) AS offset_, p_retailprice AS variance FROM part)"


def _calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        (key % 40).cast("int").alias("y"), F.floor(key / 40).cast("int").alias("x"), F.col("p_size").cast("double").alias("offset"), F.col("p_retailprice").alias("variance"), F.lit(2.0).alias("gain"), F.lit(0.9).alias("rqe")
    )


@query("calibration_formats", f"""WITH {CALIBRATION_SQL} SELECT 0 AS version, x AS y, y AS x, offset_ AS "offset", variance, 2.0::DOUBLE AS gain, 1.0::DOUBLE AS rqe FROM cal UNION ALL SELECT 1, y, x, offset_, variance, 2.0, 1.0 FROM cal UNION ALL SELECT 2, y, x, offset_, variance, 2.0, 0.9 FROM cal""")
def _(spark, sf):
    rows = _calibration(spark, sf)
    parts = [image.calibration(rows, v).select(F.lit(v).alias("version"), "*") for v in (0, 1, 2)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("calibration_reslice", f"""WITH {CALIBRATION_SQL} SELECT CAST(y - 5 AS INTEGER) AS y, CAST(x - 10 AS INTEGER) AS x, offset_ AS "offset", variance FROM cal WHERE x >= 10 AND x < 30 AND y >= 5 AND y < 20""")
def _(spark, sf):
    return image.reslice(image.calibration(_calibration(spark, sf), 2), 10, 5, 20, 15).select("y", "x", "offset", "variance")


# small filters and columns


@query("rectangle_mask", f"WITH {PTS_SQL} SELECT vec_id, x, y FROM pts WHERE x >= -1 AND x < 2 AND y >= 0")
def _(spark, sf):
    return filters.rectangle(pts(spark, sf), (-1, 2), (0, None)).select("vec_id", "x", "y")


@query("channel_view", f"WITH {LOCS_SQL} SELECT frame, loc_id, x FROM (SELECT *, k / 10.0 AS z FROM locs) WHERE category = 2 AND frame >= 50 AND frame < 400 AND z > 0.5 AND z < 5")
def _(spark, sf):
    return filters.channel_view(locs(spark, sf).withColumn("z", F.col("k") / 10.0), 2, (50, 400), (0.5, 5)).select("frame", "loc_id", "x")


@query("height_threshold", f"WITH {LOCS_SQL} SELECT frame, loc_id, sum FROM locs WHERE sum > 100")
def _(spark, sf):
    return filters.bright(locs(spark, sf), 100, "sum").select("frame", "loc_id", "sum")


@query("peak_status", "SELECT o_orderkey, o_orderpriority AS status FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') OR o_orderpriority IS NULL")
def _(spark, sf):
    return filters.without_status(table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("status")), "1-URGENT", "2-HIGH")


@query("track_means", f"WITH {LOCS_SQL} SELECT y, count(*) AS track_length, round(sum(sum) / count(*), 6) AS mean FROM locs GROUP BY y")
def _(spark, sf):
    return locs(spark, sf).groupBy("y").agg(F.count("*").alias("track_length"), C.rounded_mean(F.col("sum"), 6).alias("mean"))


@query("spline_z", f"WITH {PTS_SQL} SELECT vec_id, round(20.0 * (z * 1000 + 500) / 1000, 6) AS scaled, round(0.001 * (20.0 * (z * 1000 + 500) / 1000 * 1000 / 20 - 500), 6) AS back FROM pts")
def _(spark, sf):
    scaled = C.scaled_z(F.col("z") * 1000, -500.0, 500.0, 20)
    return pts(spark, sf).select("vec_id", F.round(scaled, 6).alias("scaled"), F.round(C.rescaled_z(scaled, -500.0, 500.0, 20), 6).alias("back"))


@query("grid_tracks3d", f"WITH {PTS_SQL}, c AS (SELECT CAST(floor(x * 2) AS INTEGER) AS i, CAST(floor(y * 2) AS INTEGER) AS j, CAST(trunc((z + 0.5) * 10.0) AS INTEGER) AS k FROM pts) SELECT i, j, k, count(*) AS n FROM c GROUP BY ALL")
def _(spark, sf):
    i, j, k = C.track_cell(F.col("x"), F.col("y"), F.col("z"), 2.0, -0.5, 0.5, 10)
    return pts(spark, sf).groupBy(i.alias("i"), j.alias("j"), k.alias("k")).agg(F.count("*").alias("n"))


@query("offsets_to_z", f"""WITH {LOCS_SQL}, s AS (SELECT frame, avg(x) AS z FROM locs GROUP BY frame), e AS (SELECT arg_min(z, frame) AS first, (SELECT min(frame) FROM s WHERE z = (SELECT min(z) FROM s)) AS lo, (SELECT min(frame) FROM s WHERE z = (SELECT max(z) FROM s)) AS hi FROM s)
 SELECT frame, CAST(frame >= lo AND frame <= hi AS INTEGER) AS valid, round(z - first + 0.25, 6) AS z FROM s, e""")
def _(spark, sf):
    stage = locs(spark, sf).groupBy("frame").agg(F.avg("x").alias("stage_z"))
    return windows.offsets_to_z(stage, 0.25).select("frame", "valid", r("z"))


@query("merged_maps", "SELECT n_nationkey % 2 * 1 AS source, CASE WHEN n_nationkey % 2 = 1 THEN 0 ELSE 1 END AS target, n_name AS axis, 1.0::DOUBLE AS c0, 2.0::DOUBLE AS c1, CAST(n_regionkey AS DOUBLE) AS c2 FROM nation UNION ALL SELECT CASE WHEN n_nationkey % 2 = 1 THEN 2 ELSE 0 END, CASE WHEN n_nationkey % 2 = 1 THEN 0 ELSE 2 END, n_name, 3.0, 2.0, CAST(n_regionkey AS DOUBLE) FROM nation")
def _(spark, sf):
    source = (F.col("n_nationkey") % 2).cast("int")
    one = table(spark, sf, "nation").select(source.alias("source"), (1 - source).alias("target"), F.col("n_name").alias("axis"), F.lit(1.0).alias("c0"), F.lit(2.0).alias("c1"), F.col("n_regionkey").cast("double").alias("c2"))
    return setops.merged_maps([one, one.withColumn("c0", F.lit(3.0))])


@query("best_match", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def _(spark, sf):
    return setops.top_one(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_totalprice", ["o_orderkey"])
