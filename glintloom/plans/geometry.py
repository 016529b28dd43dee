"""Registered queries of tessellation, drift against a growing master, maps between lists of points, chained transforms and wavelets, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from glintloom.operators import alignment, bounds, chained, image, master_drift, micrometry, stacks, tessellation, wavelet
from glintloom.plans.catalog import _PSF, IMAGE_SQL, _kernel_sql, query, r, summed
from glintloom.sources.views import LOCS_SQL, PTS_SQL, locs, pts

#: A side is what is left of the bisector of two points after all third points have cut it; its triangle adds to the area of the cell.
_CELLS_SQL = f"""{PTS_SQL},
 e AS (SELECT a.vec_id AS a, b.vec_id AS b, a.x AS ax, a.y AS ay, b.x - a.x AS ex, b.y - a.y AS ey FROM pts a JOIN pts b ON a.vec_id <> b.vec_id),
 cut AS (SELECT a, b, sqrt(ex * ex + ey * ey) AS size, (pow(c.x - ax, 2) + pow(c.y - ay, 2)) / 2 - (ex * (c.x - ax) + ey * (c.y - ay)) / 2 AS rest, (ex * (c.y - ay) - ey * (c.x - ax)) / sqrt(ex * ex + ey * ey) AS slope FROM e JOIN pts c ON c.vec_id <> a AND c.vec_id <> b),
 bound AS (SELECT a, b, any_value(size) AS size, min(CASE WHEN slope > 0 THEN rest / slope END) AS high, max(CASE WHEN slope < 0 THEN rest / slope END) AS low FROM cut GROUP BY a, b),
 side AS (SELECT a, b, CASE WHEN high IS NULL OR low IS NULL THEN NULL ELSE (high - low) * size / 4 END AS part FROM bound WHERE high IS NULL OR low IS NULL OR high > low),
 cell AS (SELECT a AS vec_id, count(*) AS n_sides, CASE WHEN count(*) = count(part) THEN sum(part) END AS area FROM side GROUP BY a)"""


@query("voronoi_cells", f"WITH {_CELLS_SQL} SELECT vec_id, CAST(n_sides AS INTEGER) AS n_sides, area IS NULL AS is_open, round(1 / area, 6) AS density FROM cell")
def _(spark, sf):
    found = tessellation.cells(pts(spark, sf), "vec_id")
    return found.select(F.col("place").alias("vec_id"), F.size("neighbours").alias("n_sides"), F.col("area").isNull().alias("is_open"), F.round(1 / F.col("area"), 6).alias("density"))


@query("voronoi_clusters", f"""WITH RECURSIVE {_CELLS_SQL},
 d AS (SELECT vec_id, coalesce(1 / area, 0) AS density FROM cell),
 dense AS (SELECT vec_id FROM d WHERE density > 1.5 * (SELECT quantile_cont(density, 0.5) FROM d)),
 link AS (SELECT a, b FROM side WHERE a IN (FROM dense) AND b IN (FROM dense)),
 reach(vec_id, root) AS (SELECT vec_id, vec_id FROM dense UNION SELECT link.b, reach.root FROM reach JOIN link ON link.a = reach.vec_id),
 comp AS (SELECT vec_id, min(root) AS root FROM reach GROUP BY vec_id),
 large AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS cluster_id FROM comp GROUP BY root HAVING count(*) > 3)
 SELECT vec_id, round(density, 6) AS density, CAST(coalesce(cluster_id, -1) AS INTEGER) AS cluster_id FROM d LEFT JOIN comp USING (vec_id) LEFT JOIN large USING (root)""")
def _(spark, sf):
    return tessellation.voronoi_clusters(pts(spark, sf), "vec_id", 1.5, 3).select("vec_id", r("density"), "cluster_id")


_HALVES_SQL = f"""{LOCS_SQL}, cells AS (SELECT frame % 2 AS half, CAST(floor(x / 4) AS INTEGER) AS ix, CAST(floor(y) AS INTEGER) AS iy, count(*) AS n FROM locs WHERE y < 150 GROUP BY ALL)"""


@query("xy_lags", f"WITH {_HALVES_SQL} SELECT a.ix - b.ix AS lx, a.iy - b.iy AS ly, CAST(sum(a.n * b.n) AS BIGINT) AS s FROM cells a JOIN cells b ON a.half = 0 AND b.half = 1 AND abs(a.ix - b.ix - 2) <= 5 AND abs(a.iy - b.iy + 1) <= 5 GROUP BY ALL")
def _(spark, sf):
    rows = locs(spark, sf).select("frame", (F.col("x") / 4).alias("x"), "y")
    halves = [master_drift.grid_2d(rows.where(F.col("frame") % 2 == k), 128, 150) for k in (0, 1)]
    return master_drift.xy_lag_sums(*halves, (2, -1)).select("lx", "ly", F.col("s").cast("long").alias("s"))


@query("master_drift")
def _(spark, sf):
    rows = locs(spark, sf).select("frame", (F.col("x") / 8).alias("x"), (F.col("y") / 3).alias("y"), (F.col("k") / 100.0 - 0.5).alias("z"))
    return master_drift.master_drift(rows, 100, 720, 64, 64, 1, (-0.5, 0.5))


# two lists in each category: 40 times the points, and four in five of them turned, stretched and shifted
_LISTS_SQL = f"""{PTS_SQL}, one AS (SELECT category, vec_id AS id, 40 * x AS x, 40 * y AS y FROM pts), two AS (SELECT category, id, 300 + 1.1 * (0.8 * x - 0.6 * y) AS x, 200 + 1.1 * (0.6 * x + 0.8 * y) AS y FROM one WHERE id % 5 <> 0)"""


def _quads_sql(name: str) -> str:
    return f"""near_{name} AS (SELECT a.category, a.id AS a, b.id AS b FROM {name} a JOIN {name} b ON a.category = b.category AND a.id <> b.id AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) > 16.0 AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 25600.0
   QUALIFY row_number() OVER (PARTITION BY a.category, a.id ORDER BY pow(a.x - b.x, 2) + pow(a.y - b.y, 2), b.id) <= 6),
 f_{name} AS (SELECT n.category, n.a, n.b, m.b AS c, o.b AS d, pa.x AS xa, pa.y AS ya, pb.x AS xb, pb.y AS yb, pc.x AS xc, pc.y AS yc, pd.x AS xd, pd.y AS yd, pb.x - pa.x AS ex, pb.y - pa.y AS ey FROM near_{name} n JOIN near_{name} m ON m.a = n.a AND m.b <> n.b JOIN near_{name} o ON o.a = n.a AND o.b <> n.b AND o.b <> m.b
   JOIN {name} pa ON pa.id = n.a JOIN {name} pb ON pb.id = n.b JOIN {name} pc ON pc.id = m.b JOIN {name} pd ON pd.id = o.b),
 u_{name} AS (SELECT *, ((xc - xa) * ex + (yc - ya) * ey) / (ex * ex + ey * ey) AS uc, ((yc - ya) * ex - (xc - xa) * ey) / (ex * ex + ey * ey) AS vc, ((xd - xa) * ex + (yd - ya) * ey) / (ex * ex + ey * ey) AS ud, ((yd - ya) * ex - (xd - xa) * ey) / (ex * ex + ey * ey) AS vd FROM f_{name}
   WHERE pow(xc - (xa + xb) / 2, 2) + pow(yc - (ya + yb) / 2, 2) <= (ex * ex + ey * ey) / 4 AND pow(xd - (xa + xb) / 2, 2) + pow(yd - (ya + yb) / 2, 2) <= (ex * ex + ey * ey) / 4),
 quad_{name} AS (SELECT *, uc - vc AS h1, uc + vc AS h2, ud - vd AS h3, ud + vd AS h4 FROM u_{name} WHERE uc - vc <= ud - vd AND uc - vc + ud - vd <= 1)"""


def _near_sql(order: str) -> str:
    return " AND ".join(f"abs(p.h{i} - q.h{j}) < 0.01" for i, j in enumerate(order, 1))


_MATCH_SQL = f"""WITH {_LISTS_SQL}, {_quads_sql("one")}, {_quads_sql("two")},
 m AS (SELECT row_number() OVER (ORDER BY p.a, p.b, p.c, p.d, q.a, q.b, q.c, q.d) AS id, p.category, [p.xa, p.xb, p.xc, p.xd] AS x1, [p.ya, p.yb, p.yc, p.yd] AS y1, [q.xa, q.xb, q.xc, q.xd] AS x2, [q.ya, q.yb, q.yc, q.yd] AS y2 FROM quad_one p JOIN quad_two q ON p.category = q.category AND (({_near_sql("1234")}) OR ({_near_sql("2143")}))),
 c AS (SELECT *, [v - list_avg(x1) FOR v IN x1] AS p1, [v - list_avg(y1) FOR v IN y1] AS r1, [v - list_avg(x2) FOR v IN x2] AS p2, [v - list_avg(y2) FOR v IN y2] AS r2 FROM m),
 g AS (SELECT *, list_inner_product(p2, p2) AS sxx, list_inner_product(p2, r2) AS sxy, list_inner_product(r2, r2) AS syy FROM c),
 l AS (SELECT *, (list_inner_product(p2, p1) * syy - list_inner_product(r2, p1) * sxy) / (sxx * syy - sxy * sxy) AS xx, (list_inner_product(r2, p1) * sxx - list_inner_product(p2, p1) * sxy) / (sxx * syy - sxy * sxy) AS xy,
   (list_inner_product(p2, r1) * syy - list_inner_product(r2, r1) * sxy) / (sxx * syy - sxy * sxy) AS yx, (list_inner_product(r2, r1) * sxx - list_inner_product(p2, r1) * sxy) / (sxx * syy - sxy * sxy) AS yy FROM g),
 t AS (SELECT id, category, list_avg(x1) - xx * list_avg(x2) - xy * list_avg(y2) AS x0, xx, xy, list_avg(y1) - yx * list_avg(x2) - yy * list_avg(y2) AS y0, yx, yy FROM l),
 d AS (SELECT t.id, t.category, b.id AS p, min(pow(a.x - t.x0 - xx * b.x - xy * b.y, 2) + pow(a.y - t.y0 - yx * b.x - yy * b.y, 2)) AS d2 FROM t JOIN two b ON b.category = t.category JOIN one a ON a.category = t.category GROUP BY ALL),
 s AS (SELECT id, category, ln((0.000004 + (1 - 0.000004) * sum(exp(-d2 / 2)) / count(*)) / 0.000004) AS score FROM d GROUP BY id, category)"""


def _lists(spark, sf):
    one = pts(spark, sf).select("category", F.col("vec_id").alias("id"), (40 * F.col("x")).alias("x"), (40 * F.col("y")).alias("y"))
    x, y = F.col("x"), F.col("y")
    return one, one.where("id % 5 <> 0").select("category", "id", (300 + 1.1 * (0.8 * x - 0.6 * y)).alias("x"), (200 + 1.1 * (0.6 * x + 0.8 * y)).alias("y"))


@query("micrometry_maps", f"{_MATCH_SQL}, best AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, id) AS k FROM s) SELECT t.category, round(score, 6) AS score, round(x0, 4) AS x0, round(xx, 6) AS xx, round(xy, 6) AS xy, round(y0, 4) AS y0, round(yx, 6) AS yx, round(yy, 6) AS yy FROM best JOIN t USING (id) WHERE k = 1")
def _(spark, sf):
    found = micrometry.best_maps(*_lists(spark, sf), "id", ["category"], 0.000004, 4.0, 160.0, 6, 0.01)
    return found.select("category", r("score"), r("x0", 4), r("xx"), r("xy"), r("y0", 4), r("yx"), r("yy"))


@query("micrometry_refined", f"WITH {_LISTS_SQL} SELECT category, count(*) AS n, round(regr_intercept(one.x, u), 4) + CAST(0 AS DOUBLE) AS x0, round(regr_intercept(one.y, v), 4) + CAST(0 AS DOUBLE) AS y0 FROM (SELECT *, (0.8 * (x - 300) + 0.6 * (y - 200)) / 1.1 AS u, (0.8 * (y - 200) - 0.6 * (x - 300)) / 1.1 AS v FROM two) t JOIN one USING (category, id) GROUP BY category")
def _(spark, sf):
    one, two = _lists(spark, sf)
    # a first guess that is off by a shift and a small turn
    guess = one.select("category").distinct().select("category", F.lit(-326.8).alias("x0"), F.lit(0.7273).alias("xx"), F.lit(0.5453).alias("xy"), F.lit(18.0).alias("y0"), F.lit(-0.5455).alias("yx"), F.lit(0.7272).alias("yy"))
    found = micrometry.refined_maps(guess, one, two, "id", ["category"], 4.0)
    # the map itself at the image of the origin, where an exact map gives zero
    at = lambda c: F.round(F.col(f"{c}0") + 300 * F.col(f"{c}x") + 200 * F.col(f"{c}y"), 4) + F.lit(0.0)
    return found.select("category", "n", at("x").alias("x0"), at("y").alias("y0"))


# a transform of each frame to the one before, from what is in it: a small turn with a stretch, and a shift
_STEPS_SQL = f"{LOCS_SQL}, t AS (SELECT frame, 1 + count(*) / 100000.0 AS c, avg(x) / 100000 AS s, avg(y) / 1000 AS u FROM locs WHERE frame > 0 AND frame < 720 GROUP BY frame)"


@query("chained_transforms", f"""WITH RECURSIVE {_STEPS_SQL}, every AS (SELECT CAST(f AS INTEGER) AS frame, coalesce(c, 1) AS c, coalesce(s, 0) AS s, coalesce(u, 0) AS u FROM range(1, 720) r(f) LEFT JOIN t ON frame = f),
 run AS (SELECT 0 AS frame, 1::DOUBLE AS m00, 0::DOUBLE AS m01, 0::DOUBLE AS m10, 1::DOUBLE AS m11, 0::DOUBLE AS m20, 0::DOUBLE AS m21
   UNION ALL SELECT e.frame, c * m00 - s * m10, c * m01 - s * m11, s * m00 + c * m10, s * m01 + c * m11, u * m00 + m20, u * m01 + m21 FROM run JOIN every e ON e.frame = run.frame + 1)
 SELECT frame, round(m00, 6) AS m00, round(m01, 6) AS m01, round(m10, 6) AS m10, round(m11, 6) AS m11, round(m20, 4) + CAST(0 AS DOUBLE) AS m20, round(m21, 4) + CAST(0 AS DOUBLE) AS m21 FROM run""")
def _(spark, sf):
    rows = locs(spark, sf).where("frame > 0 AND frame < 720").groupBy("frame").agg((1 + F.count("*") / 100000).alias("c"), (F.avg("x") / 100000).alias("s"), (F.avg("y") / 1000).alias("u"))
    steps = rows.select("frame", F.col("c").alias("m00"), (-F.col("s")).alias("m01"), F.col("s").alias("m10"), F.col("c").alias("m11"), F.col("u").alias("m20"), F.lit(0.0).alias("m21"))
    return chained.to_target(steps, 0, 720).select("frame", r("m00"), r("m01"), r("m10"), r("m11"), (F.round("m20", 4) + 0.0).alias("m20"), (F.round("m21", 4) + 0.0).alias("m21"))


@query("aligned_union")
def _(spark, sf):
    points = pts(spark, sf).select("vec_id", (32 + 2 * F.col("x")).alias("x"), (32 + 2 * F.col("y")).alias("y"), F.col("z").alias("z"))
    moved = points.withColumns({"x": F.col("x") + 1.5, "y": F.col("y") - 0.75, "z": F.col("z") + 0.1})
    return alignment.aligned_union(points, moved, alignment.track_offset(points, moved, 64, 64, 2))


def _matrix_sql(name: str, column: str, length: int) -> str:
    m = wavelet.smoothing_matrix(length, 1)
    return f"{name}({column}, t, w) AS (VALUES " + ", ".join(f"({j}, {i}, {float(m[i, j])!r}::DOUBLE)" for i in range(length) for j in range(length) if abs(m[i, j]) > 1e-15) + ")"


def _image(spark, sf):
    # every pixel of 16 x 16 in each frame, 0 where there is none
    grid = spark.range(7 * 256).select((F.floor(F.col("id") / 256) + 1).cast("int").alias("frame"), (F.floor(F.col("id") / 16) % 16).cast("int").alias("y"), (F.col("id") % 16).cast("int").alias("x"))
    return grid.join(summed(spark, sf), ["frame", "y", "x"], "left").select("frame", "y", "x", F.coalesce("value", F.lit(0.0)).alias("value"))


_IMAGE_SQL = f"{IMAGE_SQL}, whole AS (SELECT CAST(f AS INTEGER) AS frame, CAST(r AS INTEGER) AS y, CAST(c AS INTEGER) AS x, coalesce(value, 0) AS value FROM range(1, 8) a(f), range(16) b(r), range(16) d(c) LEFT JOIN img ON img.frame = f AND img.y = r AND img.x = c)"


@query("wavelet_background", f"WITH {_IMAGE_SQL}, {_matrix_sql('mx', 'x', 16)}, {_matrix_sql('my', 'y', 16)}, h AS (SELECT frame, y, mx.t AS x, sum(value * w) AS v FROM whole JOIN mx USING (x) GROUP BY ALL) SELECT frame, my.t AS y, x, round(sum(v * w), 4) + CAST(0 AS DOUBLE) AS background FROM h JOIN my USING (y) GROUP BY frame, my.t, x")
def _(spark, sf):
    found = wavelet.wavelet_background(_image(spark, sf), 16, 16, 1, 10.0, 1, ["frame"])
    return found.select("frame", "y", "x", (F.round("background", 4) + 0.0).alias("background"))


# the images as point-spread functions, with slopes that grow with the distance from the middle
_FISHER_CELLS = [(i, j) for i in range(5) for j in range(i, 5)]


@query("fisher_sums", f"""WITH {IMAGE_SQL}, p AS (SELECT frame, value AS psf, value * (x - 7.5) / 20 AS dx, value * (y - 7.5) / 20 AS dy, value * ((x - 7.5) * (x - 7.5) - (y - 7.5) * (y - 7.5)) / 400 AS dz FROM img),
 s AS (SELECT *, psf / sum(psf) OVER (PARTITION BY frame) AS d0, 1 / sum(psf) OVER (PARTITION BY frame) AS scale FROM p),
 d AS (SELECT frame, 1 / (d0 * 500 + 2) AS w, d0, -dx * scale * 500 / 160 AS d1, -dy * scale * 500 / 160 AS d2, dz * scale * 500 / 50 AS d3, 1.0 AS d4 FROM s)
 SELECT frame, {", ".join(f"round(sum(w * d{i} * d{j}), 8) + CAST(0 AS DOUBLE) AS f{i}{j}" for i, j in _FISHER_CELLS)} FROM d GROUP BY frame""")
def _(spark, sf):
    x, y, v = F.col("x") - 7.5, F.col("y") - 7.5, F.col("value")
    psf = summed(spark, sf).select("frame", v.alias("psf"), (v * x / 20).alias("dx"), (v * y / 20).alias("dy"), (v * (x * x - y * y) / 400).alias("dz"))
    found = bounds.fisher_sums(psf, 500.0, 2.0, ["frame"], 160.0, 50.0)
    return found.select("frame", *[(F.round(f"f{i}{j}", 8) + 0.0).alias(f"f{i}{j}") for i, j in _FISHER_CELLS])


# changes of frames, and stacks of frames


@query("filtered_changes", f"WITH {IMAGE_SQL}, {_kernel_sql(_PSF)} SELECT frame, CAST((y + dy + 16) % 16 AS INTEGER) AS y, CAST((x + dx + 16) % 16 AS INTEGER) AS x, round(sum(value * w), 4) AS value FROM img, k GROUP BY ALL")
def _(spark, sf):
    found = image.filtered_changes(summed(spark, sf), _PSF, 16, 16, [])
    return image.each_frame(found).select("frame", "y", "x", r("value", 4))


def _stacks(spark, sf):
    rows = summed(spark, sf).withColumn("z", F.floor(F.col("frame") / 2).cast("int"))
    return [stacks.summed(rows.where(F.col("frame") % 2 == k)) for k in (0, 1)]


_STACKS_SQL = f"{IMAGE_SQL}, s AS (SELECT frame % 2 AS half, CAST(floor(frame / 2) AS INTEGER) AS z, y, x, value FROM img)"


@query("stack_lags", f"WITH {_STACKS_SQL}, l AS (SELECT lz, ly, lx FROM range(-1, 2) a(lz), range(-2, 3) b(ly), range(-1, 4) c(lx)) SELECT CAST(lz AS INTEGER) AS lz, CAST(ly AS INTEGER) AS ly, CAST(lx AS INTEGER) AS lx, round(sum(a.value * b.value), 3) AS s FROM l, s b JOIN s a ON a.half = 0 AND b.half = 1 AND a.z = b.z + lz AND a.y = b.y + ly AND a.x = b.x + lx GROUP BY ALL")
def _(spark, sf):
    return stacks.lag_sums(*_stacks(spark, sf), (0, 0, 1), (1, 2, 2)).select("lz", "ly", "lx", r("s", 3))


def _moves_sql(name: str, shift: float) -> str:
    return f"{name}(d, w) AS (VALUES " + ", ".join(f"({p}, {w!r}::DOUBLE)" for p, w in zip(range(-stacks.REACH, stacks.REACH + 1), stacks.kernel(stacks.np.arange(-stacks.REACH, stacks.REACH + 1) - shift)[0].tolist(), strict=True)) + ")"


@query("stack_shift", f"WITH {_STACKS_SQL}, {_moves_sql('my', 0.25)}, {_moves_sql('mx', -0.4)} SELECT z, CAST(y + my.d AS INTEGER) AS y, CAST(x + mx.d AS INTEGER) AS x, round(sum(value * my.w * mx.w), 4) AS value FROM s, my, mx WHERE half = 0 AND y + my.d BETWEEN 0 AND 15 AND x + mx.d BETWEEN 0 AND 15 GROUP BY ALL")
def _(spark, sf):
    moved = stacks.translated(_stacks(spark, sf)[0], (0.0, 0.25, -0.4), (1 << 30, 16, 16))
    return moved.select("z", "y", "x", r("value", 4))
