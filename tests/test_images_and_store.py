"""Deconvolution, the Parquet store and session windows on small hand-made tables."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from glintloom.operators import deconvolve, image
from glintloom.sources import store
from glintloom.streaming import tracking


@pytest.mark.parametrize("solver", ["fista", "admm", "mlem"])
def test_solvers_find_the_emitters(spark, solver):
    psf = np.array([w for *_, w in image.gaussian_kernel(1.0, 3)]).reshape(7, 7)
    truth = np.zeros((20, 24))
    truth[5, 6], truth[14, 17] = 100.0, 60.0
    kernel = np.zeros_like(truth)
    kernel[:7, :7] = psf
    response = np.fft.rfft2(np.roll(kernel, (-3, -3), (0, 1)))
    frame = deconvolve._blur(truth, response)
    rows = [(0, 20, 24, frame.ravel().tolist()), (1, 20, 24, (frame * 0).ravel().tolist()), (2, 20, 24, None)]
    frames = spark.createDataFrame(rows, "frame int, height int, width int, pixels array<double>")
    got = deconvolve.deconvolved(frames, psf, solver, 400, 0.01 if solver != "mlem" else 0.0, 5.0)
    regions = image.labelled_regions(got, 5.0, ["frame"]).orderBy("label").collect()
    assert [(r.frame, round(r.cy), round(r.cx)) for r in regions] == [(0, 5, 6), (0, 14, 17)]
    assert abs(regions[0].total - 100) < 30 and abs(regions[1].total - 60) < 20


def test_labelled_regions_touch_at_corners_and_stay_in_their_frame(spark):
    bright = [(0, 0, 0), (0, 1, 1), (0, 2, 0), (0, 5, 5), (1, 5, 6), (1, 1, 3), (1, 0, 4)]
    pixels = spark.createDataFrame([(f, y, x, 2.0) for f, y, x in bright] + [(0, 3, 3, 0.5)], "frame int, y int, x int, value double")
    got = [(r.frame, r.label, r.n, r.total, r.cy, r.cx) for r in image.labelled_regions(pixels, 1.0, ["frame"]).orderBy("frame", "label").collect()]
    assert got == [(0, 1, 3, 6.0, 1.0, 1 / 3), (0, 2, 1, 2.0, 5.0, 5.0), (1, 1, 2, 4.0, 0.5, 3.5), (1, 2, 1, 2.0, 5.0, 6.0)]
    assert image.labelled_regions(pixels.limit(0), 1.0, ["frame"]).count() == 0


def test_unknown_calibration_format_is_refused(spark):
    with pytest.raises(ValueError):
        image.calibration(spark.range(1), 3)


def test_store_of_localizations_and_tracks(spark, tmp_path):
    path = str(tmp_path / "locs")
    locs = spark.range(5000).select(F.col("id").cast("int").alias("frame"), F.lit(0).alias("loc_id"), F.col("id").cast("double").alias("x"))
    store.write_localizations(locs.where("frame < 2500"), path)
    store.write_localizations(locs.where("frame >= 2500"), path)
    assert store.read_localizations(spark, path).count() == 5000
    assert sorted(r.frame for r in store.read_localizations(spark, path, 990, 1010).collect()) == list(range(990, 1010))
    store.write_localizations(locs.limit(3), str(tmp_path / "two"), channel=1)
    assert store.read_localizations(spark, str(tmp_path / "two")).columns == ["frame", "loc_id", "c1_x"]
    added = store.with_column(locs, spark.createDataFrame([(3, 0, 7)], "frame int, loc_id int, category int"), ["frame", "loc_id"], "category", F.lit(9))
    assert {r.category: r["count"] for r in added.groupBy("category").count().collect()} == {7: 1, 9: 4999}
    tracks = spark.range(95).select(F.col("id").alias("track_id"), (F.col("id") % 7).alias("frame_number"))
    for _ in range(2):  # the second write replaces the first
        store.write_tracks(tracks, str(tmp_path / "tracks"), 30)
    assert store.read_tracks(spark, str(tmp_path / "tracks")).count() == 95
    first, second = (store.read_tracks(spark, str(tmp_path / "tracks"), k) for k in (0, 1))
    assert first.agg(F.max("frame_number")).first()[0] <= second.agg(F.min("frame_number")).first()[0]


def test_channels_of_a_store_are_wide_rows(spark, tmp_path):
    path = str(tmp_path / "locs")
    rows = spark.range(10).select((F.col("id") % 3 * 900).cast("int").alias("frame"), F.col("id").alias("loc_id"), F.col("id").cast("double").alias("x"), F.lit(1.0).alias("y"))
    store.write_localizations(rows, path, channel=0)
    store.write_localizations(rows.where("loc_id < 8").withColumn("x", F.col("x") + 100), path, channel=1)
    assert store.channels(spark, path) == [0, 1]
    got = {r.loc_id: r for r in store.read_localizations(spark, path).collect()}
    assert len(got) == 10 and set(got[0].asDict()) == {"frame", "loc_id", "x", "y", "c1_x", "c1_y"}
    assert all(got[k].x == k and got[k].c1_x == (k + 100 if k < 8 else None) for k in range(10))
    store.write_localizations(rows.withColumns({"frame": F.lit(5000), "height": F.lit(2.0)}), path)  # an append with a new field
    assert store.read_localizations(spark, path).count() == 20
    assert {(r.c1_x, r.height) for r in store.read_localizations(spark, path, 5000, 5001).collect()} == {(None, 2.0)}
    with pytest.raises(ValueError, match="no localizations"):
        store.read_localizations(spark, str(tmp_path))


def test_sessions_of_a_stream(spark, tmp_path):
    rows = [(f, c) for c, frames in ((1, (0, 1, 2, 9, 10)), (2, (4,))) for f in frames] + [(500, 3)]
    spark.createDataFrame(rows, "frame int, category int").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("frame int, category int").parquet(str(tmp_path / "in"))
    query = tracking.stream_sessions(tracking.with_event_time(stream, 5), 3).writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted((r.category, r.start, r.stop, r.n) for r in spark.table("sessions").collect())
    assert got == [(1, 0, 2, 3), (1, 9, 10, 2), (2, 4, 4, 1)]
