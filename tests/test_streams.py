"""Streams: growing movies read frame by frame, trackers with state and timers equal to batches."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from glintloom.operators import track
from glintloom.sources import frame_stream, movies
from glintloom.streaming import stateful


def write(folder, name, frames, width=6, height=4, extra=b""):
    (folder / f"{name}.inf").write_text(f"frame dimensions = {width} x {height}\nbig endian\n")
    data = b"".join(np.full((height, width), k, ">u2").tobytes() for k in frames) + extra
    (folder / f"{name}.part").write_bytes(data)
    os.replace(folder / f"{name}.part", folder / f"{name}.dax")


def test_batch_frames_equal_the_whole_file_reader(spark, tmp_path):
    frame_stream.register(spark)
    write(tmp_path, "a", range(23))
    write(tmp_path, "b", range(5), 3, 2, b"\x01")
    got = spark.read.format("movie_frames").option("frames_per_task", "4").load(str(tmp_path))
    assert got.rdd.getNumPartitions() == 8  # one movie is read by several tasks
    rows = lambda df: sorted((os.path.basename(r.movie), r.frame, r.height, r.width, bytes(r.pixels)) for r in df.collect())
    assert rows(got) == rows(movies.read_frames(spark, str(tmp_path)).where("NOT (movie LIKE '%b.dax' AND frame > 4)"))
    assert movies.pixels(got).where("adu <> frame").count() == 0
    assert spark.read.format("movie_frames").load(str(tmp_path / "none")).count() == 0


def test_growing_movie_is_read_once_over_restarts(spark, tmp_path):
    frame_stream.register(spark)
    folder, sink, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()

    def run():
        stream = spark.readStream.format("movie_frames").option("frames_per_task", "3").load(str(folder)).select(F.regexp_extract("movie", r"(\w)\.dax$", 1).alias("m"), "frame")
        q = stream.writeStream.format("parquet").option("checkpointLocation", state).start(sink)
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return sorted((r.m, r.frame) for r in spark.read.parquet(sink).collect())

    write(folder, "a", range(5))
    assert run() == [("a", k) for k in range(5)]
    write(folder, "a", range(9), extra=b"\x00" * 11)  # a frame in part
    write(folder, "b", range(2))
    assert run() == [("a", k) for k in range(9)] + [("b", 0), ("b", 1)]
    assert run() == [("a", k) for k in range(9)] + [("b", 0), ("b", 1)]
    write(folder, "a", range(10))
    assert run() == [("a", k) for k in range(10)] + [("b", 0), ("b", 1)]


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stateful.use_rocksdb(spark)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


SCHEMA = "dataset_id int, frame int, loc_id long, x double, y double, sum double"


def feed(spark, tmp_path, batches, make, name):
    """Rows that a stream of the batches gives; each batch is one file and one micro-batch."""
    folder, sink = tmp_path / f"{name}_in", str(tmp_path / f"{name}_out")
    folder.mkdir()
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
        q = make(stateful.with_frame_time(stream, 3)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"{name}_state")).start(sink)
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    return spark.read.parquet(sink)


def made(seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for d in (0, 1):
        for f in list(range(6)) + list(range(9, 14)):
            n = int(rng.integers(2, 5))
            rows += [(d, f, i, float(rng.integers(0, 5) + rng.normal(0, 0.05)), 1.0, 4.0) for i in range(n)]
    end = [(d, 40, 0, 99.0, 1.0, 4.0) for d in (0, 1)] + [(0, 60, 0, 99.0, 1.0, 4.0)]
    # two files that cut a frame and bring its rows out of order, then rows that push the watermark on
    first = [r for r in rows if r[1] < 4 or (r[1] == 5 and r[2] % 2)]
    return rows, [first[::-1], [r for r in rows if r not in first], end[:2], end[2:]], end


def test_tracker_of_a_stream_equals_the_batch(rocks, tmp_path):
    rows, batches, end = made()
    got = feed(rocks, tmp_path, batches, lambda s: stateful.tracked_stream(s, 0.3, 1), "tracks")
    want = track.tracker(rocks.createDataFrame(rows, SCHEMA), 0.3, 1)
    key = lambda df: sorted((r.dataset_id, r.frame, r.loc_id, r.track_id) for r in df.where("frame < 20").collect())
    assert key(got) == key(want)
    assert got.where("frame = 40").count() == 2 and got.where("frame = 60").count() == 0


def test_fiducials_of_a_stream_equal_the_batch(rocks, tmp_path):
    rows, batches, _ = made(3)
    got = feed(rocks, tmp_path, batches, lambda s: stateful.fiducial_stream(s, 0.3, 2), "fiducials")
    want = track.fiducials(rocks.createDataFrame(rows, SCHEMA), 0.3, 2)
    key = lambda df: sorted((r.dataset_id, r.frame, r.loc_id, r.fiducial_id) for r in df.where("frame < 20").collect())
    assert key(got) == key(want)
    assert got.where("fiducial_id >= 0").count() > 10
