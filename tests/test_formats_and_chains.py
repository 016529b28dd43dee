"""Registration files, chained transforms, tagged-spot files, aligned unions and filled series."""

from __future__ import annotations

import os

import numpy as np
import pytest

from glintloom.operators import alignment, chained, windows
from glintloom.sources import molecules, registration, tagged_spots

CELLS = list(chained.CELLS)


def serial(steps, target):
    """All transforms to the target, one product after the other."""
    full = [np.eye(3) for _ in range(len(steps))]
    for k, s in enumerate(steps):
        if s is not None and k != target:
            full[k][:, :2] = np.array(s).reshape(3, 2)
    out = list(full)
    for k in range(target + 1, len(steps)):
        out[k] = full[k] @ out[k - 1]
    for k in range(target - 1, -1, -1):
        out[k] = full[k] @ out[k + 1]
    out[target] = np.eye(3)
    return [m[:, :2].ravel() for m in out]


@pytest.mark.parametrize(("n", "target", "piece"), [(10_000, 3_000, 1000), (130, 64, 5), (1, 0, 1000)])
def test_chains_equal_a_serial_product(spark, monkeypatch, n, target, piece):
    monkeypatch.setattr(chained, "PIECE", piece)
    rng = np.random.default_rng(0)
    turn = rng.normal(0, 0.01, n)
    steps = [None if k % 17 == 5 else (np.cos(t), -np.sin(t), np.sin(t), np.cos(t), *rng.normal(0, 0.1, 2)) for k, t in enumerate(turn)]
    rows = [(k, *map(float, s)) for k, s in enumerate(steps) if s is not None]
    table = spark.createDataFrame(rows, "frame int, " + ", ".join(f"{c} double" for c in CELLS)).repartition(3)
    got = chained.to_target(table, target, n).orderBy("frame").toPandas()
    assert got.frame.tolist() == list(range(n))
    assert np.allclose(got[CELLS].to_numpy(), serial(steps, target), atol=1e-8)


def test_chains_by_key_and_moved_localizations(spark):
    rows = [(k, f, 1.0, 0.0, 0.0, 1.0, float(k), 1.0) for k in (1, 2) for f in range(5)]
    table = spark.createDataFrame(rows, "movie int, frame int, " + ", ".join(f"{c} double" for c in CELLS))
    found = chained.to_target(table, 2, 5, ["movie"])
    locs = spark.createDataFrame([(1, 0, 5.0, 5.0, "a"), (2, 4, 5.0, 5.0, "b"), (2, 9, 5.0, 5.0, "c")], "movie int, frame int, x double, y double, name string")
    got = {r.name: (r.x, r.y) for r in chained.transformed(locs, found, ["movie"]).collect()}
    assert got == {"a": (7.0, 7.0), "b": (9.0, 7.0), "c": (5.0, 5.0)}
    assert chained.to_target(table.limit(0), 2, 5, ["movie"]).count() == 0


def record(kind, source, target, before, after):
    lines = lambda p: "".join(f"{x}\t{y}\n" for x, y in p)
    return f"{kind}\nSource img: {source} Target img: {target}\n{lines(before)}\n{lines(after)}\n"


def test_registration_files(spark, tmp_path):
    before = np.array([[40.0, 80.0], [200.0, 60.0], [120.0, 240.0]])
    m = np.array([[0.9, 0.2], [-0.1, 1.1]])
    turn = np.array([[np.cos(0.3), -np.sin(0.3)], [np.sin(0.3), np.cos(0.3)]])
    text = "MultiStackReg Transformation File\nFile Version 1.0\n0\n"
    text += record("AFFINE", 1, 2, before, before @ m + [8, -4]) + record("RIGID_BODY", 3, 2, before, before @ turn + [4, 12])
    (tmp_path / "reg.txt").write_text(text)
    one, three = registration.read_registrations(spark, str(tmp_path / "reg.txt")).orderBy("frame").collect()
    assert (one.frame, one.target, one.kind, three.frame, three.target, three.kind) == (0, 1, "AFFINE", 2, 1, "RIGID_BODY")
    assert np.allclose([one[c] for c in CELLS], [*m.ravel(), 2, -1], atol=1e-9)
    assert np.allclose([three[c] for c in CELLS], [*turn.ravel(), 1, 3], atol=1e-9)
    found = chained.to_target(registration.read_registrations(spark, str(tmp_path / "reg.txt")), 1, 3)
    assert np.allclose([[r[c] for c in CELLS] for r in found.orderBy("frame").collect()], [[one[c] for c in CELLS], chained.IDENTITY, [three[c] for c in CELLS]])


def test_varints():
    for n in (0, 1, 127, 128, 300, 2**31 - 1, 2**40, -1, -(2**31)):
        data = tagged_spots.varint(n)
        v, end = tagged_spots.read_varint(data, 0)
        assert end == len(data) and (v - (1 << 64) if v >> 63 else v) == n
    assert tagged_spots.varint(300) == b"\xac\x02"


def test_tagged_spots_round_trip(spark, tmp_path):
    tagged_spots_rows = [(1, f, float(f % 7), float(k), 0.5, 100.0 + k, 10.0, 2.0, 1.0, -3 if k == 4 else k) for f in range(40) for k in range(25)]
    schema = "channel int, frame int, x float, y float, z float, intensity float, background float, width float, a float, flag int"
    spots = spark.createDataFrame(tagged_spots_rows, schema).repartition(3)
    folder = str(tmp_path / "spots")
    names = tagged_spots.write_spots(spots, folder, {"name": "movie", "pixel_size": 160.0, "nr_frames": 40})
    assert len(names) == 3 and sorted(os.listdir(folder)) == sorted(["_attempts", *map(os.path.basename, names)])
    details = [tagged_spots.spot_list(n) for n in names]
    assert sum(d["nr_spots"] for d in details) == 1000 and all(d["name"] == "movie" and d["pixel_size"] == 160.0 and d["nr_channels"] == 1 for d in details)
    spark.dataSource.register(tagged_spots.TaggedSpots)
    got = spark.read.format("tagged_spots").option("records_per_task", "100").load(folder)
    assert got.rdd.getNumPartitions() >= 10  # one file is read by several tasks
    columns = [c.split()[0] for c in schema.split(", ")]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, spots.collect()))
    assert got.where("x_original IS NOT NULL OR molecule IS NOT NULL").count() == 0
    one = spark.read.format("tagged_spots").load(names[0])
    assert one.count() == details[0]["nr_spots"] and [os.path.basename(r.path) for r in one.select("path").distinct().collect()] == [os.path.basename(names[0])]


def test_molecules_as_spots(spark):
    locs = spark.createDataFrame([(f, float(x), 2.0, 0.1) for f in range(3) for x in range(4)], "frame int, x double, y double, z double")
    spots = tagged_spots.from_molecules(molecules.to_molecules(locs, 160.0), 160.0).orderBy("molecule").collect()
    assert [r.molecule for r in spots] == list(range(12)) and [r.frame for r in spots] == [1] * 4 + [2] * 4 + [3] * 4
    assert spots[1].x == 320.0 and spots[1].y == 480.0 and spots[1].z == pytest.approx(100.0)


def test_record_starts_over_small_blocks(tmp_path):
    from pyarrow import fs

    data = b"".join(tagged_spots.encode({"molecule": k, "x": 1.0}, tagged_spots.SPOT) for k in range(50))
    (tmp_path / "f").write_bytes(b"\0" * 12 + data)
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "f")) as f:
        starts = tagged_spots.record_starts(f, 12 + len(data), 7, 32)
    whole = [12]
    for k in range(50):
        whole.append(whole[-1] + len(tagged_spots.encode({"molecule": k, "x": 1.0}, tagged_spots.SPOT)))
    assert starts == [*whole[:-1:7], whole[-1]]


def test_align_and_union(spark):
    rng = np.random.default_rng(0)
    x, y, z = rng.normal(10, 0.2, 500), rng.normal(10, 0.2, 500), rng.normal(0, 0.05, 500)
    rows = lambda dx, dz, name: spark.createDataFrame([(float(a + dx), float(b), float(c + dz), name) for a, b, c in zip(x, y, z, strict=True)], "x double, y double, z double, name string")
    one, two = rows(0, 0, "one"), rows(1.0, 0.3, "two").drop("name")
    offset = alignment.track_offset(one, two, 20, 20)
    assert np.allclose(offset, [-1, 0, -0.3], atol=0.001, rtol=0.1)
    both = alignment.aligned_union(one, two, offset).toPandas()
    assert len(both) == 1000 and both.name.isna().sum() == 500
    assert np.allclose(both[["x", "y", "z"]].std(), [0.2, 0.2, 0.05], atol=0.001, rtol=0.1)
    with pytest.raises(ValueError, match="x and y"):
        alignment.track_offset(one, two.limit(0), 20, 20)


def test_filled_series(spark):
    rows = [(1, 3, 1.0), (1, 6, 2.0), (1, 9, 2.0), (1, 12, 1.0), (2, 0, 5.0), (2, 15, 20.0), (3, 4, 7.0), (3, 5, None), (4, 2, None), (5, -2, 0.0), (5, 20, 22.0)]
    series = spark.createDataFrame(rows, "id int, frame int, v double")
    got = {}
    for r in windows.filled(series, 16, "v", "id").orderBy("frame").collect():
        got.setdefault(r.id, []).append(r.v)
    assert np.allclose(got[1], [0, 1 / 3, 2 / 3, 1, 4 / 3, 5 / 3, 2, 2, 2, 2, 5 / 3, 4 / 3, 1, 2 / 3, 1 / 3, 0])
    assert got[2] == [5.0 + k for k in range(16)] and got[3] == [None] * 4 + [7.0] + [None] * 11
    assert 4 not in got and np.allclose(got[5], np.arange(16) + 2)


def test_background_without_activation_frames(spark):
    values = [100.0, 1.0, 2.0, 100.0, 3.0, 4.0, 100.0, 5.0, 6.0]
    rows = [(k, f, v) for k in (0, 1) for f, v in enumerate(values)]
    got = windows.sliding_background(spark.createDataFrame(rows, "p int, frame int, adu double"), 1, ["p"], descriptor="011").where("p = 1").orderBy("frame").collect()
    assert [r.background for r in got] == [1.0, 1.5, 2.0, 2.5, 3.0, 4.0, 4.5, 5.0, 5.5]


def test_unknown_movies_are_refused(spark, tmp_path):
    from glintloom.sources import movies

    (tmp_path / "a.xyz").write_bytes(b"1")
    with pytest.raises(ValueError, match="not known"):
        movies.read_frames(spark, str(tmp_path / "a.xyz"))
    assert movies.read_frames(spark, str(tmp_path)).count() == 0
