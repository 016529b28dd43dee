"""Tracks and fiducials by components against one serial pass over each movie."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from glintloom.operators import track

SCHEMA = "dataset_id int, frame int, loc_id long, x double, y double, sum double"


def serial(rows, radius, max_gap, descriptor="1", analysed_empty=True):
    out = {}
    for d in {r[0] for r in rows}:
        mine = sorted(r for r in rows if r[0] == d)
        present = sorted({r[1] for r in mine})
        live = track.TrackState()
        for f in range(present[0], present[-1] + 1) if analysed_empty else present:
            here = [r for r in mine if r[1] == f]
            if descriptor[f % len(descriptor)] == "0":
                out |= {r[:3]: -1 for r in here}
                continue
            x, y, s = (np.array([r[k] for r in here], float) for k in (3, 4, 5))
            out |= {r[:3]: int(i) for r, i in zip(here, live.frame(x, y, 1 + np.sqrt(s), radius, max_gap), strict=True)}
    return out


def made(seed, n, size, frames=25):
    rng = np.random.default_rng(seed)
    rows = []
    for d in (0, 7):
        spots = rng.uniform(0, size, (n, 2))
        for f in range(frames):
            if f in (9, 10, 11, 12):
                continue
            on = np.flatnonzero(rng.random(n) < 0.6)
            places = np.vstack([spots[on] + rng.normal(0, 0.15, (len(on), 2)), rng.uniform(0, size, (2, 2))])
            rows += [(d, f, i, float(a), float(b), float(rng.uniform(1, 50))) for i, (a, b) in enumerate(places)]
    return rows


@pytest.mark.parametrize(("size", "gap", "descriptor", "empty", "together"), [(40, 0, "1", True, 0), (6, 1, "1", True, 0), (12, 1, "1210", True, 0), (12, 2, "1", False, 0), (12, 1, "012", False, 9999)])
def test_tracks_equal_a_serial_pass(spark, monkeypatch, size, gap, descriptor, empty, together):
    monkeypatch.setattr(track, "TOGETHER", together)
    rows = made(size + gap, 14, size)
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {(r.dataset_id, r.frame, r.loc_id): r.track_id for r in track.tracker(table, 0.5, gap, descriptor, empty).collect()}
    assert got == serial(rows, 0.5, gap, descriptor, empty)


def test_movies_are_cut_into_buckets(spark, monkeypatch):
    monkeypatch.setattr(track, "TOGETHER", 100)
    table = spark.createDataFrame(made(3, 20, 90), SCHEMA)
    points = table.withColumn("t", F.col("frame").cast("long"))
    assert track._components(points, 1.0, 1).select("dataset_id", "bucket").distinct().count() > 10


def serial_fiducials(rows, radius, max_gap, reference):
    out = {}
    for d in {r[0] for r in rows}:
        mine = sorted(r for r in rows if r[0] == d)
        first = [r for r in mine if r[1] == reference]
        live = [[k, r[3], r[4], 0] for k, r in enumerate(first)]
        for f in range(mine[0][1], mine[-1][1] + 1):
            here = [r for r in mine if r[1] == f]
            out |= {r[:3]: -1 for r in here}
            for one in live:
                one[3] += 1
                near = sorted(((r[3] - one[1]) ** 2 + (r[4] - one[2]) ** 2, k) for k, r in enumerate(here))
                if near and near[0][0] <= radius * radius:
                    hit = here[near[0][1]]
                    one[1:] = [hit[3], hit[4], 0]
                    out[hit[:3]] = one[0]
            live = [one for one in live if one[3] <= max_gap]
    return out


@pytest.mark.parametrize(("size", "gap", "reference"), [(40, 5, 0), (5, 1, 0), (20, 2, 3)])
@pytest.mark.parametrize("together", [0, 9999])
def test_fiducials_equal_a_serial_pass(spark, monkeypatch, size, gap, reference, together):
    monkeypatch.setattr(track, "TOGETHER", together)
    rows = made(size + gap, 12, size)
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {(r.dataset_id, r.frame, r.loc_id): r.fiducial_id for r in track.fiducials(table, 0.5, gap, reference).collect()}
    assert got == serial_fiducials(rows, 0.5, gap, reference)


def test_empty_tables(spark):
    table = spark.createDataFrame([], SCHEMA)
    assert track.tracker(table, 0.5).columns[-2:] == ["category", "track_id"] and track.tracker(table, 0.5).count() == 0
    assert track.fiducials(table, 0.5, 0).count() == 0
