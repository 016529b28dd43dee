"""Trackers of streams with keyed state and timers.

Rows of a movie wait in a list state until the watermark has passed their frame; then
the frame is whole and is tracked, in order. So rows may come late and out of order
within the watermark, and a frame may be spread over micro-batches. What stays is the
rows of the frames that still wait and the live tracks: a track leaves after max_gap
frames, and a timer clears a movie whose frames have stopped.

Needs the RocksDB state store (see use_rocksdb) and a stream with event times and a
watermark from with_frame_time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from glintloom.operators.track import TrackState, follow

_WAITING = "frame int, loc_id long, x double, y double, sum double"
_TRACKS = "id long, w double, wx double, wy double, age long"
_PLACE = "last int, next_id long"


def use_rocksdb(spark: SparkSession) -> None:
    """Sets the state store that keyed list states and timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def with_frame_time(locs: DataFrame, delay_frames: int = 10) -> DataFrame:
    """locs with event_time and a watermark of delay_frames frames. Frame k is second k + 1 after the epoch, because watermarks begin at 0 and what is not later is late."""
    return locs.withColumn("event_time", F.timestamp_seconds(F.col("frame") + 1)).withWatermark("event_time", f"{delay_frames} seconds")


class _Frames(StatefulProcessor):
    """Collects rows until their frame is whole and hands the frames over in order."""

    def __init__(self, out: T.StructType, radius: float, max_gap: int, dataset: str) -> None:
        self.out, self.radius, self.max_gap, self.dataset = out, radius, max_gap, dataset

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)
        self.tracks = handle.getListState("tracks", _TRACKS)
        self.place = handle.getValueState("place", _PLACE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self.place.get()[0] if self.place.exists() else None
        frames: set[int] = set()
        for chunk in rows:
            if last is not None:
                chunk = chunk[chunk["frame"] > last]
            if len(chunk):
                total = chunk["sum"] if "sum" in chunk else pd.Series(np.nan, index=chunk.index)
                self.waiting.appendList([(int(f), int(i), float(x), float(y), float(s)) for f, i, x, y, s in zip(chunk["frame"], chunk["loc_id"], chunk["x"], chunk["y"], total, strict=True)])
                frames |= set(chunk["frame"].tolist())
        for f in frames:
            self.handle.registerTimer((int(f) + 1) * 1000)
            # when all tracks of this frame are over
            self.handle.registerTimer((int(f) + self.max_gap + 2) * 1000)
        yield pd.DataFrame({f.name: pd.Series(dtype=f.dataType.simpleString().replace("bigint", "int64")) for f in self.out.fields})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # a timer is over once the watermark has reached it, and so is every frame up to there
        until = timerValues.getCurrentWatermarkInMs() // 1000 - 1
        rows = pd.DataFrame(list(self.waiting.get()) if self.waiting.exists() else [], columns=["frame", "loc_id", "x", "y", "sum"])
        ready = rows[rows["frame"] <= until].sort_values(["frame", "loc_id"], kind="stable")
        last, next_id = self.place.get() if self.place.exists() else (None, 0)
        live = TrackState()
        if self.tracks.exists():
            live.ids, live.w, live.wx, live.wy, live.age = (np.array(c) for c in zip(*self.tracks.get(), strict=True))
        live.next_id = next_id
        out = []
        for f, part in ready.groupby("frame"):
            live.pass_frames((f - last - 1) if last is not None else 0, self.max_gap)
            out.append(self._frame(live, int(f), part))
            last = int(f)
        if last is not None and until > last:
            # frames without rows up to the watermark; how many there were must not be counted again
            live.pass_frames(until - last, self.max_gap)
            last = int(until)
        rest = rows[rows["frame"] > until]
        self.waiting.put([tuple(r) for r in rest.astype(object).itertuples(index=False)]) if len(rest) else self.waiting.clear()
        if len(live.ids):
            self.tracks.put([(int(i), float(w), float(a), float(b), int(g)) for i, w, a, b, g in zip(live.ids, live.w, live.wx, live.wy, live.age, strict=True)])
        else:
            self.tracks.clear()
        if last is not None:
            self.place.update((int(last), int(live.next_id)))
        if out:
            found = pd.concat(out, ignore_index=True)
            found.insert(0, self.dataset, key[0])
            yield found[[f.name for f in self.out.fields]]
        else:
            yield pd.DataFrame({f.name: pd.Series(dtype=f.dataType.simpleString().replace("bigint", "int64")) for f in self.out.fields})

    def _frame(self, live: TrackState, f: int, part: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def close(self) -> None:
        pass


class _Tracks(_Frames):
    def _frame(self, live: TrackState, f: int, part: pd.DataFrame) -> pd.DataFrame:
        total = part["sum"].to_numpy(float)
        weight = np.where(np.isnan(total), 1.0, 1.0 + np.sqrt(np.where(np.isnan(total), 0.0, total)))
        ids = live.frame(part["x"].to_numpy(float), part["y"].to_numpy(float), weight, self.radius, self.max_gap)
        return pd.DataFrame({"frame": np.full(len(part), f, np.int32), "loc_id": part["loc_id"].to_numpy(np.int64), "track_id": ids})


class _Fiducials(_Frames):
    """The live tracks are the fiducials; wx and wy are their places and w is 1."""

    def __init__(self, *settings, reference_frame: int) -> None:
        super().__init__(*settings)
        self.reference_frame = reference_frame

    def _frame(self, live: TrackState, f: int, part: pd.DataFrame) -> pd.DataFrame:
        x, y = part["x"].to_numpy(float), part["y"].to_numpy(float)
        if f == self.reference_frame:
            live.ids, live.w, live.wx, live.wy, live.age = np.arange(len(x)), np.ones(len(x)), x.copy(), y.copy(), np.zeros(len(x), np.int64)
            out = np.arange(len(x), dtype=np.int64)
        else:
            live.age = live.age + 1
            out = follow(live.wx, live.wy, live.age, live.ids, x, y, self.radius)
            live.pass_frames(0, self.max_gap)
        return pd.DataFrame({"frame": np.full(len(part), f, np.int32), "loc_id": part["loc_id"].to_numpy(np.int64), "fiducial_id": out.astype(np.int32)})


def _run(locs: DataFrame, processor: type[_Frames], column: str, radius: float, max_gap: int, **more) -> DataFrame:
    kind = locs.schema["dataset_id"].dataType.simpleString()
    out = T.StructType.fromDDL(f"dataset_id {kind}, frame int, loc_id long, {column}")
    return locs.groupBy("dataset_id").transformWithStateInPandas(statefulProcessor=processor(out, radius, max_gap, "dataset_id", **more), outputStructType=out, outputMode="Append", timeMode="EventTime")


def tracked_stream(locs: DataFrame, radius: float, max_gap: int = 0) -> DataFrame:
    """(dataset_id, frame, loc_id, track_id) of a stream with event_time and a watermark; equals track.tracker on the rows that are not too late.

    A frame comes out when the watermark has passed it. Rows of frames that are already
    out are dropped.
    """
    return _run(locs, _Tracks, "track_id long", radius, max_gap)


def fiducial_stream(locs: DataFrame, radius: float, max_gap: int, reference_frame: int = 0) -> DataFrame:
    """(dataset_id, frame, loc_id, fiducial_id) of a stream, as track.fiducials makes it from a reference frame that is the first or follows before any other use; frames before it have -1."""
    return _run(locs, _Fiducials, "fiducial_id int", radius, max_gap, reference_frame=reference_frame)
