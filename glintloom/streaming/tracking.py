"""Streaming twins: tracking with state, and windowed grid counts with a watermark.

Frames are event times: frame k is second k after the epoch. Rows that come after the
watermark are dropped.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from glintloom.operators.track import TrackState


def with_event_time(locs: DataFrame, delay_frames: int = 10) -> DataFrame:
    """locs with event_time and a watermark of delay_frames frames."""
    return locs.withColumn("event_time", F.timestamp_seconds("frame")).withWatermark("event_time", f"{delay_frames} seconds")


def stream_tracker(locs: DataFrame, radius: float, max_gap: int = 0) -> DataFrame:
    """(dataset_id, frame, loc_id, track_id) of a stream whose micro-batches bring whole frames in order.

    The state of a dataset is its live tracks and the last frame seen; it equals the
    batch tracker on the same frames. Frames at or before the last one are dropped.
    """

    def run(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, live = pickle.loads(state.get[0]) if state.exists else (None, TrackState())
        rows = pd.concat(list(chunks), ignore_index=True)
        rows = rows[rows["frame"] > last] if last is not None else rows
        rows = rows.sort_values(["frame", "loc_id"], kind="stable")
        out = []
        if len(rows):
            for f in range(int(rows["frame"].iloc[0]) if last is None else last + 1, int(rows["frame"].iloc[-1]) + 1):
                here = rows[rows["frame"] == f]
                weight = 1 + np.sqrt(here["sum"].to_numpy(float)) if "sum" in here else np.ones(len(here))
                ids = live.frame(here["x"].to_numpy(float), here["y"].to_numpy(float), weight, radius, max_gap)
                out.append(pd.DataFrame({"dataset_id": key[0], "frame": f, "loc_id": here["loc_id"].to_numpy(), "track_id": ids}))
            last = int(rows["frame"].iloc[-1])
        state.update((pickle.dumps((last, live)),))
        yield pd.concat(out, ignore_index=True) if out else pd.DataFrame({"dataset_id": [], "frame": [], "loc_id": [], "track_id": []})

    kind = locs.schema["dataset_id"].dataType.simpleString()
    return locs.groupBy("dataset_id").applyInPandasWithState(run, f"dataset_id {kind}, frame int, loc_id long, track_id long", "state binary", "append", GroupStateTimeout.NoTimeout)


def stream_counts(locs: DataFrame, frames: int, slide: int | None = None) -> DataFrame:
    """(start, category, n) over windows of frames: tumbling, or sliding by `slide`."""
    window = F.window("event_time", f"{frames} seconds", f"{slide or frames} seconds")
    return locs.groupBy(window.alias("w"), "category").agg(F.count("*").alias("n")).select(F.unix_timestamp("w.start").cast("int").alias("start"), "category", "n")


def stream_sessions(locs: DataFrame, gap: int) -> DataFrame:
    """(category, start, stop, n): runs of frames of a category without more than `gap` frames between two localizations; they come out when the watermark has passed them."""
    window = F.session_window("event_time", f"{gap} seconds")
    counted = locs.groupBy(window.alias("w"), "category").agg(F.count("*").alias("n"), F.min("frame").alias("start"), F.max("frame").alias("stop"))
    return counted.select("category", "start", "stop", "n")
