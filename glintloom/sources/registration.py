"""Text files of stack registration: for each frame three points before and after, as tables of transforms."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from glintloom.operators.chained import CELLS

#: Words of the file format.
_RECORD = re.compile(r"^(AFFINE|RIGID_BODY)\s*\n\s*Source img: (\d+) Target img: (\d+).*\n((?:.*\n){3}).*\n((?:.*\n?){3})", re.M)
SCHEMA = "path string, frame int, target int, kind string, " + ", ".join(f"{c} double" for c in CELLS)


def matrix_of(kind: str, source: np.ndarray, target: np.ndarray) -> list[float]:
    """The six numbers of the transform that carries the source points to the target points: the turn of the first two and a shift, or the affine map of all three."""
    if kind == "AFFINE":
        return np.linalg.solve(np.column_stack([source, np.ones(3)]), target).ravel().tolist()
    turn = math.atan2(*(source[0] - source[1])[::-1]) - math.atan2(*(target[0] - target[1])[::-1])
    c, s = math.cos(turn), math.sin(turn)
    m = np.array([[c, -s], [s, c]])
    return [*m.ravel().tolist(), *(target[0] - source[0] @ m).tolist()]


def parse(text: str, image_scale: float = 4.0) -> Iterator[tuple]:
    """(frame, target, kind, m00 .. m21) of each record, frames from 0; coordinates are divided by image_scale."""
    for kind, source, target, before, after in _RECORD.findall(text.replace("\r", "")):
        points = [np.array([[float(v) for v in line.split("\t")[:2]] for line in part.strip("\n").split("\n")]) / image_scale for part in (before, after)]
        yield (int(source) - 1, int(target) - 1, kind, *matrix_of(kind, *points))


def read_registrations(spark: SparkSession, path: str, image_scale: float = 4.0) -> DataFrame:
    """Records of all files at path. A file is a few lines for each frame and one task's input; chained.to_target makes transforms to the target."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for name, data in zip(files["path"], files["content"], strict=True):
                rows = [(name, *r) for r in parse(bytes(data).decode(), image_scale)]
                yield pd.DataFrame(rows, columns=["path", "frame", "target", "kind", *CELLS])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, SCHEMA)
