"""A data source of movie frames, for batches and for streams of movies that still grow.

Raw 16-bit stacks below a folder are read frame by frame: each task reads the bytes of
its own frames, so one long movie is shared by many tasks. As a stream the offset is the
number of whole frames of each movie; a restart goes on from the checkpoint's offset. A
frame that is written only in part waits until it is whole.

    spark.dataSource.register(MovieFrames)
    spark.readStream.format("movie_frames").load(folder)

Options: path (a folder or one .dax file, on any file system that pyarrow opens) and
frames_per_task (64).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from glintloom.sources.movies import FRAMES, dax_header

FRAMES_PER_TASK = 64
_TOGETHER = 16


@dataclass
class FrameRange(InputPartition):
    """Frames start .. stop - 1 of one movie."""

    movie: str
    start: int
    stop: int
    height: int
    width: int
    kind: str


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def movies_below(path: str) -> dict[str, tuple[int, int, int, str]]:
    """(whole frames, height, width, dtype) of each raw stack at or below path; sizes come from the text beside it, the number of frames from the file's length."""
    files, at = _opened(path)
    info = files.get_file_info(at)
    found = [info] if info.type == fs.FileType.File else files.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
    out = {}
    for f in found:
        if f.type == fs.FileType.File and f.path.lower().endswith(".dax"):
            header = f.path[:-4] + ".inf"
            text = files.open_input_stream(header).read().decode() if files.get_file_info(header).type == fs.FileType.File else ""
            height, width, _, kind = dax_header(text)
            out[f.path] = (f.size // (2 * height * width), height, width, kind)
    return out


def ranges(path: str, start: dict[str, int], stop: dict[str, int] | None, each: int) -> list[FrameRange]:
    """Pieces of at most `each` frames between two offsets; without stop up to what is there."""
    out = []
    for movie, (n, height, width, kind) in sorted(movies_below(path).items()):
        end = n if stop is None else min(n, stop.get(movie, 0))
        out += [FrameRange(movie, k, min(end, k + each), height, width, kind) for k in range(start.get(movie, 0), end, each)]
    return out


def read_range(part: FrameRange, path: str) -> Iterator[pa.RecordBatch]:
    """The frames of a piece, as batches of a few frames; pixels are packed 32-bit whole numbers."""
    files, _ = _opened(path)
    size = part.height * part.width
    with files.open_input_file(part.movie) as f:
        for k in range(part.start, part.stop, _TOGETHER):
            n = min(_TOGETHER, part.stop - k)
            f.seek(2 * size * k)
            data = f.read(2 * size * n)
            if len(data) < 2 * size * n:
                raise OSError(f"{part.movie} has become shorter than frame {k + n}")
            whole = np.frombuffer(data, part.kind).reshape(n, size).astype("<i4")
            columns = [pa.array([part.movie] * n), pa.array(range(k, k + n), pa.int32()), pa.array([part.height] * n, pa.int32()), pa.array([part.width] * n, pa.int32()), pa.array([image.tobytes() for image in whole], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["movie", "frame", "height", "width", "pixels"])


class _Batch(DataSourceReader):
    def __init__(self, path: str, each: int) -> None:
        self.path, self.each = path, each

    def partitions(self) -> list[FrameRange]:
        return ranges(self.path, {}, None, self.each) or [FrameRange("", 0, 0, 1, 1, "<u2")]

    def read(self, partition: FrameRange) -> Iterator[pa.RecordBatch]:
        return read_range(partition, self.path) if partition.stop > partition.start else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, path: str, each: int) -> None:
        self.path, self.each = path, each

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {movie: n for movie, (n, *_) in movies_below(self.path).items() if n}

    def partitions(self, start: dict, end: dict) -> list[FrameRange]:
        return ranges(self.path, start, end, self.each)

    def read(self, partition: FrameRange) -> Iterator[pa.RecordBatch]:
        return read_range(partition, self.path)

    def commit(self, end: dict) -> None:
        """Movies stay; there is nothing to give back."""


class MovieFrames(DataSource):
    """The source "movie_frames"; see the module."""

    @classmethod
    def name(cls) -> str:
        return "movie_frames"

    def schema(self) -> str:
        return FRAMES

    def _settings(self) -> tuple[str, int]:
        return self.options["path"], int(self.options.get("frames_per_task", FRAMES_PER_TASK))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(*self._settings())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(*self._settings())


def register(spark: SparkSession) -> None:
    """Makes the source known to a session."""
    spark.dataSource.register(MovieFrames)
