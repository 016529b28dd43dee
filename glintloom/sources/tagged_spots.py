"""Tagged-spot files: length-prefixed records of numbered fields, and a list record behind them.

The file begins with a number and the place of the list record. Records have no marks
to start from, so a pass over the length prefixes alone notes where every RECORDS-th
one begins; tasks then decode the records between two notes, each reading its own
bytes. Sinks write one part a task, and a part can be read by itself.

    spark.dataSource.register(TaggedSpots)
    spark.read.format("tagged_spots").load(path)
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from glintloom.sources.frame_stream import _opened

#: Number and kind of each field of a spot (v: whole number, f: 32-bit float), and of the list record (s: text).
SPOT = {
    "molecule": (1, "v"), "channel": (2, "v"), "frame": (3, "v"), "slice": (4, "v"), "pos": (5, "v"), "flag": (6, "v"), "x": (7, "f"), "y": (8, "f"), "z": (9, "f"), "intensity": (10, "f"), "background": (11, "f"), "width": (12, "f"), "a": (13, "f"), "theta": (14, "f"),
    "location_units": (17, "v"), "intensity_units": (18, "v"), "x_original": (101, "f"), "y_original": (102, "f"), "z_original": (103, "f"), "x_precision": (104, "f"), "y_precision": (105, "f"), "z_precision": (106, "f"), "x_position": (107, "v"), "y_position": (108, "v"),
}
SPOT_LIST = {
    "application_id": (1, "v"), "name": (2, "s"), "filepath": (3, "s"), "uid": (4, "v"), "nr_pixels_x": (5, "v"), "nr_pixels_y": (6, "v"), "pixel_size": (7, "f"), "nr_spots": (8, "v"), "box_size": (17, "v"), "nr_channels": (18, "v"), "nr_frames": (19, "v"), "nr_slices": (20, "v"), "nr_pos": (21, "v"),
    "location_units": (22, "v"), "intensity_units": (23, "v"), "fit_mode": (24, "v"), "is_track": (25, "v"),
}
_HEAD = 12
RECORDS = 20_000
SCHEMA = "path string, " + ", ".join(f"{n} {'int' if kind == 'v' else 'float'}" for n, (_, kind) in SPOT.items())


def varint(n: int) -> bytes:
    """A whole number in groups of seven bits, the lowest first; negative ones as 64 bits."""
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    """(number, place behind it)."""
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def encode(values: dict, fields: dict[str, tuple[int, str]]) -> bytes:
    """A record with its length before it; values that are None are left out."""
    body = b""
    for name, (number, kind) in fields.items():
        v = values.get(name)
        if v is None:
            continue
        if kind == "v":
            body += varint(number << 3) + varint(int(v))
        elif kind == "f":
            body += varint(number << 3 | 5) + struct.pack("<f", v)
        else:
            body += varint(number << 3 | 2) + varint(len(v.encode())) + v.encode()
    return varint(len(body)) + body


def decode(data: bytes, at: int, end: int, fields: dict[str, tuple[int, str]]) -> dict:
    """Values of the record at data[at:end]; fields that are not known are passed over."""
    names = {number: name for name, (number, _) in fields.items()}
    out: dict = {}
    while at < end:
        tag, at = read_varint(data, at)
        kind = tag & 7
        if kind == 0:
            v, at = read_varint(data, at)
            v = v - (1 << 64) if v >> 63 else v
        elif kind == 5:
            v, at = struct.unpack_from("<f", data, at)[0], at + 4
        elif kind == 1:
            v, at = struct.unpack_from("<d", data, at)[0], at + 8
        elif kind == 2:
            size, at = read_varint(data, at)
            v, at = data[at : at + size].decode("utf-8", "replace"), at + size
        else:
            raise ValueError(f"unknown kind {kind} of a field")
        if tag >> 3 in names:
            out[names[tag >> 3]] = v
    return out


def record_starts(f: pa.NativeFile, end: int, each: int = RECORDS, block: int = 1 << 20) -> list[int]:
    """Places of every each-th record and of the end; only length prefixes are looked at, block by block."""
    starts, at, k, first, data = [], _HEAD, 0, _HEAD, b""
    while at < end:
        if k % each == 0:
            starts.append(at)
        if not first <= at <= first + len(data) - 10:
            f.seek(at)
            first, data = at, f.read(min(block, end - at))
        size, behind = read_varint(data, at - first)
        at, k = first + behind + size, k + 1
    return [*starts, end]


def list_place(f: pa.NativeFile) -> int:
    f.seek(4)
    return struct.unpack(">Q", f.read(8))[0] + _HEAD


def spot_list(path: str) -> dict:
    """The list record of a file."""
    files, at = _opened(path)
    with files.open_input_file(at) as f:
        place = list_place(f)
        f.seek(place)
        data = f.read()
    size, start = read_varint(data, 0)
    return decode(data, start, start + size, SPOT_LIST)


@dataclass
class SpotRange(InputPartition):
    """The bytes of some records of a file."""

    file: str
    start: int
    stop: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, each: int) -> None:
        self.path, self.each = path, each

    def partitions(self) -> list[SpotRange]:
        files, at = _opened(self.path)
        info = files.get_file_info(at)
        names = [at] if info.type == fs.FileType.File else sorted(i.path for i in files.get_file_info(fs.FileSelector(at, recursive=True)) if i.path.endswith(".tsf") and "/_attempts/" not in i.path)
        out = []
        for name in names:
            with files.open_input_file(name) as f:
                starts = record_starts(f, list_place(f), self.each)
            out += [SpotRange(name, a, b) for a, b in zip(starts, starts[1:], strict=False)]
        return out or [SpotRange("", 0, 0)]

    def read(self, partition: SpotRange) -> Iterator[pa.RecordBatch]:
        if partition.stop <= partition.start:
            return
        files, _ = _opened(self.path)
        with files.open_input_file(partition.file) as f:
            f.seek(partition.start)
            data = f.read(partition.stop - partition.start)
        at, rows = 0, []
        while at < len(data):
            size, at = read_varint(data, at)
            rows.append(decode(data, at, at + size, SPOT))
            at += size
        columns = [pa.array([partition.file] * len(rows)), *[pa.array([r.get(n) for r in rows], pa.int32() if kind == "v" else pa.float32()) for n, (_, kind) in SPOT.items()]]
        yield pa.RecordBatch.from_arrays(columns, names=["path", *SPOT])


class TaggedSpots(DataSource):
    """The source "tagged_spots"; options path (a file or a folder of .tsf files) and records_per_task."""

    @classmethod
    def name(cls) -> str:
        return "tagged_spots"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("records_per_task", RECORDS)))


def from_molecules(records: DataFrame, pixel_size: float) -> DataFrame:
    """Molecule records as spots: places and widths in nm, one slice and position; molecules are numbered in the order of frame and place."""
    from glintloom.operators.cluster import numbered_rows

    nm = lambda c: (F.col(c).cast("double") * pixel_size).cast("float")
    spots = records.select(
        F.col("c").alias("channel"), F.col("fr").alias("frame"), F.lit(1).alias("slice"), F.lit(1).alias("pos"), nm("xc").alias("x"), nm("yc").alias("y"), F.col("zc").alias("z"), F.col("a").alias("intensity"), F.col("bg").alias("background"),
        F.col("w").alias("width"), F.col("ax").alias("a"), F.lit(0.0).cast("float").alias("theta"), nm("x").alias("x_original"), nm("y").alias("y_original"), F.col("z").alias("z_original"),
    )
    return numbered_rows(spots, ["frame", "x", "y"], "molecule").withColumn("molecule", F.col("molecule").cast("int"))


def write_spots(spots: DataFrame, path: str, details: dict | None = None) -> list[str]:
    """Writes spots as .tsf files in the folder path, one for each partition, and gives their names.

    details go into the list record of each file, beside its number of spots and
    channels. Tasks write to a folder of attempts; only what a finished task has written
    is moved into place, so a task that runs twice leaves one file.
    """
    details = dict(details or {})
    columns = [c for c in spots.columns if c in SPOT]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        files, at = _opened(path)
        folder = f"{at.rstrip('/')}/_attempts"
        files.create_dir(folder, recursive=True)
        name, n, channels, size = f"{folder}/spots-{uuid.uuid4().hex}.tsf", 0, set(), 0
        with files.open_output_stream(name + ".part") as f:
            f.write(b"\0" * _HEAD)
            for batch in batches:
                rows = batch.to_pylist()
                data = b"".join(encode(r, SPOT) for r in rows)
                f.write(data)
                n, size, channels = n + len(rows), size + len(data), channels | {r.get("channel") for r in rows}
            f.write(encode({"application_id": 1, "nr_slices": 1, "nr_pos": 1, "location_units": 0, "intensity_units": 0, "fit_mode": 1, "is_track": 0, **details, "nr_spots": n, "nr_channels": len(channels)}, SPOT_LIST))
        # the head names the place of the list record, so it is written last, into the file that then gets its name
        with files.open_input_stream(name + ".part") as before, files.open_output_stream(name) as after:
            before.read(_HEAD)
            after.write(struct.pack("<I", 0) + struct.pack(">Q", size))
            while block := before.read(1 << 20):
                after.write(block)
        files.delete_file(name + ".part")
        yield pa.RecordBatch.from_arrays([pa.array([name])], names=["file"])

    files, at = _opened(path)
    out = []
    for r in spots.select(*columns).mapInArrow(run, "file string").collect():  # a name for each file
        out.append(f"{at.rstrip('/')}/{r['file'].rsplit('/', 1)[1]}")
        files.move(r["file"], out[-1])
    return out
