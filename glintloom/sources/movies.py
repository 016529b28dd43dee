"""Movies as frames: raw 16-bit stacks with a text header, FITS, SPE and plain TIFF files.

A file is read by one task; its frames are given out one by one, so memory holds one
file and one frame. pixels() explodes frames to (movie, frame, y, x, adu).
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAMES = "movie string, frame int, height int, width int, pixels binary"
#: Extensions that are understood, and the places of SPE header fields.
EXTENSIONS = (".dax", ".fits", ".spe", ".tif", ".tiff")
_SPE = {"width": 42, "height": 656, "frames": 1446, "mode": 108, "data": 4100}
_SPE_TYPES = {0: "<f4", 1: "<u4", 2: "<i2", 3: "<u2"}


def dax_header(text: str) -> tuple[int, int, int, str]:
    """(height, width, frames, dtype) from the text beside a raw stack; 256 x 256 if it does not say."""
    size = re.search(r"frame dimensions = (\d+) x (\d+)", text)
    frames = re.search(r"number of frames = (\d+)", text)
    width, height = (int(size[1]), int(size[2])) if size else (256, 256)
    return height, width, int(frames[1]) if frames else -1, ">u2" if "big endian" in text else "<u2"


def dax_frames(data: bytes, header: str) -> Iterator[np.ndarray]:
    height, width, n, kind = dax_header(header)
    whole = np.frombuffer(data, kind, len(data) // 2)
    n = len(whole) // (height * width) if n < 0 else n
    for k in range(n):
        yield whole[k * height * width : (k + 1) * height * width].reshape(height, width).astype(np.int32)


def fits_frames(data: bytes) -> Iterator[np.ndarray]:
    """16-bit FITS with an offset of 32768; headers are blocks of 2880 bytes."""
    cards, at = {}, 0
    while "END" not in cards:
        block = data[at : at + 2880].decode("ascii")
        at += 2880
        for card in (block[i : i + 80] for i in range(0, 2880, 80)):
            cards[card[:8].strip()] = card[10:].split("/")[0].strip()
    if int(cards["BITPIX"]) != 16:
        raise ValueError("only 16-bit FITS files are supported")
    width, height, n = int(cards["NAXIS1"]), int(cards["NAXIS2"]), int(cards.get("NAXIS3", 1))
    whole = np.frombuffer(data, ">i2", width * height * n, at).astype(np.int32) + int(float(cards.get("BZERO", 0)))
    yield from whole.reshape(n, height, width)


def spe_frames(data: bytes) -> Iterator[np.ndarray]:
    width, height = (struct.unpack_from("<H", data, _SPE[k])[0] for k in ("width", "height"))
    n, mode = struct.unpack_from("<I", data, _SPE["frames"])[0], struct.unpack_from("<H", data, _SPE["mode"])[0]
    yield from np.frombuffer(data, _SPE_TYPES[mode], width * height * n, _SPE["data"]).reshape(n, height, width)


def tiff_frames(data: bytes) -> Iterator[np.ndarray]:
    """Pages of an uncompressed TIFF with one sample of 8, 16 or 32 bits; compressed files are refused."""
    order = "<" if data[:2] == b"II" else ">"
    at = struct.unpack_from(order + "I", data, 4)[0]
    while at:
        n = struct.unpack_from(order + "H", data, at)[0]
        tags = {}
        for k in range(n):
            tag, kind, count, _ = struct.unpack_from(order + "HHII", data, at + 2 + 12 * k)
            code, size = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4)}.get(kind, ("B", 1))
            place = at + 10 + 12 * k if count * size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * k)[0]
            tags[tag] = struct.unpack_from(f"{order}{count}{code}", data, place) if kind in (1, 3, 4) else None
        if tags.get(259, (1,))[0] != 1:
            raise ValueError("compressed TIFF files are not supported")
        kind = f"{order}{'f' if tags.get(339, (1,))[0] == 3 else 'u'}{tags.get(258, (8,))[0] // 8}"
        raw = b"".join(data[a : a + b] for a, b in zip(tags[273], tags[279], strict=True))
        yield np.frombuffer(raw, kind, tags[256][0] * tags[257][0]).reshape(tags[257][0], tags[256][0])
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Frames of all movies below path, by extension. Pixels are packed 32-bit integers.

    In a folder other files are left out; a path that names one file of an unknown kind is refused.
    """
    last = path.rstrip("/").rsplit("/", 1)[-1].lower()
    if re.fullmatch(r"[^*?{\[]+\.[a-z]\w*", last) and not last.endswith(EXTENSIONS):
        raise ValueError(f"movies of this kind are not known: {path}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    name = F.lower("path")
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    headers = files.where(name.endswith(".inf")).select(stem.alias("stem"), F.col("content").cast("string").alias("header"))
    movies = files.where(F.expr(" OR ".join(f"lower(path) LIKE '%{e}'" for e in EXTENSIONS))).withColumn("stem", stem).join(headers, "stem", "left").drop("stem")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for movie, data, header in zip(batch["path"], batch["content"], batch["header"], strict=True):
                end = movie.lower().rsplit(".", 1)[1]
                frames = dax_frames(data, header or "") if end == "dax" else fits_frames(data) if end == "fits" else spe_frames(data) if end == "spe" else tiff_frames(data)
                for k, image in enumerate(frames):
                    yield pd.DataFrame({"movie": [movie], "frame": [k], "height": [image.shape[0]], "width": [image.shape[1]], "pixels": [np.ascontiguousarray(image, "<i4").tobytes()]})

    return movies.select("path", "content", "header").mapInPandas(decode, FRAMES)


def pixels(frames: DataFrame) -> DataFrame:
    """(movie, frame, y, x, adu) of every pixel."""

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                y, x = np.divmod(np.arange(r.height * r.width, dtype=np.int32), r.width)
                yield pd.DataFrame({"movie": r.movie, "frame": r.frame, "y": y, "x": x, "adu": np.frombuffer(r.pixels, "<i4")})

    return frames.mapInPandas(explode, "movie string, frame int, y int, x int, adu int")


def encode_dax(frames: DataFrame) -> DataFrame:
    """(movie, content, header): raw stacks, clipped to 16 bits, with their text headers. One movie is one group."""

    def encode(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        data = b"".join(np.clip(np.frombuffer(p, "<i4"), 0, 65535).astype("<u2").tobytes() for p in pdf["pixels"])
        first = pdf.iloc[0]
        header = f"frame dimensions = {first['width']} x {first['height']}\nnumber of frames = {len(pdf)}\nlittle endian\n"
        return pd.DataFrame({"movie": [first["movie"]], "content": [data], "header": [header]})

    return frames.groupBy("movie").applyInPandas(encode, "movie string, content binary, header string")
