"""Binary molecule lists: a 16-byte header and packed records of 18 fields, with metadata behind them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of a record in order, 4 bytes each.
RECORD = np.dtype([(n, "<f4") for n in ("x", "y", "xc", "yc", "h", "a", "w", "phi", "ax", "bg", "i")] + [(n, "<i4") for n in ("c", "fi", "fr", "tl", "lk")] + [(n, "<f4") for n in ("z", "zc")])
SCHEMA = "path string, " + ", ".join(f"{n} {'float' if RECORD[n].kind == 'f' else 'int'}" for n in RECORD.names)
_HEADER = 16


def read_molecules(spark: SparkSession, path: str, good_only: bool = False) -> DataFrame:
    """All records of the files at path; good_only leaves out category 9. One file is one task's input."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for name, data in zip(files["path"], files["content"], strict=True):
                n = int(np.frombuffer(data, "<i4", 1, 12)[0])
                records = np.frombuffer(data, RECORD, n, _HEADER)
                for start in range(0, n, 100_000):
                    part = records[start : start + 100_000]
                    yield pd.DataFrame({"path": name, **{k: part[k].astype(RECORD[k].newbyteorder("=")) for k in RECORD.names}})

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, SCHEMA)
    return rows.where("c <> 9") if good_only else rows


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(path, metadata): the text behind the records, empty if there is none."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            tails = [bytes(d)[_HEADER + int(np.frombuffer(d, "<i4", 1, 12)[0]) * RECORD.itemsize :] for d in files["content"]]
            yield pd.DataFrame({"path": files["path"], "metadata": [t.decode("utf-8", "replace").strip("\0 \n") for t in tails]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, "path string, metadata string")


def to_molecules(locs: DataFrame, pixel_size: float) -> DataFrame:
    """Localizations as records: one pixel added to x and y, z and widths in nm, frames from 1."""
    has = set(locs.columns)
    pick = lambda c, d: F.coalesce(F.col(c).cast("double"), F.lit(d)) if c in has else F.lit(d)
    wx = 2 * pick("xsigma", 150.0 / pixel_size) * pixel_size
    wy = 2 * F.col("ysigma") * pixel_size if "ysigma" in has else wx
    x, y, z = F.col("x") + 1, F.col("y") + 1, pick("z", 0.0) * 1000
    values = {
        "x": x, "y": y, "xc": x, "yc": y, "h": pick("height", 100.0), "a": pick("sum", 10000.0), "w": F.sqrt(wx * wy), "phi": F.lit(0.0), "ax": wy / wx, "bg": pick("background", 0.0), "i": pick("error", 10000.0),
        "c": pick("category", 1.0), "fi": pick("status", 1.0), "fr": F.col("frame") + 1, "tl": pick("track_length", 1.0), "lk": pick("track_id", -1.0), "z": z, "zc": z,
    }
    return locs.select(*[v.cast("float" if RECORD[k].kind == "f" else "int").alias(k) for k, v in values.items()])


def from_molecules(records: DataFrame, pixel_size: float) -> DataFrame:
    """Records as localizations, the other way round."""
    w, ax = F.col("w").cast("double"), F.col("ax").cast("double")
    return records.select(
        (F.col("fr") - 1).alias("frame"), (F.col("x").cast("double") - 1).alias("x"), (F.col("y").cast("double") - 1).alias("y"), (F.col("z").cast("double") / 1000).alias("z"),
        (0.5 * F.sqrt(w * w / ax) / pixel_size).alias("xsigma"), (0.5 * F.sqrt(w * w * ax) / pixel_size).alias("ysigma"), F.col("h").cast("double").alias("height"), F.col("bg").cast("double").alias("background"), F.col("c").alias("category"),
    )


def encode_molecules(records: DataFrame, key: str) -> DataFrame:
    """(key, content): one binary molecule list for each value of key, which bounds its size."""

    def encode(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["fr", "x", "y"], kind="stable")
        packed = np.zeros(len(pdf), RECORD)
        for n in RECORD.names:
            packed[n] = pdf[n].to_numpy()
        head = b"M425" + np.array([int(pdf["fr"].max()) if len(pdf) else 0, 6, len(pdf)], "<i4").tobytes()
        return pd.DataFrame({key: pdf[key].iloc[:1], "content": [head + packed.tobytes()]})

    return records.groupBy(key).applyInPandas(encode, f"{key} {records.schema[key].dataType.simpleString()}, content binary")
