"""Text sources and sinks: peak lists, transforms, CSV export, drift files, parameters."""

from __future__ import annotations

import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_peaks(spark: SparkSession, path: str) -> DataFrame:
    """(x, y, height, background) of a space-separated list."""
    return spark.read.csv(path, sep=" ", schema="x double, y double, height double, background double")


def export_rows(rows: DataFrame, order: list[str], keys: list[str]) -> DataFrame:
    """rows as text: index within keys, then the columns in the order of their names; floats with three decimals."""
    from glintloom.operators.aggregate import running_index

    indexed = running_index(rows, order, keys)
    text = lambda c: F.format_string("%.3f", c) if dict(rows.dtypes)[c] in ("double", "float") else F.col(c)
    return indexed.select("index", *[text(c).alias(c) for c in sorted(rows.columns)])


def write_csv(rows: DataFrame, path: str, order: list[str], keys: list[str]) -> None:
    export_rows(rows, order, keys).write.option("header", True).csv(path)


def drift_lines(drift: DataFrame) -> DataFrame:
    """Drift as text: frames from 1 and negated offsets, tab-separated."""
    return drift.select(F.format_string("%d\t%.3f\t%.3f\t%.3f", (F.col("frame") + 1).cast("int"), -F.col("dx"), -F.col("dy"), -F.col("dz")).alias("value"))


def read_parameters(text: str) -> dict[str, object]:
    """Typed values of a parameter file: <settings><name type="int">3</name> ..."""
    kinds = {"int": int, "float": float, "int-array": lambda t: [int(x) for x in t.split(",")], "float-array": lambda t: [float(x) for x in t.split(",")]}
    return {e.tag: kinds.get(e.get("type", "string"), str)((e.text or "").strip()) for e in ET.fromstring(text)}


def write_parameters(values: dict[str, object]) -> str:
    root = ET.Element("settings")
    for name, v in values.items():
        kind = "int" if isinstance(v, int) else "float" if isinstance(v, float) else f"{'int' if all(isinstance(x, int) for x in v) else 'float'}-array" if isinstance(v, list) else "string"
        e = ET.SubElement(root, name, type=kind)
        e.text = ",".join(map(str, v)) if isinstance(v, list) else str(v)
    return ET.tostring(root, encoding="unicode")
