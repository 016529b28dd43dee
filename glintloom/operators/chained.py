"""Transforms between neighbouring frames, chained to transforms to one target frame.

A transform is a row m00 .. m21: (x, y, 1) times a 3 x 2 matrix, so that x' = x m00 +
y m10 + m20 and y' = x m01 + y m11 + m21. Chaining is a running product. It is made as
a scan in three steps that no task needs whole: products within pieces of frames,
products of the pieces before, made the same way, and one product of both.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glintloom.operators.shared import checkpointed

CELLS = ("m00", "m01", "m10", "m11", "m20", "m21")
IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
#: Steps in a piece; a piece of pieces of pieces holds a billion.
PIECE = 1000


def product(a: str, b: str) -> dict[str, Column]:
    """Cells of the transform that applies the one with prefix a first and then the one with prefix b."""
    p, q = (lambda c: F.col(f"{a}{c}")), (lambda c: F.col(f"{b}{c}"))
    out = {}
    for i in (0, 1, 2):
        for j in (0, 1):
            cell = p(f"m{i}0") * q(f"m0{j}") + p(f"m{i}1") * q(f"m1{j}")
            out[f"m{i}{j}"] = cell + q(f"m2{j}") if i == 2 else cell
    return out


def running_products(steps: DataFrame, keys: list[str], order: str = "step") -> DataFrame:
    """(keys, step, m00 .. m21): for each step (0, 1, .. without gaps) its transform followed by those of all steps before, the first at last."""
    kinds = ", ".join(f"{k} {steps.schema[k].dataType.simpleString()}" for k in keys)
    schema = ", ".join([*([kinds] if keys else []), f"{order} long", *[f"{c} double" for c in CELLS]])

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        m = np.zeros((len(pdf), 3, 3))
        m[:, :, :2] = pdf[list(CELLS)].to_numpy(float).reshape(-1, 3, 2)
        m[:, 2, 2] = 1
        for k in range(1, len(m)):
            m[k] = m[k] @ m[k - 1]
        pdf = pdf.copy()
        pdf[list(CELLS)] = m[:, :, :2].reshape(-1, 6)
        return pdf[[*keys, order, *CELLS]]

    rows = steps.select(*keys, F.col(order).cast("long").alias(order), *[F.col(c).cast("double").alias(c) for c in CELLS])
    piece = F.floor(F.col(order) / PIECE).alias("__piece")
    inner = checkpointed(rows.withColumn("__piece", piece).groupBy(*keys, "__piece").applyInPandas(scan, schema))
    if inner.agg(F.max(order)).first()[0] is None or inner.where(F.col(order) >= PIECE).isEmpty():
        return inner
    # the last product of each piece, as steps of their own
    ends = inner.withColumn("__piece", piece).groupBy(*keys, "__piece").agg(F.max_by(F.struct(*CELLS), order).alias("e"))
    before = running_products(ends.select(*keys, F.col("__piece").alias(order), "e.*"), keys, order)
    shifted = before.select(*keys, (F.col(order) + 1).alias("__piece"), *[F.col(c).alias(f"b_{c}") for c in CELLS])
    joined = inner.withColumn("__piece", piece).join(shifted, [*keys, "__piece"], "left")
    whole = joined.select(*keys, order, "b_m00", *CELLS, *[c.alias(f"p_{n}") for n, c in product("", "b_").items()])
    return whole.select(*keys, order, *[F.when(F.col("b_m00").isNull(), F.col(c)).otherwise(F.col(f"p_{c}")).alias(c) for c in CELLS])


def to_target(frames: DataFrame, target: int, length: int, keys: list[str] = ()) -> DataFrame:  # type: ignore[assignment]
    """(keys, frame, m00 .. m21) for frames 0 .. length - 1: from each frame to the target frame.

    frames (keys, frame, m00 .. m21) has the transform of each frame to its neighbour on
    the target's side. Frames without one are taken as they are; the target's is the identity.
    """
    keys = list(keys)
    named = frames.select(*keys).distinct() if keys else frames.sparkSession.range(1).select()
    every = named.withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(length - 1)))) if length else named.withColumn("frame", F.lit(0)).limit(0)
    on = [*keys, "frame"]
    given = frames.where(F.col("frame") != target).select(*on, *CELLS)
    full = every.join(given, on, "left").select(*on, *[F.coalesce(F.col(c).cast("double"), F.lit(d)).alias(c) for c, d in zip(CELLS, IDENTITY, strict=True)])
    side = F.col("frame") < target
    steps = full.where(F.col("frame") != target).withColumns({"__side": side, "step": F.abs(F.col("frame") - target) - 1}).drop("frame")
    found = running_products(steps, [*keys, "__side"])
    frame = F.when(F.col("__side"), target - 1 - F.col("step")).otherwise(target + 1 + F.col("step")).cast("int")
    return found.select(*keys, frame.alias("frame"), *CELLS).unionByName(full.where(F.col("frame") == target))


def transformed(locs: DataFrame, transforms: DataFrame, keys: list[str] = ()) -> DataFrame:  # type: ignore[assignment]
    """locs with x and y moved by the transform of their frame; frames without one keep theirs."""
    joined = locs.join(transforms.select(*keys, "frame", *CELLS), [*keys, "frame"], "left")
    m = lambda c: F.coalesce(F.col(c), F.lit(dict(zip(CELLS, IDENTITY, strict=True))[c]))
    moved = {c: F.col("x") * m(f"m0{j}") + F.col("y") * m(f"m1{j}") + m(f"m2{j}") for j, c in enumerate("xy")}
    return joined.select(*[moved.get(c, F.col(c)).alias(c) for c in locs.columns])
