"""Checkpoints for operators that iterate, and broadcasts of sides that were counted."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Narrow rows (a key and a few numbers) that may be broadcast.
BROADCAST_ROWS = 500_000


def _shared_folder(df: DataFrame) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local session without one, as in tests, gets a temporary folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="glintloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder, so that its lineage ends there."""
    _shared_folder(df)
    return df.checkpoint()


def written(df: DataFrame, by: list[str] = ()) -> DataFrame:  # type: ignore[assignment]
    """df written as Parquet beside the checkpoints, in a folder for each value of the columns `by`, so that a filter on them reads no more than it needs.

    Loops that join a table with what they made of it before need this: a checkpoint
    keeps the size that its plan was estimated to have, joins multiply sizes, and so the
    digits of the estimate multiply in each round until they fill the driver. The size
    of written files is what it is.
    """
    path = f"{_shared_folder(df).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame) -> DataFrame:
    """df marked for broadcast if it is counted to have at most BROADCAST_ROWS rows; else as it is, to be joined after a shuffle."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df
