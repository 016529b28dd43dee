"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cells that may be broadcast: one for each row and one for each element of its arrays, of some 16 to 40 bytes each. Larger sides are shuffled.
BROADCAST_CELLS = 1_500_000
#: Rows in a batch that goes to a Python worker. Batches of 10,000 texts or pairs of texts, Spark's default, take some 100 MB of every task outside the heap.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_tables: dict[int, list[str]] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a local session (as in tests) gets a temporary folder; a cluster has none to share, which is an error."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = getattr(sc, "_glintloom_root", None) or "file://" + tempfile.mkdtemp(prefix="glintloom-")
        sc._glintloom_root = root
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(root)
    return root


def materialise(df: DataFrame) -> DataFrame:
    """Writes df as Parquet below shared_root and returns the written table, so that nothing before it runs twice."""
    spark = df.sparkSession
    path = f"{shared_root(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    _tables.setdefault(id(spark.sparkContext), []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Deletes the tables that materialise() wrote in this session. Results that still read them must be written before."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in _tables.pop(id(spark.sparkContext), []):
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def cells(df: DataFrame) -> int:
    """Rows of df and elements of its array columns."""
    arrays = [F.greatest(F.size(f.name), F.lit(0)) for f in df.schema.fields if f.dataType.typeName() == "array"]
    each = sum(arrays, F.lit(1)).cast("long")
    return df.agg(F.sum(each)).first()[0] or 0


def join_sized(left: DataFrame, right: DataFrame, on: list[str] | Column, how: str, size: int | None = None, salts: int = 1) -> DataFrame:
    """left joined with a materialised right side: broadcast if it has at most BROADCAST_CELLS cells, else shuffled.

    size is the number of cells where it is known. With salts > 1 (for column names in
    `on`) the rows of a shuffled key are dealt to so many tasks, and right is repeated as often.
    """
    n = cells(right) if size is None else size
    if n <= BROADCAST_CELLS:
        return left.join(F.broadcast(right), on, how)
    if salts == 1:
        return left.join(right, on, how)
    dealt = left.withColumn("__salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)))
    copies = right.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return dealt.join(copies, [*on, "__salt"], how).drop("__salt")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, even if the body refers to it inside other lambdas."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased; all other characters as they are."""
    return F.translate(text, _UPPER, _UPPER.lower())


def split_words(text: Column, separators: str) -> Column:
    """The non-empty parts of text between separators (a Java pattern); null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), separators), lambda w: w != "")


def text_key(text: Column) -> Column:
    """Together with doc_id this tells rows apart where doc_id repeats."""
    return F.xxhash64(text, F.length(text))
