"""Sharding by proportional stratified interleaving (operator 10).

Rows are shuffled by a seeded hash within each source and ranked; (rank - 1/2) / rows of
the source is a fractional rank. Sorted by it, all sources run side by side in
proportion, and cuts at equal distances give shards that match the mixture.

Ranks are made without putting a source, or all rows, into one task: rows are ranked
within buckets of the hash (or of the fractional rank, which spreads evenly), and counts
of the buckets before are added. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glintloom.llm.common import join_sized, materialise

#: Buckets of the hash within a source; a bucket of a source of n rows has about n / BUCKETS rows.
BUCKETS = 4096
#: Slices of the fractional rank; the counts of all slices are summed up in one small window.
SLICES = 4096


def _ranked(rows: DataFrame, groups: list[str], bucket: str, order: list[str], rank: str) -> DataFrame:
    """rows with their rank from 1 within groups, by bucket and then by order. Buckets and ranks are computed bucket by bucket."""
    counts = materialise(rows.groupBy(*groups, bucket).agg(F.count("*").alias("__n")))
    before = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    counts = counts.withColumn("__before", F.sum("__n").over(before.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))).drop("__n")
    within = rows.withColumn("__within", F.row_number().over(Window.partitionBy(*groups, bucket).orderBy(*order)))
    joined = join_sized(within, counts, [*groups, bucket], "inner")
    return joined.withColumn(rank, F.col("__within") + F.coalesce("__before", F.lit(0))).drop("__within", "__before")


def assign_shards(docs: DataFrame, shards: int = 24, seed: int = 0, stratum: str = "source") -> DataFrame:
    """One row for each row of docs: doc_id, size, text_crc32, stratum, shard (from 0) and slot (from 0 without gaps in each shard).

    size is the UTF-8 bytes of the text plus 8; a null text has none and the checksum of
    an empty one. Shards differ by one row at most, and in each source by few. Order and
    shards depend on doc_id, text, seed and the rows there are; rows alike in all of
    these are interchangeable. A null source is a source of its own, a null doc_id
    counts as one. Fewer rows than shards leave shards empty; an empty table gives an
    empty result. Other columns of docs are not looked at.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.concat(F.when(F.col(stratum).isNull(), "n").otherwise("s"), F.coalesce(F.col(stratum).cast("string"), F.lit(""))).alias("stratum"),
        F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("draw"),
    )
    rows = materialise(rows.withColumn("bucket", F.conv(F.substring("draw", 1, 3), 16, 10).cast("int")))
    order = ["draw", "doc_id", "text_crc32", "size"]
    ranked = _ranked(rows, ["stratum"], "bucket", order, "rank").drop("bucket")
    sizes = rows.groupBy("stratum").agg(F.count("*").alias("n"))
    share = (2 * F.col("rank") - 1) / (2 * F.col("n"))
    spread = ranked.join(sizes, "stratum") if rows.isEmpty() else join_sized(ranked, sizes, ["stratum"], "inner")
    spread = materialise(spread.withColumn("share", share).withColumn("slice", F.floor(share * SLICES).cast("int")).drop("rank", "n"))
    total = spread.count()
    placed = _ranked(spread, [], "slice", ["share", "stratum", *order], "place")
    # the shard of place p (from 0) is floor(p * shards / total); it starts at ceil(shard * total / shards)
    out = placed.withColumn("shard", F.expr(f"CAST(((place - 1) * {shards}L) DIV {max(total, 1)}L AS INT)"))
    return out.select("doc_id", "size", "text_crc32", "stratum", "shard", (F.col("place") - 1 - F.expr(f"(shard * {total}L + {shards - 1}L) DIV {shards}L")).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 24, seed: int = 0, stratum: str = "source") -> None:
    """Writes docs as Parquet with a folder shard=N for each shard, rows of a file in slot order.

    Every row is written once: null doc_ids are ids like others, and rows with equal
    doc_id, text and stratum share their places among themselves. Null and empty texts
    are placed by their size as assign_shards says. Columns named shard or slot are
    replaced, all others are carried along; an empty table writes no shard.
    """
    alike = ["__id", "__crc", "__size", "__stratum"]
    nth = F.row_number().over(Window.partitionBy(*alike).orderBy("__order"))
    placed = assign_shards(docs, shards, seed, stratum)
    placed = placed.select(F.col("doc_id").alias("__id"), F.col("text_crc32").alias("__crc"), F.col("size").alias("__size"), F.col("stratum").alias("__stratum"), "shard", "slot", F.struct("shard", "slot").alias("__order"))
    placed = placed.withColumn("__nth", nth).drop("__order")
    text = F.coalesce("text", F.lit(""))
    kept = docs.drop("shard", "slot").withColumns({
        "__id": F.col("doc_id"), "__crc": F.crc32(text.cast("binary")), "__size": (F.octet_length(text) + F.lit(8)).cast("long"),
        "__stratum": F.concat(F.when(F.col(stratum).isNull(), "n").otherwise("s"), F.coalesce(F.col(stratum).cast("string"), F.lit(""))), "__order": F.monotonically_increasing_id(),
    })
    kept = kept.withColumn("__nth", nth).drop("__order")
    same = kept["__id"].eqNullSafe(placed["__id"])
    for c in ("__crc", "__size", "__stratum", "__nth"):
        same = same & (kept[c] == placed[c])
    joined = kept.join(placed, same).select(*[kept[c] for c in docs.drop("shard", "slot").columns], "shard", "slot")
    joined.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def oracle_order(seed: int = 0) -> str:
    """DuckDB SQL for doc_id, place (from 0) and total of all documents in interleaved order."""
    return f"""
    SELECT doc_id, row_number() OVER (ORDER BY share, stratum, draw, doc_id) - 1 AS place, count(*) OVER () AS total FROM (
      SELECT doc_id, stratum, draw, CAST(2 * row_number() OVER (PARTITION BY stratum ORDER BY draw, doc_id) - 1 AS DOUBLE) / CAST(2 * count(*) OVER (PARTITION BY stratum) AS DOUBLE) AS share
      FROM (SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS stratum, md5('{seed}:' || doc_id) AS draw FROM documents))"""


def oracle(shards: int = 24, seed: int = 0) -> str:
    """DuckDB SQL for the query op10. CRC-32 is spelt out byte by byte with a table made by its rule."""
    table = "(SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, [CAST(0 AS BIGINT) FOR x IN range(8)]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS b)))"
    crc = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)"
    return f"""
    WITH placed AS ({oracle_order(seed)}), crc AS {table},
    doc AS (SELECT doc_id, [CAST(('0x' || substr(h, i * 2 + 1, 2)) AS BIGINT) FOR i IN range(len(h) // 2)] AS bytes FROM (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents)),
    s AS (SELECT doc_id, place, total, CAST((place * {shards}) // total AS INTEGER) AS shard FROM placed)
    SELECT s.doc_id, CAST(len(bytes) + 8 AS BIGINT) AS size, {crc} AS text_crc32, 'rows' AS law, shard, CAST(place - (CAST(shard AS BIGINT) * total + {shards - 1}) // {shards} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
    FROM s JOIN doc USING (doc_id), crc"""
