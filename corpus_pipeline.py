"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. run() writes what a
stage returns as Parquet in the shared folder and gives the written table to the next,
so a lost executor costs no more than its stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glintloom.llm import decontamination, line_dedup, near_duplicates, quality_rules, token_automaton
from glintloom.llm.common import materialise

VOCABULARY = "byte_bpe_50k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without boilerplate lines: those in more than min_docs documents of their source, but for the first of them.

    Null, empty and blank texts have no words and are rejected. Repeated rows are judged
    alike. A null source is a source of its own. All columns stay, others than those of
    documents too; an empty table stays empty.
    """
    return quality_rules.apply_quality_rules(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat an earlier one.

    Null and empty texts stay as they are. Rows equal in doc_id and text keep and lose
    the same lines. A document that loses all lines stays, with an empty text. All
    columns stay; an empty table stays empty.
    """
    return line_dedup.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id.

    Candidates are texts whose SimHashes differ in at most four bits, as operator 3 finds
    them, and those that share a MinHash band; linked are those whose five-word shingles
    have Jaccard similarity 0.8 or more.
    Texts without words, null ones included, are one group. Of repeated rows one stays;
    where a doc_id stands on several texts of a group, the smallest hash of the text
    decides. A null doc_id stays only if its group has no other. All columns stay; an
    empty table stays empty.
    """
    return near_duplicates.first_of_groups(docs, near_duplicates.similar_components(docs, with_simhash=True))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark, as they are.

    Null and empty texts have no words and stay. Repeated rows are judged alike. All
    columns stay; an empty table stays empty, and an empty benchmark removes nothing.
    """
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, their number, and whether decoding them gives the text again.

    Null and empty texts have no ids and decode to the empty text. Every row stands for
    itself. Columns named token_ids, n_tokens or exact are replaced; an empty table
    stays empty.
    """
    decoded = token_automaton.bpe_round_trip(docs, public_tokenizers.path(VOCABULARY))
    exact = F.col("decoded") == F.coalesce("text", F.lit(""))
    return decoded.withColumn("n_tokens", F.size("token_ids").cast("long")).withColumn("exact", exact).drop("decoded")


STAGES = [("quality rules", quality), ("line dedup", lines), ("SimHash near-dedup", near_dedup), ("benchmark decontamination", decontaminate), ("BPE encoding and decoding", tokens)]

#: SQL cannot express SimHash or BPE; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
