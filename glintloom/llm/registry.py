"""Queries of the corpus operators over the driver's tables, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glintloom.llm import decontamination, language_id, license_scan, line_dedup, near_duplicates, prefix_counts, quality_rules, secret_scan, sharding, text_runs, token_automaton, url_filters, whitening

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = line_dedup.repeated_lines(docs)
    return found.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"), "removed")


#: The rules of query op2.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op2_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filters.judge_urls(pages, url_filters.page_outcomes(pages, _table(spark, sf_dir, "labels")), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", F.round("bad_bound", 6).alias("bad_bound"), "verdict")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates.near_duplicate_components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", near_duplicates.fingerprint_text(F.col("sig")).alias("fingerprint"), "component_id")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digests(decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op5_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = secret_scan.train(secret_scan.made_findings(spark))
    found = secret_scan.scan(_table(spark, sf_dir, "documents"), model)
    return found.select("doc_id", "number", F.sha2("value", 256).alias("value_sha256"), "probability", "is_secret")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    counted = prefix_counts.prefix_token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id", "n_bytes"])
    return counted.select("doc_id", "n_bytes", "n_tokens", prefix_counts.over_limit(F.col("n_tokens"), 4096).alias("over_limit"))


def op7_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_automaton.digests(token_automaton.bpe_round_trip(_table(spark, sf_dir, "documents"), path, keep=["doc_id"]))


def op8_license_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = license_scan.train(license_scan.made_paragraphs(spark))
    return license_scan.scan(_table(spark, sf_dir, "documents"), model)


def op9_line_frequency_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judged(quality_rules.line_verdicts(_table(spark, sf_dir, "documents")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_left", "base_failed", "kept")


def op10_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(_table(spark, sf_dir, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_runs.digests(text_runs.find_runs(_table(spark, sf_dir, "documents"), planted=True))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predictions(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_fuzzy_line_dedup": op1_fuzzy_line_dedup,
        "op2_host_reputation": op2_host_reputation,
        "op3_simhash_near_dedup": op3_simhash_near_dedup,
        "op4_benchmark_decontamination": op4_benchmark_decontamination,
        "op5_secret_forest": op5_secret_forest,
        "op6_token_counts": op6_token_counts,
        "op7_bpe_automaton": op7_bpe_automaton,
        "op8_license_classifier": op8_license_classifier,
        "op9_line_frequency_rules": op9_line_frequency_rules,
        "op10_stratified_shards": op10_stratified_shards,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_embedding_whitening": op12_embedding_whitening,
        "op13_language_filters": op13_language_filters,
    }


def oracle_sql() -> dict[str, str]:
    sql = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return sql | {
        "op2_host_reputation": url_filters.oracle(URL_RULES),
        "op4_benchmark_decontamination": decontamination.oracle(),
        "op9_line_frequency_rules": quality_rules.oracle(),
        "op10_stratified_shards": sharding.oracle(24),
    }
