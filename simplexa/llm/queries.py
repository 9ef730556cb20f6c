"""Registered queries of the corpus operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simplexa.llm import bpe, compress, decontaminate, lines, minhash, pii, rules, substring, suffix, warc
from simplexa.llm.common import materialise, small_batches, table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    """Where the public word-end vocabulary lies (a parameter of the operator; never copied here)."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    with small_batches(spark):  # so written here: a plan run later would take the session's batches
        found = lines.dedup(table(spark, sf_dir, "documents"), texts=False)
        return materialise(found.select("doc_id", "n_lines", "n_removed", "kept_sha256"), "line-digests")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n_symbols").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is the deployment's secret, read from the session where it is set."""
    key = spark.conf.get("spark.simplexa.pii.key", "development key")
    return pii.replace(table(spark, sf_dir, "documents"), key).select("doc_id", "n_entities", F.col("replaced").alias("text"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = rules.measures(table(spark, sf_dir, "documents"))
    measured = materialise(measured, "measures")
    chosen = rules.cutoffs(measured, table(spark, sf_dir, "labels"))
    return rules.apply_rules(measured, chosen).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).drop("row")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n_symbols").alias("n_words"), "n_removed", "kept_sha256")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(found)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return compress.score(docs, compress.fit(docs, table(spark, sf_dir, "labels"))).drop("text")


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {}  # too slow on whole tables in SQL, or not expressible: tests hold them against brute force
