"""The operators' queries over the tables of a folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, mixing, pieces, quality, simhash, sketch, substring, suffix, toxicity, urls
from .common import table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_docs(spark, sf_dir), pieces.Vocabulary(), check=True, keep=["doc_id"])


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.dedup_digest(_docs(spark, sf_dir))
    return out.select("doc_id", F.col("n_tokens").alias("n_words"), "n_removed", "n_spans", "kept_sha256")


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix.dedup_digest(_docs(spark, sf_dir))
    return out.select("doc_id", F.col("n_tokens").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_docs(spark, sf_dir))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = language.held_out(F.col("doc_id"), 3, 1)
    models = language.fit(docs.where(~held))
    return language.identify(docs.select("doc_id", "text", held.alias("held_out")), models, keep=["doc_id", "held_out"])


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is bad if its label says low quality or toxic; labels have the ids of pages."""
    bad = F.when(F.col("quality").isNotNull() & F.col("toxic").isNotNull(), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("long"))
    return urls.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad")))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = _docs(spark, sf_dir), language.held_out(F.col("doc_id"), 5, 0)
    net = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held))
    scored = toxicity.score(docs.withColumn("held_out", held), net, keep=["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sketch.fingerprints(_docs(spark, sf_dir))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), sketch.text_of(F.col("sketch")).alias("fingerprint"), sketch.text_of(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next", "in_edited", "in_next")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_sentencepiece, op2_substring_dedup, op3_suffix_array_dedup, op4_simhash, op5_language, op6_url_filters, op7_toxicity, op8_fingerprints, op9_quality, op10_mixing)}
ORACLE_SQL: dict[str, str] = {"op2_substring_dedup": substring.oracle(), "op6_url_filters": urls.oracle(), "op9_quality": quality.oracle()}
