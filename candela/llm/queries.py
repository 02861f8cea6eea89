"""The registered queries of the corpus operators: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, divergence, filter_audit, katz, ogg, packing, pii, quality, separators, simhash, token_store, tokens, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.scores(_table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"), tokens.vocabulary())


def op3_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.stored(_table(spark, sf_dir, "documents"))


def op4_separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file is named by its task and attempt, so only what doesn't depend on them is returned."""
    return separators.counts(_table(spark, sf_dir, "documents"), tokens.vocabulary()).select("doc_id", "n_tokens")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.stored(_table(spark, sf_dir, "documents"), tokens.vocabulary())


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.with_pseudonyms(_table(spark, sf_dir, "documents"), pii.key_of(spark, pii.DEMONSTRATION_KEY)).select("doc_id", "text")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(_table(spark, sf_dir, "documents"))


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.stored(chat.with_probe(_table(spark, sf_dir, "conversations"))))


QUERIES = {
    "op1_katz": op1_katz,
    "op2_packing": op2_packing,
    "op3_ogg": op3_ogg,
    "op4_separators": op4_separators,
    "op5_toxicity": op5_toxicity,
    "op6_quality": op6_quality,
    "op7_token_store": op7_token_store,
    "op8_pii": op8_pii,
    "op9_simhash": op9_simhash,
    "op10_decontam": op10_decontam,
    "op11_filter_audit": op11_filter_audit,
    "op12_divergence": op12_divergence,
    "op13_chat": op13_chat,
}
ORACLE_SQL = {"op11_filter_audit": filter_audit.ORACLE, "op12_divergence": divergence.ORACLE, "op13_chat": chat.ORACLE}
