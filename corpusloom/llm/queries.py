"""The subpackage's queries, by name, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import alignment, chat, contamination, embeddings, jaccard, langid, licences, line_dedup, packing, secrets, suffixes, toxicity, whitening


def _table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicate_report(_table(spark, sf_dir))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup_report(_table(spark, sf_dir))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(_table(spark, sf_dir))


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir), licences.known_licences(spark))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contamination_report(_table(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(_table(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_report(_table(spark, sf_dir))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir), packing.tokenizer_path())


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_report(_table(spark, sf_dir))


def op12_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_report(_table(spark, sf_dir))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_chat, op2_jaccard_join, op3_embedding_dedup, op4_suffix_dedup, op5_secrets, op6_licences, op7_decontamination, op8_toxicity, op9_line_dedup, op10_packing, op11_alignment, op12_langid, op13_whitening)}
ORACLE_SQL = {
    "op1_chat": chat.oracle(),
    "op3_embedding_dedup": embeddings.oracle(),
    "op5_secrets": secrets.oracle(),
    "op6_licences": licences.oracle(),
    "op7_decontamination": contamination.oracle(),
    "op9_line_dedup": line_dedup.oracle(),
}
