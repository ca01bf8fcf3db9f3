"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.llm import (centroids, chat, decontam, exactdedup, licences, linededup, mixing, pii, quality, sharding, simhash,
                          suffixdedup, tokenalign)
from voxframe.llm.common import table
from voxframe.llm.oracles import ORACLES


def op1_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence paragraphs; the chance in thousandths."""
    found = licences.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("paragraph").cast("long").alias("paragraph"), "predicted",
                        F.round(F.col("chance") * 1000).cast("long").alias("chance"),
                        F.round(F.col("agreement") * 1000).cast("long").alias("agreement"), "family", "text")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", simhash.as_hex("fp").alias("fingerprint"), "component_id")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digests(pii.find_pii(table(spark, sf_dir, "documents")))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(linededup.dedup_lines(table(spark, sf_dir, "documents")))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffixdedup.dedup_substrings(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and -1 whose turns look like another template's marks."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(
        "SELECT * FROM VALUES (-1L, 0L, 'user', :said), (-1L, 1L, 'assistant', :said) AS t(conv_id, turn, role, text)",
        args={"said": said})
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.chat_digests(chat.format_turns(turns.unionByName(extra)))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table stands for both sides: half of its ids are history, half arrive."""
    found = exactdedup.dedup(table(spark, sf_dir, "documents"), exactdedup.half())
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenalign.align(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_licences, op2_simhash, op3_pii, op4_mixing, op5_sharding, op6_line_dedup, op7_suffix_dedup,
                            op8_decontam, op9_chat, op10_quality, op11_centroids, op12_exact_dedup, op13_token_alignment)
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLES.items() if k in QUERIES}
