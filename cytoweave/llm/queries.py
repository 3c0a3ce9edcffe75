"""The registered queries of this subpackage: thin wrappers over its operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontam, infill, linededup, media, mixing, neardup, negatives, pii, quality, toxicity, warc
from .common import crc_remainder, materialise, scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs.select("doc_id", "text"), model)
    modulus, held = toxicity.HELD_OUT
    return scored.select("doc_id", (crc_remainder(F.col("doc_id"), modulus) == held).alias("held_out"), "score", (F.col("score") >= toxicity.ACCEPT).cast("int").alias("predicted"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_deleted")


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = media.write_store(_table(spark, sf_dir, "documents"), scratch_path(spark, "media"))
    return media.store_digests(spark, path)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], turns.schema)
    return chat.conversation_digests(chat.format_conversations(turns.unionByName(tricky)))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_archives(_table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return warc.read_archives(spark, path, keep_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, _table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs.select("doc_id", "text"), model)
    modulus, held = quality.HELD_OUT
    return scored.select("doc_id", (crc_remainder(F.col("doc_id"), modulus) == held).alias("held_out"), "score", (F.col("score") >= quality.ACCEPT).cast("int").alias("predicted"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    # texts are searched once: fit and selection read what was proposed
    proposed = materialise(pii.propose(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "candidates")
    return pii.span_digests(pii.select_spans(proposed, pii.fit_pii(proposed)))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), width=2, percent=80).drop("text_hash")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine_negatives(_table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.fill_in_middle(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(infill.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe.share_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.token_digests(_table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_mix_sources": op2_mix_sources,
        "op3_line_dedup": op3_line_dedup,
        "op4_media": op4_media,
        "op5_chat_format": op5_chat_format,
        "op6_decontamination": op6_decontamination,
        "op7_warc": op7_warc,
        "op8_quality": op8_quality,
        "op9_pii": op9_pii,
        "op10_minhash": op10_minhash,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_fill_in_middle": op12_fill_in_middle,
        "op13_byte_bpe": op13_byte_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_mix_sources": mixing.ORACLE_SQL,
        "op3_line_dedup": linededup.ORACLE_SQL,
        "op5_chat_format": chat.ORACLE_SQL,
        "op6_decontamination": decontam.ORACLE_SQL,
        "op7_warc": warc.ORACLE_SQL,
        "op10_minhash": neardup.ORACLE_SQL,
        "op11_hard_negatives": negatives.ORACLE_SQL,
        "op12_fill_in_middle": infill.ORACLE_SQL,
    }
