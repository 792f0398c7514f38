"""Registered queries of the training-data operators: each applies its
operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from . import ann, bpe, chat_format, decontam, embed_dedup, hard_negatives, langid, minhash_dedup, mixing, pii, secret_scan, sharding, turn_repair
from .common import table


def op1_epsilon_grid_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), 0.9)


def op2_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.rotate(table(spark, sf_dir, "conversations"))


def op3_sliding_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"))


def op4_two_pass_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), 8).select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op5_multi_index_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def op6_prefix_dp_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return bpe.tokenize(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                        public_tokenizers.PATTERN, ids=False)


def op7_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.fit(docs))


def op8_kneser_ney_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.learn(docs))


def op9_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(mixing.allocate(table(spark, sf_dir, "documents"))).select(
        "doc_id", "size", "source_size", "target", "taken", "copies")


def op10_multiprobe_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20).select("query_id", "rank", "vec_id", "score")


def op11_persistent_audit_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return turn_repair.Repair(turn_repair.damage(rows)).report(rows)


def op12_prefix_filtered_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_hilbert_zone_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(hard_negatives.relabelled(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


_ALL = (op1_epsilon_grid_near_dedup, op2_perspective_rotation, op3_sliding_entropy_secrets, op4_two_pass_external_shuffle,
        op5_multi_index_minhash_dedup, op6_prefix_dp_byte_bpe, op7_weak_supervision_pii, op8_kneser_ney_language_id,
        op9_pivotal_mixing, op10_multiprobe_search, op11_persistent_audit_repair,
        op12_prefix_filtered_decontamination, op13_hilbert_zone_hard_negatives)


def queries() -> dict:
    def bind(fn):
        def run(spark, sf_dir):
            ensure_checkpoint_dir(spark)
            return fn(spark, sf_dir)
        run.__name__ = fn.__name__
        return run
    return {f.__name__: bind(f) for f in _ALL}


def oracle_sql() -> dict:
    return {"op2_perspective_rotation": chat_format.ORACLE, "op12_prefix_filtered_decontamination": decontam.ORACLE,
            "op13_hilbert_zone_hard_negatives": hard_negatives.ORACLE}
