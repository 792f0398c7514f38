"""Cleaning pipeline over ``documents``: language, near-duplicates, personal
data, source mix, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and returns a table that is written
as Parquet and read back as the next one's ``docs``. All stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colvet.llm import bpe, langid, minhash_dedup, mixing, pii
from colvet.llm.common import materialize
from colvet.session import ensure_checkpoint_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; the rejected ones go."""
    return langid.accepted(docs.select(*COLUMNS), langid.learn(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (5-word shingles, similarity
    0.8): the smallest id, a null id last. Rows are told apart by id and text, so
    different texts that share an id are judged each on its own; of rows equal in
    both, one stays. A text without words is a group of its own."""
    ensure_checkpoint_dir(spark)
    named = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("row_key"))
    groups = minhash_dedup.near_duplicates(named.select("row_key", "text"), words=5, percent=80, id_col="row_key")
    ids = groups.select(F.col("doc_id").alias("row_key"), "component_id").distinct().join(named.select("row_key", "doc_id"), "row_key")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key"))["row_key"]
    kept = ids.groupBy("component_id").agg(first.alias("row_key")).select("row_key").distinct()
    return named.join(kept, "row_key", "left_semi").dropDuplicates(["row_key", "doc_id"]).select(*COLUMNS)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; ``n_chars`` follows the new text."""
    return pii.redact(docs.select(*COLUMNS), pii.fit(docs)).withColumn("n_chars", F.length("text").cast("long"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    ensure_checkpoint_dir(spark)
    return mixing.mix(docs.select(*COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each whole text, and digests of the ids and of what they decode to."""
    import public_tokenizers
    return bpe.tokenize(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language_id", known_language), ("minhash_near_dedup", one_of_each), ("pii", without_personal_data),
          ("source_mix", mixed), ("byte_bpe", tokens)]

#: Rounding at random, a trained classifier and the merges have no SQL form; the
#: tests hold every stage against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
