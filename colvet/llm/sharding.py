"""Sharding by a two-pass external shuffle.

First pass: every record is scattered by a seeded hash of its content into one
of enough buckets that a bucket fits in memory (``BUCKET_BYTES``, from the
table's total size). Second pass: each bucket is put in a fixed order and
shuffled by Fisher-Yates with the bucket's own generator. Buckets laid end to
end are a random permutation of the table; shard and slot follow from a
record's place in it.

Law ``rows``: with S shards, place g goes to shard g mod S, slot g div S, so
counts differ by one at most and slots have no gaps. Nothing depends on how
the input is partitioned: reruns and retried tasks give the same result.

Defined results: a null text has no bytes (size 1) and checksum 0; a null id
is a value like any other. Rows equal in all columns are interchangeable, each gets
a place of its own; they share a bucket. Rows that differ in any column are told
apart by a hash of the whole record. Extra columns travel inside ``record``. An
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET_BYTES = 32 << 20
#: At most this many rows are aimed at one bucket, however short they are.
BUCKET_ROWS = 100_000
SEED = 20240517


def fisher_yates(n: int, rng) -> np.ndarray:
    """A uniform permutation: from the end, swap each place with a random one before it."""
    order = np.arange(n)
    if n > 1:
        picks = (rng.random(n - 1) * np.arange(n, 1, -1)).astype(np.int64)
        o = order.tolist()
        for last, j in zip(range(n - 1, 0, -1), picks.tolist()):
            o[last], o[j] = o[j], o[last]
        order = np.array(o)
    return order


def _hashable(df: DataFrame) -> list:
    """The columns of ``df`` in a form that Spark can hash (maps as JSON)."""
    return [F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in t or "variant" in t else F.col(f"`{c}`") for c, t in df.dtypes]


def external_shuffle(df: DataFrame, seed: int = SEED) -> DataFrame:
    """``(record struct, doc_id, size, crc, place)``: every record of ``df`` and its
    place in the permutation, from 0."""
    text = F.col("text").cast("string")
    sized = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("record"), F.col("doc_id").cast("long").alias("doc_id"),
                      (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
                      F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("crc"),
                      F.xxhash64(*_hashable(df)).alias("mark"))
    r = sized.agg(F.sum("size"), F.count(F.lit(1))).first()
    nb = max(1, -(-(r[0] or 0) // BUCKET_BYTES), -(-r[1] // BUCKET_ROWS))
    key = F.xxhash64(F.lit(seed), "doc_id", "crc", "size", "mark")
    rows = sized.withColumn("key", key).withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "key"), F.lit(nb)).cast("int"))
    spread = rows.repartition(nb, "bucket").sortWithinPartitions("bucket", "key", "doc_id", "crc", "size")
    names = ["record", "doc_id", "size", "crc", "bucket"]
    schema = spread.select(*names).schema.add("at", "long")

    def run(batches):
        held, now = [], None

        def flush():
            t = pa.Table.from_batches(held).select(names).combine_chunks()
            t = t.take(pa.array(fisher_yates(t.num_rows, np.random.default_rng([seed, now]))))
            t = t.append_column("at", pa.array(np.arange(t.num_rows)))
            yield from t.to_batches(max_chunksize=1_000)

        for b in batches:
            bucket = b.column(b.schema.get_field_index("bucket")).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(bucket)]):
                if lo == hi:
                    continue
                if held and bucket[lo] != now:
                    yield from flush()
                    held = []
                now = int(bucket[lo])
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from flush()

    counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("bucket", F.coalesce(before, F.lit(0)).alias("before"))
    return (spread.mapInArrow(run, schema).join(starts, "bucket")
            .select("record", "doc_id", "size", "crc", (F.col("before") + F.col("at")).alias("place")))


def assign(df: DataFrame, shards: int = 8, seed: int = SEED) -> DataFrame:
    """``(record, doc_id, size, crc, shard, slot)`` under the law ``rows``."""
    return external_shuffle(df, seed).select(
        "record", "doc_id", "size", "crc", F.pmod("place", F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("place") / shards).cast("long").alias("slot"))


def write_shards(df: DataFrame, path: str, shards: int = 8, seed: int = SEED, files_per_shard: int = 8) -> None:
    """Write the records as Parquet under ``path/shard=K``, each file sorted by
    slot; files hold consecutive ranges of slots."""
    a = assign(df, shards, seed).select("shard", "slot", "record")
    (a.repartitionByRange(shards * files_per_shard, "shard", "slot").sortWithinPartitions("shard", "slot")
      .write.partitionBy("shard").parquet(path))
