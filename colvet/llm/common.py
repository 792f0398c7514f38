"""Shared helpers of the training-data operators: tables, reliable
intermediates, byte-bounded Arrow batches and word hashing on byte buffers."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Bytes of text that one vectorised step holds at a time.
CHUNK_BYTES = 1 << 20
#: Bytes of one Arrow batch between Spark and its Python workers. Spark's own bound
#: (64 MB) is held several times per running task, on both sides.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Unlike a cached or locally checkpointed table this survives lost executors,
    and later reads prune columns.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    path = f"{base.rstrip('/')}/llm-{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_texts(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` in batches of about ``BATCH_BYTES`` (a longer
    row is a batch of its own), unless the application names a bound itself."""
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.sparkContext.getConf().contains(key):
        spark.conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def by_bytes(batches, column: str = "text", limit: int = CHUNK_BYTES):
    """Cut Arrow batches so that the text of each piece stays near ``limit`` bytes
    (one longer text is a piece of its own)."""
    for b in batches:
        if not b.num_rows:
            continue
        col = b.column(b.schema.get_field_index(column))
        size = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(size):
            if held and held + n > limit:
                yield b.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        yield b.slice(start)


def texts(batch, column: str = "text") -> list:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def reach(spans) -> tuple[list, list]:
    """Starts of ``(start, end)`` spans in order, and for each the furthest end among the
    spans that start no later: what a span meets or lies in is one binary search."""
    starts, ends, far = [], [], 0
    for s, e in sorted(spans):
        far = max(far, e)
        starts.append(s)
        ends.append(far)
    return starts, ends


def utf8(values) -> list:
    """UTF-8 bytes of each text; null is empty."""
    return [v.encode("utf-8", "surrogatepass") if v else b"" for v in values]


_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (every output bit depends on every input bit)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_POWERS = [np.ones(1, np.uint64)]


def _powers(n: int) -> np.ndarray:
    """P**0 .. P**(n-1) modulo 2**64."""
    if len(_POWERS[0]) < n:
        p = np.full(max(n, 2 * len(_POWERS[0])), _P, np.uint64)
        p[0] = 1
        with np.errstate(over="ignore"):
            _POWERS[0] = np.multiply.accumulate(p)
    return _POWERS[0]


def word_hashes(raw: list) -> tuple[np.ndarray, np.ndarray]:
    """Hash every white-space separated word (ASCII blanks, A-Z lower-cased) of
    each byte string. Returns the 64-bit hashes of all words in order and the
    word count of each string.

    One pass of array operations: each byte contributes ``BYTE[b] * P**offset``
    with its offset inside the word, and sums over a word are differences of
    the running sum.
    """
    counts = np.zeros(len(raw), np.int64)
    buf = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    if not len(buf):
        return np.zeros(0, np.uint64), counts
    buf = _LOWER[buf]
    blank = _SPACE[buf]
    inside = ~blank
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), counts
    at = np.arange(len(buf), dtype=np.int64)
    lead = np.zeros(len(buf), np.int64)
    lead[start] = start
    np.maximum.accumulate(lead, out=lead)
    off = (at - lead)[inside]
    with np.errstate(over="ignore"):
        val = _BYTE[buf[inside]] * _powers(int((end - start).max()) + 1)[off]
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(val, dtype=np.uint64)))
        ends = np.cumsum(end - start)
        h = mix(total[ends] - total[ends - (end - start)] + (end - start).astype(np.uint64))
    doc_end = np.cumsum([len(r) + 1 for r in raw])
    counts[:] = np.diff(np.concatenate(([0], np.searchsorted(start, doc_end))))
    return h, counts


def shingle_sets(raw: list, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of ``words`` words per string, as sorted 64-bit hashes
    laid end to end, with the set size of each string. A string with fewer
    words has its whole sequence as the one shingle; one without words has none."""
    h, n = word_hashes(raw)
    first = np.concatenate(([0], np.cumsum(n)))[:-1]
    per = np.where(n >= words, n - words + 1, (n > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(raw)), per)
    if not len(doc):
        return np.zeros(0, np.uint64), np.zeros(len(raw), np.int64)
    begin = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    width = np.minimum(n, words)[doc]
    key = np.zeros(len(doc), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(words):
            has = k < width
            w = h[np.where(has, begin + k, 0)]
            key = np.where(has, mix(key * np.uint64(0xD6E8FEB86659FD93) + w + np.uint64(k + 1)), key)
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])))
    return key[fresh], np.bincount(doc[fresh], minlength=len(raw))


def ascii_word_count(col):
    """Number of ``[^\\x20\\x09-\\x0D]+`` words of a text column (null: 0)."""
    return F.coalesce(F.regexp_count(col, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")
