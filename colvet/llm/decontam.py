"""Benchmark decontamination as a prefix-filtered set join.

Every benchmark item is cut into windows of ``words`` consecutive words (an item
with fewer is one window). A window is seen as the set of its positional
shingles; containment has to be whole, so the necessary prefix of a window is
its one rarest shingle: where that does not occur, the window does not.

1. Count, over all documents, the occurrences of the benchmark's shingles.
2. Order each window's shingles by that count; the rarest is its prefix token.
3. Emit the places of prefix tokens in documents with the words around them, and
   join them with the windows on the token, under the positional bound (the
   token's offset must leave room before it) and the length bound (the window
   must end inside the document).
4. Compare the item-sized window of document words with the window's words.

Step 1 and 3 read the texts once each. They test shingles against a bit filter of
the benchmark's tokens whose size is bounded (``FILTER_BITS``); what a fuller
filter lets through falls out in the join, so its size changes no result.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.

Defined results: a null, empty or wordless text has no words and no hit; such an
item has no window. Repeated document rows are judged each on its own; repeated
item rows count once; several texts under one item_id are one item. A null
item_id is one item, written as the empty string. An empty benchmark hits
nothing, an empty documents table gives an empty result. Extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _BYTE, _LOWER, _powers, by_bytes, map_texts, materialize, mix, texts, utf8

WORDS, SHINGLE = 10, 3
#: Bits of the token filter: 16 per token, at most 2**28 (32 MB).
FILTER_BITS = 28
_BUCKET = 32768  # bits per row of Spark's bitmap aggregate
_OUTSIDE = np.ones(256, bool)
_OUTSIDE[0x30:0x3A] = _OUTSIDE[0x61:0x7B] = _OUTSIDE[0x80:] = False


class Words:
    """Words of several texts: the lower-cased bytes, each word's place in them,
    its hash, and the number of its text."""

    def __init__(self, raw: list):
        buf = _LOWER[np.frombuffer(b" ".join(raw) + b" ", np.uint8)]
        self.bytes = buf.tobytes()
        inside = ~_OUTSIDE[buf]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        stop = np.cumsum([len(r) + 1 for r in raw])
        self.upto = np.searchsorted(self.start, stop)  # words of this and all earlier texts
        self.count = np.diff(np.concatenate(([0], self.upto)))
        self.text = np.repeat(np.arange(len(raw)), self.count)
        size = self.end - self.start
        with np.errstate(over="ignore"):
            lead = np.zeros(len(buf), np.int64)
            lead[self.start] = self.start
            np.maximum.accumulate(lead, out=lead)
            off = (np.arange(len(buf)) - lead)[inside]
            val = _BYTE[buf[inside]] * _powers(int(size.max(initial=0)) + 1)[off]
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(val, dtype=np.uint64)))
            ends = np.cumsum(size)
            self.hash = mix(total[ends] - total[ends - size] + size.astype(np.uint64))

    def tokens(self, width: int) -> tuple:
        """``(place, token)`` of every shingle of ``width`` words inside one text."""
        n = max(0, len(self.hash) - width + 1)
        at = np.arange(n)
        at = at[at + width <= self.upto[self.text[:n]]] if n else at
        key = np.full(len(at), width, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(width):
                key = mix(key * np.uint64(0xD6E8FEB86659FD93) + self.hash[at + k])
        return at, key.view(np.int64)

    def words(self, lo: int, hi: int) -> str:
        return b" ".join([self.bytes[a:b] for a, b in zip(self.start[lo:hi], self.end[lo:hi])]).decode("utf-8", "surrogatepass")


def _windows(items: DataFrame, words: int, shingle: int) -> DataFrame:
    """``(item, window, size, tokens)``: the windows of every item."""
    def run(batches):
        for b in by_bytes(batches):
            w = Words(utf8(texts(b)))
            ids, size, text, lists = [], [], [], []
            by_width = {}
            first = w.upto - w.count
            for k, item in enumerate(b.column(0).to_pylist()):
                long = min(words, int(w.count[k]))
                if not long:
                    continue
                width = min(shingle, long)
                if width not in by_width:
                    at, token = w.tokens(width)
                    by_width[width] = np.zeros(len(w.hash), np.int64)
                    by_width[width][at] = token
                tokens = by_width[width]
                for p in range(first[k], w.upto[k] - long + 1):
                    ids.append(item)
                    size.append(long)
                    text.append(w.words(p, p + long))
                    lists.append(tokens[p:p + long - width + 1])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(text, pa.string()), pa.array(size, pa.int32()),
                                              pa.array(lists, pa.list_(pa.int64()))], names=["item", "window", "size", "tokens"])

    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text"))
    return map_texts(named, run, "item string, window string, size int, tokens array<long>")


def _filter(tokens: DataFrame) -> np.ndarray:
    """Bits of the tokens' low parts, gathered as ``_BUCKET``-bit rows: at most
    2**FILTER_BITS bits whatever the number of tokens."""
    n = tokens.agg(F.approx_count_distinct("token")).first()[0]
    bits = min(FILTER_BITS, max(16, int(16 * n).bit_length()))
    low = F.col("token").bitwiseAND(F.lit((1 << bits) - 1)) + 1
    rows = (tokens.select(F.bitmap_bucket_number(low).alias("b"), F.bitmap_bit_position(low).alias("p"))
                  .groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits")).collect())
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in rows:
        at = (r["b"] - 1) * (_BUCKET // 8)
        out[at:at + _BUCKET // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def _held(filter_bits: np.ndarray, token: np.ndarray) -> np.ndarray:
    low = token & (8 * len(filter_bits) - 1)
    return (filter_bits[low >> 3] >> (low & 7).astype(np.uint8)) & 1 == 1


def _occurrences(texts_df: DataFrame, sieve, widths: list) -> DataFrame:
    """``(token, n)``: how often the tokens that pass the filter occur in all texts."""
    def run(batches):
        for b in by_bytes(batches):
            w = Words(utf8(texts(b)))
            kept = [t[_held(sieve.value, t)] for t in (w.tokens(k)[1] for k in widths)]
            token, n = np.unique(np.concatenate(kept), return_counts=True) if kept else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(token, pa.int64()), pa.array(n, pa.int64())], names=["token", "n"])

    return map_texts(texts_df, run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


_PLACES = "row long, doc_id long, n_words long, place long, token long, lead int, near string"


def _places(rows: DataFrame, sieve, widths: list, words: int) -> DataFrame:
    """One head row (token null) per document, and one row per place of a prefix
    token with the words that any window around it can cover."""
    def run(batches):
        for b in by_bytes(batches):
            w = Words(utf8(texts(b)))
            row, ids = b.column(0).to_pylist(), b.column(1).to_pylist()
            first = w.upto - w.count
            out = [(row[k], ids[k], int(w.count[k]), None, None, None, None) for k in range(len(row))]
            for width in widths:
                at, token = w.tokens(width)
                held = _held(sieve.value, token)
                for p, t in zip(at[held].tolist(), token[held].tolist()):
                    k = int(w.text[p])
                    lo, hi = max(int(first[k]), p - words + width), min(int(w.upto[k]), p + words)
                    out.append((row[k], ids[k], int(w.count[k]), p - int(first[k]), t, p - lo, w.words(lo, hi)))
                    if len(out) >= 20_000:
                        yield _batch(out)
                        out = []
            if out:
                yield _batch(out)

    return map_texts(rows, run, _PLACES)


def _batch(out: list):
    types = [pa.int64()] * 5 + [pa.int32(), pa.string()]
    names = [c.split()[0] for c in _PLACES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))


def _same_items(held: DataFrame) -> tuple:
    """``(window, items_key)`` and ``(items_key, item)``: windows of the same items share
    a key (count and two sums of item hashes), so a passage that many items hold
    is joined once, not once per item and window."""
    key = F.concat_ws(":", F.count(F.lit(1)), F.sum(F.xxhash64("item").cast("decimal(38,0)")),
                      F.sum(F.xxhash64(F.lit(1), "item").cast("decimal(38,0)")))
    keyed = materialize(held.groupBy("window").agg(key.alias("items_key")), "window-keys")
    one = keyed.groupBy("items_key").agg(F.min("window").alias("window"))
    return keyed, one.join(held, "window").select("items_key", "item")


def find(docs: DataFrame, items: DataFrame, words: int = WORDS, shingle: int = SHINGLE) -> tuple:
    """``(heads, hits, sets)``: one head ``(row, doc_id, n_words)`` per document row;
    verified occurrences ``(row, start, stop, items_key)`` in words; and the
    items ``(items_key, item)`` of each key."""
    spark = docs.sparkSession
    windows = materialize(_windows(items, words, shingle), "windows")
    held = windows.select("window", "item").distinct()
    keyed, sets = _same_items(held)
    each = materialize(windows.dropDuplicates(["window"]).select("window", "size", F.posexplode("tokens").alias("off", "token")), "window-tokens")
    widths = sorted({min(shingle, r["size"]) for r in each.select("size").distinct().collect()})
    sieve = spark.sparkContext.broadcast(_filter(each))
    seen = _occurrences(docs.select(F.col("text").cast("string").alias("text")), sieve, widths)
    rare = F.min(F.struct("n", "token", "off"))
    prefix = each.join(seen, "token", "left").groupBy("window", "size").agg(
        # a window with a shingle that no text holds cannot occur
        F.count("n").alias("met"), F.count(F.lit(1)).alias("all"), rare.alias("p"))
    prefix = prefix.where("met = all").join(keyed, "window").select(
        "window", "size", F.col("p.token").alias("token"), F.col("p.off").alias("off"), "items_key")
    prefix = materialize(prefix, "window-prefix")
    sieve = spark.sparkContext.broadcast(_filter(prefix))
    found = materialize(_places(_rows(docs), sieve, widths, words), "window-places")
    start = F.col("place") - F.col("off")
    piece = F.array_join(F.slice(F.split("near", " "), F.col("lead") - F.col("off") + 1, F.col("size")), " ")
    hits = (found.where("token is not null").drop("doc_id").join(prefix, "token")
                 .where((start >= 0) & (start + F.col("size") <= F.col("n_words")) & (F.col("off") <= F.col("lead")))
                 .where(piece == F.col("window"))
                 .select("row", start.alias("start"), (start + F.col("size")).alias("stop"), "items_key"))
    return found.where("token is null").select("row", "doc_id", "n_words"), hits, sets


def report(docs: DataFrame, items: DataFrame, words: int = WORDS, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)``, one row per
    document row: words inside any occurrence of a window, and the items whose
    windows occur."""
    heads, hits, sets = find(docs, items, words, shingle)
    hits = materialize(hits, "window-hits")
    # union of a document's intervals; as many as it has words at most
    reach = F.max("stop").over(Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    covered = (hits.groupBy("row", "start").agg(F.max("stop").alias("stop")).withColumn("reach", F.coalesce(reach, F.lit(0)))
                   .groupBy("row").agg(F.sum(F.greatest(F.lit(0), F.col("stop") - F.greatest("start", "reach"))).alias("n_hit")))
    named = (hits.select("row", "items_key").distinct().join(sets, "items_key").select("row", "item").distinct()
                 .groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items")))
    return (heads.join(covered, "row", "left").join(named, "row", "left")
                 .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                         F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
                         F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
                         F.col("n_hit").isNotNull().alias("contaminated")))


def clean(docs: DataFrame, items: DataFrame, words: int = WORDS, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` (all columns) in which no window of an item occurs."""
    each = materialize(docs.select("text").where("text is not null").distinct().select(
        F.monotonically_increasing_id().alias("doc_id"), "text"), "texts")
    hit = report(each, items, words, shingle).where("contaminated").select("doc_id")
    return docs.join(each.join(hit, "doc_id").select("text"), "text", "left_anti").select(docs.columns)


#: The same result by comparing every document window with every item window.
ORACLE = """
WITH low AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(t, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM low),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(10, len(w)) AS size, array_to_string(list_slice(w, p, p + least(10, len(w)) - 1), ' ') AS x
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS p FROM b WHERE len(w) > 0) q),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (
  SELECT rid, p, size, array_to_string(list_slice(w, p, p + size - 1), ' ') AS x
  FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, sizes WHERE len(w) >= size) q),
hit AS (SELECT rid, p, dw.size, item FROM dw JOIN bw ON dw.x = bw.x AND dw.size = bw.size),
words AS (SELECT rid, count(DISTINCT place) AS n_hit FROM (
  SELECT rid, unnest(range(p, p + size)) AS place FROM (SELECT DISTINCT rid, p, size FROM hit) q) r GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, item FROM hit) q GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN named USING (rid)
"""
