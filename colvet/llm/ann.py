"""Approximate nearest neighbours (largest inner product) by multiprobe
p-stable hashing.

Vectors are scaled by the largest norm and lifted by one coordinate onto the
unit sphere, where the nearest point in Euclidean distance is the one with the
largest inner product. Each of ``TABLES`` hash tables files a vector under
``floor((a . x + b) / WIDTH)`` for M Gaussian directions. A query visits its
own bucket and perturbed buckets (one step up or down in some directions) in
the order of estimated success: directions are sorted by the distance of the
query to the bucket's border, and the perturbation sets by the expected sum of
squares of these distances (Lv et al. 2007). Each task scores the members of a
bucket against the queries that visit it and keeps the best per query; the
kept candidates of all tables are merged by their exact inner product in
double precision.

A bucket with more than ``BLOCK`` members is dealt out over several tasks, and
every query that visits it visits all of its parts, so no bucket is cut.
A query that found fewer than ``k`` neighbours although more vectors exist
goes through the same step with no hash directions: one bucket of all rows in
blocks. All rows are indexed; nothing is fitted but the largest norm.

Defined results: vectors that are null, empty, zero, or hold null or
non-finite components are neither queries nor candidates. Vectors of other
lengths are no candidates. Equal scores go to the smaller id. Repeated rows
are indexed once; a candidate id with several vectors counts once, with its best
score; a query id that repeats is one query, with the row of the smallest vector
bytes. Extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .embed_dedup import vectors

TABLES = 12
WIDTH = 1.25
BLOCK = 16384
SEED = 11
#: Vectors per length whose scores bound what a task sends on (no row is left out for it).
SAMPLE = 1000


def directions(rows: int) -> int:
    """Hash directions per table: one more for each tenfold of rows."""
    return max(3, round(math.log10(max(rows, 1))) - 1)


def probe_sets(m: int, count: int) -> list:
    """The ``count`` best perturbation sets over the ``2 m`` borders sorted by
    distance, by the expected squared distances of sorted uniform variables.
    Position j and its mirror 2m-1-j are the two sides of one direction and
    exclude each other."""
    if not m:
        return [()]
    j = np.arange(1, m + 1)
    near = j * (j + 1) / (4 * (m + 1) * (m + 2))
    far = (1 - (j / (m + 1)) + j * (j + 1) / (4 * (m + 1) * (m + 2)))[::-1]
    z = np.concatenate((near, far))
    out, heap = [()], [(z[0], (0,))]
    while heap and len(out) < count:
        score, s = heapq.heappop(heap)
        if len({min(x, 2 * m - 1 - x) for x in s}) == len(s):
            out.append(s)
        last = s[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (score + z[last + 1] - z[last], s[:-1] + (last + 1,)))
            heapq.heappush(heap, (score + z[last + 1], s + (last + 1,)))
    return out


def _hashing(dim: int, t: int, m: int):
    rng = np.random.default_rng([SEED, dim, t])
    return rng.normal(size=(dim + 1, m)), rng.uniform(0, WIDTH, m), rng.integers(1, 2**62, 64)[:m] | 1


def _lift(x: np.ndarray, top: float, query: bool) -> np.ndarray:
    n = np.sqrt((x * x).sum(1))
    if query:
        return np.concatenate((x / n[:, None], np.zeros((len(x), 1))), 1)
    x = x / top
    return np.concatenate((x, np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(1)))[:, None]), 1)


def _buckets(vecs: DataFrame, tops: dict, m: int, query=None) -> DataFrame:
    """``(dim, t, bucket, vec_id, vec, least)``: the bucket of each member, or the
    buckets that each query visits. ``query``: ``(k, sample)`` for queries; the
    k-th best score in the sample bounds what can be among the query's best."""
    probes = probe_sets(m, 2 ** m) if query else [()]

    def run(batches):
        for b in batches:
            dims = b.column(1).to_numpy(zero_copy_only=False)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                part = b.take(pa.array(at))
                x = np.frombuffer(b"".join(part.column(2).to_pylist())).reshape(-1, d)
                y = _lift(x, tops[int(d)], bool(query))
                least = _floors(part.column(0).to_numpy(zero_copy_only=False), x, *query[1][int(d)], query[0]) if query else np.full(len(at), -np.inf)
                for t in range(TABLES if m else 1):
                    a, off, mul = _hashing(int(d), t, m)
                    f = (y @ a + off) / WIDTH
                    h = np.floor(f).astype(np.int64)
                    low = f - h
                    order = np.argsort(np.concatenate((low, 1.0 - low), 1), axis=1, kind="stable")
                    keys = []
                    for s in probes:
                        key = (h * mul).sum(1)
                        for j in s:
                            side = order[:, j]
                            key = key + np.where(side < m, -1, 1) * mul[side % m]
                        keys.append(key)
                    n = len(at) * len(probes)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, d, np.int32)), pa.array(np.full(n, t, np.int32)), pa.array(np.stack(keys, 1).ravel()),
                         *(part.column(i).take(pa.array(np.repeat(np.arange(len(at)), len(probes)))) for i in (0, 2)),
                         pa.array(np.repeat(least, len(probes)))],
                        names=["dim", "t", "bucket", "vec_id", "vec", "least"])

    return vecs.select("vec_id", "dim", "vec").mapInArrow(run, "dim int, t int, bucket long, vec_id long, vec binary, least double")


def _floors(ids, x, sample_ids, sample, k: int) -> np.ndarray:
    """Per query its k-th best score among the sampled vectors (other than itself)."""
    out = np.full(len(ids), -np.inf)
    if len(sample_ids) > k:
        for lo in range(0, len(ids), 256):
            s = x[lo:lo + 256] @ sample.T
            s[ids[lo:lo + 256, None] == sample_ids[None, :]] = -np.inf
            out[lo:lo + 256] = -np.partition(-s, k - 1, axis=1)[:, k - 1]
    return out


def _sample(vecs: DataFrame) -> dict:
    """``dim -> (ids, vectors)`` of the SAMPLE rows per length with the smallest hash of the id."""
    w = Window.partitionBy("dim").orderBy(F.xxhash64("vec_id"), "vec_id")
    rows = vecs.select("dim", "vec_id", "vec").withColumn("r", F.row_number().over(w)).where(F.col("r") <= SAMPLE).collect()
    out: dict = {}
    for d in {r["dim"] for r in rows}:
        own = {r["vec_id"]: bytes(r["vec"]) for r in rows if r["dim"] == d}
        out[d] = (np.array(list(own), np.int64), np.frombuffer(b"".join(own.values())).reshape(-1, d))
    return out


def best(q, v, s, k: int):
    """The ``k`` best distinct candidates of each query: larger score, then smaller id.
    A candidate that occurs with several scores counts with its best."""
    o = np.lexsort((-s, v, q))
    q, v, s = q[o], v[o], s[o]
    fresh = np.concatenate(([True], (q[1:] != q[:-1]) | (v[1:] != v[:-1]))) if len(q) else np.zeros(0, bool)
    q, v, s = q[fresh], v[fresh], s[fresh]
    o = np.lexsort((v, -s, q))
    q, v, s = q[o], v[o], s[o]
    first = np.searchsorted(q, q)
    keep = np.arange(len(q)) - first < k
    return q[keep], v[keep], s[keep]


def _scored(group_rows: DataFrame, k: int) -> DataFrame:
    """Stream the sorted buckets of a partition: hold a bucket's members, score
    the queries that follow them, keep the best ``k`` per query."""
    def run(batches):
        held: list = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        out = ["query_id", "vec_id", "score"]
        now, mid, mvec = None, [], []

        def emit():
            return pa.RecordBatch.from_arrays([pa.array(x) for x in best(*held, k)], names=out)

        def score(qid, qvec, floor, ids, members, starts):
            nonlocal held
            for lo in range(0, len(qid), 512):
                qi, q = qid[lo:lo + 512], qvec[lo:lo + 512]
                s = q @ members.T
                s[qi[:, None] == ids[None, :]] = -np.inf
                # the k-th best of distinct ids, each with its best score
                by_id = s if len(starts) == len(ids) else np.maximum.reduceat(s, starts, axis=1)
                n = min(k, len(starts))
                cut = -np.partition(-by_id, n - 1, axis=1)[:, n - 1]
                slack = 1e-9 * (1.0 + np.abs(np.where(np.isfinite(cut), cut, 0.0)))
                r, c = np.nonzero((s >= np.maximum(cut, floor[lo:lo + 512])[:, None] - slack[:, None]) & (s > -np.inf))
                exact = (q[r] * members[c]).sum(1)
                got = best(qi[r], ids[c], exact, k)
                held = [np.concatenate(p) for p in zip(held, got)]
                if len(held[0]) > 250_000:
                    held = list(best(*held, k))

        ids = members = starts = None
        for b in batches:
            dims, t, bucket, salt, kind, vid = (b.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            vec, least = b.column(6), b.column(7).to_numpy(zero_copy_only=False)
            change = np.flatnonzero((dims[1:] != dims[:-1]) | (t[1:] != t[:-1]) | (bucket[1:] != bucket[:-1])
                                    | (salt[1:] != salt[:-1]) | (kind[1:] != kind[:-1])) + 1
            for lo, hi in zip([0, *change], [*change, len(dims)]):
                key = (dims[lo], t[lo], bucket[lo], salt[lo])
                if key != now:
                    now, mid, mvec, ids, members, starts = key, [], [], None, None, None
                x = np.frombuffer(b"".join(vec.slice(lo, hi - lo).to_pylist())).reshape(-1, dims[lo])
                if kind[lo] == 0:
                    mid.append(vid[lo:hi])
                    mvec.append(x)
                elif mid:
                    if members is None:
                        ids, members = np.concatenate(mid), np.concatenate(mvec)
                        o = np.argsort(ids, kind="stable")
                        ids, members = ids[o], members[o]
                        starts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
                    score(vid[lo:hi], x, least[lo:hi], ids, members, starts)
                    if len(held[0]) > 300_000:  # that many after merging: very many queries
                        yield emit()
                        held = [h[:0] for h in held]
        if len(held[0]):
            yield emit()

    return group_rows.mapInArrow(run, "query_id long, vec_id long, score double")


def _round(members: DataFrame, queries: DataFrame, tops: dict, sample: dict, m: int, k: int) -> DataFrame:
    spark = members.sparkSession
    key = ["dim", "t", "bucket"]
    mem = _buckets(members, tops, m)
    hot = (_buckets(members, tops, m).groupBy(*key)
           .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)
           .select(*key, F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")))
    hot = materialize(hot, "hot")
    one = F.coalesce("parts", F.lit(1))
    mem = mem.join(hot, key, "left").withColumn("salt", F.pmod(F.xxhash64("vec_id", "vec"), one).cast("int"))
    qry = (_buckets(queries, tops, m, (k, sample)).join(hot, key, "left")
           .withColumn("salt", F.explode(F.sequence(F.lit(0), one - 1))))
    cols = [*key, "salt", "kind", "vec_id", "vec", "least"]
    both = mem.withColumn("kind", F.lit(0)).select(*cols).unionByName(qry.withColumn("kind", F.lit(1)).select(*cols))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    both = both.repartition(parts, *key, "salt").sortWithinPartitions(*key, "salt", "kind")
    found = _scored(both, k).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(df: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found of every row
    for which the column ``is_query`` (over ``vec_id``) holds."""
    vecs = materialize(vectors(df, id_col, vec_col).where("vec_id is not null").distinct(), "vectors")
    sizes = vecs.groupBy("dim").agg(F.countDistinct("vec_id").alias("n")).collect()
    total = sum(r["n"] for r in sizes)
    tops, sample = _largest_norms(vecs), _sample(vecs)
    queries = vecs.where(is_query).groupBy(F.col("vec_id").alias("id")).agg(F.min(F.struct("vec", "dim")).alias("s"))
    queries = queries.select(F.col("id").alias("vec_id"), "s.dim", "s.vec")
    cols = ["query_id", "rank", "vec_id", "score"]
    found = materialize(_round(vecs, queries, tops, sample, directions(total), k).select(*cols), "found")
    reach = F.create_map(*[F.lit(x) for r in sizes for x in (r["dim"], min(k, r["n"] - 1))]) if sizes else F.lit(None)
    got = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count(F.lit(1)).alias("got"))
    short = (queries.join(got, "vec_id", "left").where(F.coalesce("got", F.lit(0)) < reach[F.col("dim")]).select("vec_id", "dim", "vec")
             if sizes else queries)
    short = materialize(short, "short")
    if short.isEmpty():
        return found
    more = _round(vecs, short, tops, sample, 0, k).select(*cols)
    return found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(more)


def _largest_norms(vecs: DataFrame) -> dict:
    def run(batches):
        for b in batches:
            dims = b.column(0).to_numpy(zero_copy_only=False)
            vec = b.column(1).to_pylist()
            top: dict = {}
            for d in np.unique(dims):
                x = np.frombuffer(b"".join(vec[i] for i in np.flatnonzero(dims == d))).reshape(-1, d)
                top[int(d)] = float(np.sqrt((x * x).sum(1)).max())
            yield pa.RecordBatch.from_pydict({"dim": pa.array(list(top), pa.int32()), "top": pa.array(list(top.values()), pa.float64())})

    return {r["dim"]: r["top"] for r in vecs.select("dim", "vec").mapInArrow(run, "dim int, top double")
            .groupBy("dim").agg(F.max("top").alias("top")).collect()}
