"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors are rotated onto their principal axes and sorted by the grid
cells (side ``eps``, the chord length of the cosine threshold) of the leading
``LEADING`` axes. The sorted sequence is cut into intervals; each interval
keeps the bounding box of its vectors on the leading axes and of the length of
what the other axes hold. Two intervals join recursively: a pair of intervals
is split into its sub-intervals and a pair whose boxes lie more than ``eps``
apart is skipped (the distance of the boxes is a lower bound of every distance
between their vectors). Inside a task the same recursion goes on down to
``LEAF`` vectors, which meet as one matrix product in double precision.

Neither links nor pairs are emitted for all of a group: a joined pair of
intervals gives one link count per vector and a spanning forest of its links.

Defined results: a vector that is null, empty, zero, or holds null or
non-finite components links with nothing. Vectors of different lengths never
link. Equal vectors are one class (their copies count as links and are not
compared). Repeated ids are rows of their own, each with its own vector's
result, and are not told apart as links' ends. Extra columns are ignored. An
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .components import components

LEADING = 8
INTERVAL = 8192
FAN = 8
LEAF = 512
#: Slack of the box test for rounding in the rotation.
SLACK = 1e-9


def vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(vec_id, dim, vec binary)``: rows whose vector takes part, as doubles."""
    def run(batches):
        for b in batches:
            ids, keep, dims, out = b.column(0), [], [], []
            for i, v in enumerate(b.column(1).to_pylist()):
                if not v or any(x is None for x in v):
                    continue
                a = np.array(v, np.float64) + 0.0
                if np.isfinite(a).all() and a.any():
                    keep.append(i)
                    dims.append(len(a))
                    out.append(a.tobytes())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(keep, pa.int64())), pa.array(dims, pa.int32()),
                                              pa.array(out, pa.binary())], names=["vec_id", "dim", "vec"])

    src = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    return src.mapInArrow(run, "vec_id long, dim int, vec binary")


def unit(raw: np.ndarray) -> np.ndarray:
    top = np.abs(raw).max(axis=1, keepdims=True)
    raw = raw / top
    return raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))


def principal_axes(vecs: DataFrame) -> dict:
    """Rotation per vector length, from the second moments of every unit vector.
    The driver receives ``dim * dim`` sums per length, however many rows."""
    def run(batches):
        acc: dict = {}
        for b in batches:
            dims = b.column(1).to_numpy(zero_copy_only=False)
            vec = b.column(2).to_pylist()
            for d in np.unique(dims):
                u = unit(np.frombuffer(b"".join(vec[i] for i in np.flatnonzero(dims == d))).reshape(-1, d))
                acc[int(d)] = acc.get(int(d), 0.0) + u.T @ u
        for d, m in acc.items():
            k = np.arange(d * d)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, d, np.int32)), pa.array(k.astype(np.int32)),
                                              pa.array(m.ravel())], names=["dim", "k", "s"])

    sums = vecs.mapInArrow(run, "dim int, k int, s double").groupBy("dim", "k").agg(F.sum("s").alias("s")).toPandas()
    axes = {}
    for d, g in sums.groupby("dim"):
        _, rot = np.linalg.eigh(g.sort_values("k").s.to_numpy().reshape(d, d))
        axes[int(d)] = np.ascontiguousarray(rot[:, ::-1])
    return axes


def reduced(rot: np.ndarray) -> np.ndarray:
    """Leading coordinates and the length of the rest: distances between these
    rows never exceed distances between the vectors."""
    lead = np.zeros((len(rot), LEADING))  # short vectors: the missing axes are 0
    lead[:, :min(LEADING, rot.shape[1])] = rot[:, :LEADING]
    rest = np.sqrt((rot[:, LEADING:] ** 2).sum(axis=1, keepdims=True))
    return np.concatenate((lead, rest), axis=1)


def _apart(lo1, hi1, lo2, hi2) -> float:
    gap = np.maximum(0.0, np.maximum(lo1 - hi2, lo2 - hi1))
    return float((gap * gap).sum())


def join_intervals(ua, ra, ub, rb, same: bool, cos: float, eps2: float):
    """Recursive join of two sequence intervals; yields ``(rows, columns)`` of
    linked vectors. ``same``: both are one interval (each pair once)."""
    todo = [(0, len(ua), 0, len(ub))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if same and b1 <= a0:
            continue
        if _apart(ra[a0:a1].min(0), ra[a0:a1].max(0), rb[b0:b1].min(0), rb[b0:b1].max(0)) > eps2 + SLACK:
            continue
        if max(a1 - a0, b1 - b0) > LEAF:
            ma, mb = (a0 + a1) // 2, (b0 + b1) // 2
            todo += [(x, y, z, w) for x, y in ((a0, ma), (ma, a1)) for z, w in ((b0, mb), (mb, b1)) if x < y and z < w]
            continue
        s = ua[a0:a1] @ ub[b0:b1].T
        i, j = np.nonzero(s >= cos)
        i, j = i + a0, j + b0
        if same:
            up = i < j
            i, j = i[up], j[up]
        if len(i):
            yield i, j


class Forest:
    """Union-find with the edges that joined two trees."""

    def __init__(self, n):
        self.up = np.arange(n)
        self.edges = []

    def root(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def add(self, i, j):
        # most links of a tight group fall into one tree: drop those in bulk
        while len(i):
            while (self.up[self.up] != self.up).any():
                self.up = self.up[self.up]
            ri, rj = self.up[i], self.up[j]
            new = ri != rj
            i, j, ri, rj = i[new], j[new], ri[new], rj[new]
            if not len(i):
                return
            lo, hi = np.minimum(ri, rj), np.maximum(ri, rj)
            at = np.unique(hi, return_index=True)[1]
            self.up[hi[at]] = lo[at]
            self.edges += list(zip(i[at].tolist(), j[at].tolist()))


def _ordered(classes: DataFrame, axes: dict, eps: float) -> DataFrame:
    """``(cls, w, dim, cell array<int>, vec)`` with the grid cells on the leading axes."""
    def run(batches):
        for b in batches:
            dims = b.column(2).to_numpy(zero_copy_only=False)
            vec = b.column(3).to_pylist()
            cell = np.zeros((len(vec), LEADING), np.int32)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = unit(np.frombuffer(b"".join(vec[i] for i in at)).reshape(-1, d)) @ axes[int(d)]
                k = min(LEADING, d)
                cell[at, :k] = np.floor(x[:, :k] / eps)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.FixedSizeListArray.from_arrays(pa.array(cell.ravel()), LEADING).cast(pa.list_(pa.int32()))],
                names=["cls", "w", "dim", "vec", "cell"])

    return classes.select("cls", "w", "dim", "vec").mapInArrow(run, "cls long, w long, dim int, vec binary, cell array<int>")


def _intervals(seq: DataFrame, axes: dict) -> DataFrame:
    """Cut each sorted partition into intervals: ``(iv, dim, lo, hi, ids, ws, vecs)``."""
    def run(batches):
        import pyspark
        part = pyspark.TaskContext.get().partitionId()
        held, dim, n = [], None, 0

        def flush():
            nonlocal held, n
            ids, ws, vec = (np.concatenate([h[k] for h in held]) if k < 2 else b"".join(h[k] for h in held) for k in range(3))
            r = reduced(unit(np.frombuffer(vec).reshape(-1, dim)) @ axes[dim])
            row = {"iv": [(part << 32) + n], "dim": [dim], "lo": [r.min(0).tolist()], "hi": [r.max(0).tolist()],
                   "ids": [ids.tolist()], "ws": [ws.tolist()], "vecs": [vec]}
            held, n = [], n + 1
            return pa.RecordBatch.from_pydict(row, schema=out)

        out = pa.schema([("iv", pa.int64()), ("dim", pa.int32()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())),
                         ("ids", pa.list_(pa.int64())), ("ws", pa.list_(pa.int64())), ("vecs", pa.binary())])
        for b in batches:
            ids, ws, dims = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
            vec = b.column(3).to_pylist()
            cuts = np.flatnonzero(np.diff(dims)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(dims)]):
                while lo < hi:
                    if held and dim != int(dims[lo]):
                        yield flush()
                    dim = int(dims[lo])
                    have = sum(len(h[0]) for h in held)
                    to = min(hi, lo + INTERVAL - have)
                    held.append((ids[lo:to], ws[lo:to], b"".join(vec[lo:to])))
                    if have + to - lo >= INTERVAL:
                        yield flush()
                    lo = to
        if held:
            yield flush()

    return seq.select("cls", "w", "dim", "vec").mapInArrow(
        run, "iv long, dim int, lo array<double>, hi array<double>, ids array<long>, ws array<long>, vecs binary")


def _box_gap():
    """Squared distance of the boxes (lo, hi) and (lo2, hi2)."""
    gaps = F.transform(F.arrays_zip("lo", "hi", "lo2", "hi2"),
                       lambda z: F.greatest(F.lit(0.0), z["lo"] - z["hi2"], z["lo2"] - z["hi"]))
    return F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g)


def _interval_pairs(boxes: DataFrame, eps2: float) -> DataFrame:
    """``(a, b)``, a <= b: interval pairs that are not provably distant, by
    descending a tree of ever smaller sequence intervals from the whole
    sequence; each step joins a pair's children by the parents' numbers."""
    at = F.row_number().over(Window.partitionBy("dim").orderBy("iv")) - 1
    level = materialize(boxes.withColumn("n", at.cast("long")), "boxes")
    levels = [level]
    while levels[-1].agg(F.max("n")).first()[0]:
        up = levels[-1].groupBy("dim", F.floor(F.col("n") / FAN).cast("long").alias("n")).agg(
            *[F.array(*[f(F.col(side)[k]) for k in range(LEADING + 1)]).alias(side)
              for side, f in (("lo", F.min), ("hi", F.max))])
        levels.append(materialize(up, "boxes"))
    pairs = levels[-1].select("dim", F.col("n").alias("a"), F.col("n").alias("b"))
    for lev in levels[-2::-1]:
        kid = lev.select("dim", "n", "lo", "hi", F.floor(F.col("n") / FAN).cast("long").alias("up"))
        left = kid.select("dim", F.col("up").alias("a"), F.col("n").alias("ka"), "lo", "hi")
        right = kid.select("dim", F.col("up").alias("b"), F.col("n").alias("kb"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
        pairs = (pairs.join(left, ["dim", "a"]).join(right, ["dim", "b"]).where("ka <= kb")
                      .where(_box_gap() <= F.lit(eps2 + SLACK)).select("dim", F.col("ka").alias("a"), F.col("kb").alias("b")))
    name = level.select("dim", "n", "iv")
    return (pairs.join(name.select("dim", F.col("n").alias("a"), F.col("iv").alias("iva")), ["dim", "a"])
                 .join(name.select("dim", F.col("n").alias("b"), F.col("iv").alias("ivb")), ["dim", "b"])
                 .select("iva", "ivb"))


def _join_pairs(joined: DataFrame, axes: dict, cos: float, eps2: float) -> DataFrame:
    """Rows ``(a, b, n)``: n > 0 counts the links of vector a, b null; n = 0 is
    an edge (a, b) of the pair's spanning forest."""
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                rot = axes[r["dim"]]
                same = r["iva"] == r["ivb"]
                ua = unit(np.frombuffer(r["vecs"]).reshape(-1, r["dim"]))
                ub = ua if same else unit(np.frombuffer(r["vecs2"]).reshape(-1, r["dim"]))
                ra = reduced(ua @ rot)
                rb = ra if same else reduced(ub @ rot)
                ida, wa = np.array(r["ids"]), np.array(r["ws"], np.float64)
                idb, wb = (ida, wa) if same else (np.array(r["ids2"]), np.array(r["ws2"], np.float64))
                na, nb = np.zeros(len(ida)), np.zeros(len(idb))
                tree = Forest(len(ida) if same else len(ida) + len(idb))
                shift = 0 if same else len(ida)
                for i, j in join_intervals(ua, ra, ub, rb, same, cos, eps2):
                    na += np.bincount(i, wb[j], len(na))
                    nb += np.bincount(j, wa[i], len(nb))
                    tree.add(i, j + shift)
                both = np.concatenate((ida, idb))
                n = np.concatenate((na, nb))
                hit = np.flatnonzero(n)
                e = np.array(tree.edges, np.int64).reshape(-1, 2)
                names = ida if same else both
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate((both[hit], names[e[:, 0]]))),
                     pa.array(np.concatenate((both[hit], names[e[:, 1]]))),
                     pa.array(np.concatenate((n[hit], np.zeros(len(e)))).astype(np.int64))], names=["a", "b", "n"])

    return joined.mapInArrow(run, "a long, b long, n long")


def near_duplicates(df: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per row of ``df``:
    links are pairs with cosine of at least ``cosine`` (above 0)."""
    spark = df.sparkSession
    eps2 = 2.0 - 2.0 * cosine
    eps = eps2 ** 0.5
    vecs = materialize(vectors(df, id_col, vec_col).withColumn("digest", F.sha2("vec", 256)), "vectors")
    # equal vectors are one class of weight w; a class is named by a hash
    classes = (vecs.groupBy("digest").agg(F.count(F.lit(1)).alias("w"), F.first("dim").alias("dim"), F.first("vec").alias("vec"))
                   .withColumn("cls", F.xxhash64("digest")))
    classes = materialize(classes, "classes")
    axes = principal_axes(vecs.select("vec_id", "dim", "vec"))
    parts = max(1, -(-classes.count() // (4 * INTERVAL)))
    seq = (_ordered(classes, axes, eps)
           .repartitionByRange(parts, "dim", *[F.col("cell")[k] for k in range(LEADING)], "cls")
           .sortWithinPartitions("dim", *[F.col("cell")[k] for k in range(LEADING)], "cls"))
    ivs = materialize(_intervals(seq, axes), "intervals")
    pairs = _interval_pairs(ivs.select("iv", "dim", "lo", "hi"), eps2)
    joined = (pairs.repartition(max(8, spark.sparkContext.defaultParallelism), "iva", "ivb")
                   .join(ivs.select(F.col("iv").alias("iva"), "dim", "ids", "ws", "vecs"), "iva")
                   .join(ivs.select(F.col("iv").alias("ivb"), F.col("ids").alias("ids2"), F.col("ws").alias("ws2"),
                                    F.col("vecs").alias("vecs2")), "ivb"))
    joined = joined.repartition(F.col("iva"), F.col("ivb"))
    found = materialize(_join_pairs(joined, axes, cosine, eps2), "found")
    n = found.where("n > 0").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("n"))
    comp = components(found.where("n = 0").select("a", "b"))
    least = vecs.groupBy("digest").agg(F.min("vec_id").alias("rep"))
    named = (classes.select("digest", "cls", "w").join(least, "digest")
                    .join(comp.withColumnRenamed("node", "cls"), "cls", "left").join(n, "cls", "left")
                    .select("digest", "rep", F.coalesce("component", "cls").alias("component"),
                            (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links")))
    low = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    linked = (vecs.select("vec_id", "digest").join(named.join(low, "component"), "digest")
                  .select("vec_id", "n_links", "component_id"))
    rest = _excluded(df, id_col, vec_col).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(rest)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _excluded(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col).cast("array<double>")
    bad = (v.isNull() | (F.size(v) == 0) | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
           | ~F.exists(v, lambda x: F.coalesce(x, F.lit(0.0)) != 0.0))
    return df.where(F.coalesce(bad, F.lit(True))).select(F.col(id_col).cast("long").alias("vec_id"))
