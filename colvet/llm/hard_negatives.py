"""Hard-negative mining over Hilbert-ordered blocks with zone maps.

Vectors are scaled to integers. Candidates are ordered by label and by their place
on a Hilbert curve through the components that vary most, and written as
Parquet blocks of up to ``BLOCK`` rows of one label; a block carries the least and
the greatest value of every component (its zone map). For an anchor a, interval
arithmetic bounds the inner products of a whole block,

    sum of min(a_k lo_k, a_k hi_k)  <=  a . x  <=  sum of max(a_k lo_k, a_k hi_k),

so a block is read only where these bounds meet what the anchor still looks for:

1. each anchor reads the one block of its label with the best upper bound; its
   k-th best there is a floor under its k best positives;
2. the blocks of its label whose upper bound reaches that floor give the positives;
3. every positive opens a window of admitted negative scores; the blocks of other
   labels whose bounds meet a window give its best negatives.

Anchors go in tiles of ``TILE``; a tile meets the zone maps page by page and then the
blocks that it needs in spans of ``SPAN``, one block at a time, keeping the best k
per window. Nothing is sampled: bounds only skip what cannot count.

Defined results: rows with a null id, label or vector, or a null or non-finite
component take no part; neither do rows so large that a score need not fit a
long (components times the square of the largest scaled one above 2**62). Rows
equal in id, label and vector count once; rows with the anchor's id are never
its positives or negatives. Vectors of different lengths are never compared; the score
of empty vectors is 0. An empty table gives an empty result. Extra columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_texts, materialize

SCALE, BLOCK, TILE, SPAN, PAGE = 256, 512, 4096, 64, 2048
#: Components that the curve runs through, and the bits of each.
AXES, BITS = 8, 7
_LEAST = np.iinfo(np.int64).min


def scaled(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(vec_id, label, dim, vec)``: distinct rows that take part, ``floor(SCALE * x)`` as 32-bit
    or, where a component needs it, 64-bit integers (``wide``)."""
    def run(batches):
        for b in batches:
            ids, labels, dims, vecs, wide = [], [], [], [], []
            for i, lab, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                x = v.values
                if x.null_count:
                    continue
                x = np.floor(SCALE * x.to_numpy(zero_copy_only=False).astype(np.float64))
                top = float(np.abs(x).max(initial=0.0))
                if not np.isfinite(x).all() or len(x) * top * top > 2.0**62:
                    continue
                wide.append(top >= 2**31)
                ids.append(i)
                labels.append(lab)
                dims.append(len(x))
                vecs.append(x.astype(np.int64 if wide[-1] else np.int32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(labels, pa.int64()), pa.array(dims, pa.int32()), pa.array(vecs, pa.binary()),
                 pa.array(wide, pa.bool_())], names=["vec_id", "label", "dim", "vec", "wide"])

    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"),
                     F.col(vec_col).cast("array<double>").alias("v")).where("vec_id is not null and label is not null and v is not null")
    return rows.mapInArrow(run, "vec_id long, label long, dim int, vec binary, wide boolean").distinct()


def _values(vec: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(vec, np.int64 if wide else np.int32)


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``x`` (integers below 2**bits): Gray-code walk
    from the most significant bit, each level turned into the frame of its cell."""
    x = x.astype(np.int64).copy()
    n, d = x.shape
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for k in range(d):
            upper = (x[:, k] >> level & 1).astype(bool)
            swap = np.where(upper, 0, (x[:, 0] ^ x[:, k]) & low)
            x[:, 0] ^= np.where(upper, low, swap)
            x[:, k] ^= swap
    for k in range(1, d):
        x[:, k] ^= x[:, k - 1]
    turn = np.zeros(n, np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[:, d - 1] >> level & 1, (1 << level) - 1, 0)
    x ^= turn[:, None]
    key = np.zeros(n, np.int64)
    for level in range(bits - 1, -1, -1):
        for k in range(d):
            key = key << 1 | x[:, k] >> level & 1
    return key


def _axes(rows: DataFrame) -> DataFrame:
    """``(dim, ks, lo, hi)``: per vector length, the ``AXES`` components of the largest variance and their range."""
    def run(batches):
        sums = {}
        for b in batches:
            for dim, vec, wide in zip(*(b.column(k).to_pylist() for k in range(3))):
                x = _values(vec, wide).astype(np.float64)
                s = sums.get(dim)
                if s is None:
                    sums[dim] = [1, x.copy(), x * x, x.copy(), x.copy()]
                else:
                    s[0] += 1
                    s[1] += x
                    s[2] += x * x
                    np.minimum(s[3], x, out=s[3])
                    np.maximum(s[4], x, out=s[4])
            if len(sums) > 1000:
                yield _axis_rows(sums)
                sums = {}
        if sums:
            yield _axis_rows(sums)

    part = rows.select("dim", "vec", "wide").mapInArrow(run, "dim int, k int, n double, s double, q double, lo double, hi double")
    each = part.groupBy("dim", "k").agg(*[F.sum(c).alias(c) for c in "nsq"], F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    var = F.col("q") / F.col("n") - (F.col("s") / F.col("n")) * (F.col("s") / F.col("n"))
    rank = F.row_number().over(Window.partitionBy("dim").orderBy(var.desc(), "k"))
    top = each.withColumn("r", rank).where(F.col("r") <= AXES)
    return top.groupBy("dim").agg(F.sort_array(F.collect_list(F.struct("k", "lo", "hi"))).alias("axes"))


def _axis_rows(sums: dict):
    cols = [[], [], [], [], [], [], []]
    for dim, (n, s, q, lo, hi) in sums.items():
        for c, v in zip(cols, ([dim] * dim, range(dim), [float(n)] * dim, s, q, lo, hi)):
            c.extend(v)
    types = [pa.int32(), pa.int32()] + [pa.float64()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["dim", "k", "n", "s", "q", "lo", "hi"])


def _placed(rows: DataFrame) -> DataFrame:
    """``rows`` with their place on the curve (``key``)."""
    def run(batches):
        for b in batches:
            cells = np.zeros((b.num_rows, AXES), np.int64)
            vec, wide, axes = (b.column(k).to_pylist() for k in (3, 4, 5))
            for i, (v, w, ax) in enumerate(zip(vec, wide, axes)):
                x = _values(v, w)
                for j, a in enumerate(ax or ()):
                    if a["hi"] > a["lo"]:
                        cells[i, j] = min((1 << BITS) - 1, int((float(x[a["k"]]) - a["lo"]) / (a["hi"] - a["lo"]) * (1 << BITS)))
            yield pa.RecordBatch.from_arrays([b.column(k) for k in range(5)] + [pa.array(hilbert(cells, BITS), pa.int64())],
                                             names=["vec_id", "label", "dim", "vec", "wide", "key"])

    joined = rows.join(_axes(rows), "dim", "left").select("vec_id", "label", "dim", "vec", "wide", "axes")
    return joined.mapInArrow(run, "vec_id long, label long, dim int, vec binary, wide boolean, key long")


_BLOCK = "block long, dim int, n int, wide boolean, ids binary, labels binary, vecs binary, lo binary, hi binary"


def _blocks(placed: DataFrame, size: int, one_label: bool) -> DataFrame:
    """Blocks of up to ``size`` rows of one length (and one label) along the curve. Inside
    a block rows go by id. Numbers are partition and place, the same on a rerun."""
    def flush(number, dim, held):
        held.sort(key=lambda r: r[0])
        wide = any(r[4] for r in held)
        m = np.array([_values(r[3], r[4]) for r in held]).reshape(len(held), dim).astype(np.int64 if wide else np.int32)
        zone = [m.min(0), m.max(0)]
        return (number, dim, len(held), wide, np.array([r[0] for r in held], np.int64).tobytes(),
                np.array([r[1] for r in held], np.int64).tobytes(), m.tobytes(), *(z.astype(np.int64).tobytes() for z in zone))

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        key, held = None, []
        for b in batches:
            out = []
            for r in zip(*(b.column(k).to_pylist() for k in range(5))):
                now = (r[2], r[1] if one_label else None)
                if held and (now != key or len(held) >= size):
                    out.append(flush(number, key[0], held))
                    number, held = number + 1, []
                key = now
                held.append(r)
            if out:
                yield _pack(out, _BLOCK)
        if held:
            yield _pack([flush(number, key[0], held)], _BLOCK)

    order = ["dim", *(["label"] if one_label else []), "key", "vec_id", "label", "vec"]
    order = list(dict.fromkeys(order))
    rows = placed.repartitionByRange(*order).sortWithinPartitions(*order).select("vec_id", "label", "dim", "vec", "wide")
    return map_texts(rows, run, _BLOCK)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "double": pa.float64()}


def _pack(rows: list, schema: str):
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


_PAGE = "page_dim int, count int, blocks binary, labels binary, lo binary, hi binary"


def _pages(blocks: DataFrame) -> DataFrame:
    """Zone maps of up to ``PAGE`` blocks per row, the pages numbered from 0."""
    def run(batches):
        dim, held = None, []

        def flush():
            return _pack([(dim, len(held), np.array([h[0] for h in held], np.int64).tobytes(), b"".join(h[2][:8] for h in held),
                           b"".join(h[3] for h in held), b"".join(h[4] for h in held))], _PAGE)

        for b in batches:
            for r in zip(*(b.column(k).to_pylist() for k in range(5))):
                if held and (r[1] != dim or len(held) >= PAGE):
                    yield flush()
                    held = []
                dim = r[1]
                held.append(r)
        if held:
            yield flush()

    zones = blocks.select("block", "dim", "labels", "lo", "hi")
    spread = zones.repartitionByRange("dim", "block").sortWithinPartitions("dim", "block")
    pages = materialize(map_texts(spread, run, _PAGE).withColumn("at", F.monotonically_increasing_id()), "zone-pages")
    # a page's number is its place among the first pages of the partitions
    part = F.shiftright("at", 33)
    sizes = pages.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    first = sizes.select("part", F.coalesce(before, F.lit(0)).alias("first"))
    return pages.join(F.broadcast(first), part == F.col("part")).withColumn(
        "page", F.col("first") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("at", "part", "first")


def _exact(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether products of rows of a and b are exact in double precision."""
    return a.shape[-1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) < 2.0**53


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of a with the rows of b."""
    if _exact(a, b):
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def bounds(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple:
    """Lower and upper bounds of each row of a with each box, widened where doubles round."""
    a, lo, hi = (x.astype(np.float64) for x in (a, lo, hi))
    plus, minus = np.maximum(a, 0), np.minimum(a, 0)
    least, most = plus @ lo.T + minus @ hi.T, plus @ hi.T + minus @ lo.T
    if not (_exact(a, lo) and _exact(a, hi)):
        slack = 1e-9 * (np.abs(a) @ np.maximum(np.abs(lo), np.abs(hi)).T) + 1
        least, most = least - slack, most + slack
    return least, most


class Tile:
    """Anchors of one tile with the windows of scores that they look for."""

    def __init__(self, r: dict):
        self.n, self.dim = r["n"], r["dim"]
        self.ids, self.labels = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], np.int64)
        self.a = _values(r["vecs"], r["wide"]).reshape(self.n, self.dim)
        # windows: (anchors, w) floors and ceilings; an anchor without a window has floor > ceiling
        self.low = np.frombuffer(r["low"], np.int64).reshape(self.n, -1)
        self.high = np.frombuffer(r["high"], np.int64).reshape(self.n, -1)


_TILE = "tile long, dim int, n int, wide boolean, ids binary, labels binary, vecs binary, low binary, high binary"
_NEED = "tile long, anchor int, block long, upper double"


def _meet(tiles: DataFrame, pages: DataFrame, n_pages: int, run, schema: str) -> DataFrame:
    """``run(tile, page)`` rows of every tile with every page of zone maps of its length."""
    def each(batches):
        for b in batches:
            for r in b.to_pylist():
                rows = run(r["tile"], Tile(r), np.frombuffer(r["blocks"], np.int64), np.frombuffer(r["zone_labels"], np.int64),
                           np.frombuffer(r["lo"], np.int64).reshape(r["count"], -1), np.frombuffer(r["hi"], np.int64).reshape(r["count"], -1))
                if rows:
                    yield _pack(rows, schema)

    met = tiles.withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(n_pages - 1)).cast("array<long>"))).join(
        pages.withColumnRenamed("labels", "zone_labels"), "page").where("dim = page_dim")
    return map_texts(met, each, schema)


def _best_blocks(tiles, pages, n_pages) -> DataFrame:
    """``(tile, block)``: for each anchor the block of its label with the best upper bound."""
    def run(tile, t, blocks, labels, lo, hi):
        upper = np.where(t.labels[:, None] == labels[None, :], bounds(t.a, lo, hi)[1], -np.inf)
        best = upper.argmax(1)
        top = upper[np.arange(t.n), best]
        return [(tile, int(i), int(blocks[best[i]]), float(top[i])) for i in np.flatnonzero(top > -np.inf)]

    each = _meet(tiles, pages, n_pages, run, _NEED)
    return each.groupBy("tile", "anchor").agg(F.max(F.struct("upper", "block"))["block"].alias("block")).select("tile", "block").distinct()


def _needed(tiles, pages, n_pages, same: bool) -> DataFrame:
    """``(tile, block)``: blocks of the anchors' own label (or of others) whose bounds meet a window of an anchor."""
    def run(tile, t, blocks, labels, lo, hi):
        least, most = bounds(t.a, lo, hi)
        wanted = np.zeros(least.shape, bool)
        for w in range(t.low.shape[1]):
            low, high = t.low[:, w, None], t.high[:, w, None]
            wanted |= (low <= high) & (most >= low) & (least <= high)
        wanted &= (t.labels[:, None] == labels[None, :]) == same
        return [(tile, int(b)) for b in blocks[wanted.any(0)]]

    return _meet(tiles, pages, n_pages, run, "tile long, block long")


class Best:
    """The k best rows per anchor and window seen so far."""

    def __init__(self, tile: Tile, k: int, same: bool):
        self.t, self.k, self.same = tile, k, same
        self.scores = np.full((*tile.low.shape, k), _LEAST)
        self.ids = np.zeros((*tile.low.shape, k), np.int64)

    def read(self, ids: np.ndarray, label: int, vecs: np.ndarray) -> None:
        t = self.t
        who = np.flatnonzero((t.labels == label) == self.same)
        if not len(who):
            return
        score = products(t.a[who], vecs)
        score = np.where(t.ids[who][:, None] == ids[None, :], _LEAST, score)
        for w in range(t.low.shape[1]):
            fits = (score >= t.low[who, w][:, None]) & (score <= t.high[who, w][:, None]) & (score > _LEAST)
            fits &= score >= self.scores[who, w, -1][:, None]
            rows = np.flatnonzero(fits.any(1))
            if not len(rows):
                continue
            mine = np.where(fits[rows], score[rows], _LEAST)
            if mine.shape[1] > self.k:  # nothing below the k-th best here can stay
                mine = np.where(mine >= np.partition(mine, -self.k, axis=1)[:, -self.k][:, None], mine, _LEAST)
            i, j = np.nonzero(mine > _LEAST)
            at = who[rows]
            i = np.concatenate((i, np.repeat(np.arange(len(rows)), self.k)))
            s = np.concatenate((mine[mine > _LEAST], self.scores[at, w].ravel()))
            v = np.concatenate((ids[j], self.ids[at, w].ravel()))
            order = np.lexsort((v, -np.maximum(s, _LEAST + 1), i))
            i, s, v = i[order], s[order], v[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            top = place < self.k
            self.scores[at[i[top]], w, place[top]] = s[top]
            self.ids[at[i[top]], w, place[top]] = v[top]

    def rows(self, tile: int) -> list:
        a, w, p = np.nonzero(self.scores > _LEAST)
        return list(zip([tile] * len(a), a.tolist(), w.tolist(), self.ids[a, w, p].tolist(), self.scores[a, w, p].tolist()))


_FOUND = "tile long, anchor int, slot int, vec_id long, score long"


def _scan(tiles: DataFrame, blocks: DataFrame, needs: DataFrame, k: int, same: bool) -> DataFrame:
    """``(tile, anchor, slot, vec_id, score)``: the k best rows of each window among the needed
    blocks. A tile and a span of its blocks follow each other in one task."""
    def run(batches):
        group, best = None, None
        for b in batches:
            for r in b.to_pylist():
                if (r["tile"], r["span"]) != group:
                    if best is not None and (rows := best.rows(group[0])):
                        yield _pack(rows, _FOUND)
                    group, best = (r["tile"], r["span"]), None
                if r["block"] is None:
                    best = Best(Tile(r), k, same)
                else:
                    vecs = _values(r["vecs"], r["wide"]).reshape(r["n"], r["dim"])
                    best.read(np.frombuffer(r["ids"], np.int64), int(np.frombuffer(r["labels"], np.int64)[0]), vecs)
        if best is not None and (rows := best.rows(group[0])):
            yield _pack(rows, _FOUND)

    needs = needs.withColumn("span", F.floor(F.col("block") / SPAN).cast("long"))
    cols = ["dim", "n", "wide", "ids", "labels", "vecs", "low", "high"]
    none = F.lit(None).cast("binary")
    left = needs.select("tile", "span").distinct().join(tiles, "tile").select("tile", "span", F.lit(None).cast("long").alias("block"), *cols)
    right = needs.join(blocks.drop("lo", "hi"), "block").withColumn("low", none).withColumn("high", none).select("tile", "span", "block", *cols)
    both = left.unionByName(right).repartition("tile", "span").sortWithinPartitions("tile", "span", F.col("block").asc_nulls_first())
    best = map_texts(both, run, _FOUND)
    rank = F.row_number().over(Window.partitionBy("tile", "anchor", "slot").orderBy(F.col("score").desc(), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def _with_windows(tiles: DataFrame, rows: DataFrame, slots: int, low, high) -> DataFrame:
    """``tiles`` with windows ``[low, high]`` from ``rows`` (tile, anchor, slot, ...); places without a row stay
    empty (floor above ceiling). At most TILE x slots rows meet in a tile."""
    given = rows.groupBy("tile").agg(F.collect_list(F.struct("anchor", "slot", low.alias("low"), high.alias("high"))).alias("given"))

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                lo = np.full((r["n"], slots), 1, np.int64)
                hi = np.zeros((r["n"], slots), np.int64)
                for g in r["given"] or ():
                    lo[g["anchor"], g["slot"]], hi[g["anchor"], g["slot"]] = g["low"], g["high"]
                out.append((r["tile"], r["dim"], r["n"], r["wide"], r["ids"], r["labels"], r["vecs"], lo.tobytes(), hi.tobytes()))
            yield _pack(out, _TILE)

    return map_texts(tiles.drop("low", "high").join(given, "tile", "left"), run, _TILE)


def mine(df: DataFrame, anchors, positives: int = 5, negatives: int = 5, least_percent: int = 80,
         id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``. ``anchors`` is a condition on
    ``vec_id``. Of each anchor's ``positives`` best rows of its label, the ``negatives`` best rows of
    other labels with ``least_percent`` to 100 percent of the positive's score."""
    placed = materialize(_placed(materialize(scaled(df, id_col, vec_col, label_col), "scaled")), "placed")
    blocks = materialize(_blocks(placed, BLOCK, True), "blocks")
    pages = materialize(_pages(blocks), "pages")
    n_pages = pages.count()
    open_low = F.lit(-(2**63) + 1).cast("long")
    open_high = F.lit(2**63 - 1).cast("long")
    tiles = _blocks(placed.where(anchors), TILE, False).withColumnRenamed("block", "tile").drop("lo", "hi")
    tiles = materialize(tiles, "tiles")
    every = tiles.select("tile", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("anchor"))
    wide_open = _with_windows(tiles, every.withColumn("slot", F.lit(0)), 1, open_low, open_high)
    wide_open = materialize(wide_open, "tiles-open")
    if not n_pages:
        n_pages = 1  # no rows: nothing joins
    seed = _scan(wide_open, blocks, materialize(_best_blocks(wide_open, pages, n_pages), "seed-blocks"), positives, True)
    floor = seed.where(F.col("rank") == positives).select("tile", "anchor", F.col("score").alias("floor"))
    floored = every.join(floor, ["tile", "anchor"], "left").withColumn("slot", F.lit(0))
    tiles_floor = materialize(_with_windows(tiles, floored, 1, F.coalesce("floor", open_low), open_high), "tiles-floor")
    need = materialize(_needed(tiles_floor, pages, n_pages, True), "positive-blocks")
    pos = _scan(tiles_floor, blocks, need, positives, True).select(
        "tile", "anchor", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    pos = materialize(pos, "positives")
    # least percent of the score, rounded up: p - floor(p * off / 100), no product of p itself
    off = 100 - least_percent
    p = F.col("positive_score")
    rest = F.pmod(p, F.lit(100))
    low = p - F.expr("(positive_score - pmod(positive_score, 100)) div 100") * off - F.floor(rest * off / 100)
    tiles_windows = materialize(_with_windows(tiles, pos, positives, low, p), "tiles-windows")
    need = materialize(_needed(tiles_windows, pages, n_pages, False), "negative-blocks")
    neg = _scan(tiles_windows, blocks, need, negatives, False)
    names = _anchor_ids(tiles)
    return (pos.join(neg.select("tile", "anchor", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")),
                     ["tile", "anchor", "slot"]).join(names, ["tile", "anchor"])
               .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"))


def _anchor_ids(tiles: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            for tile, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.frombuffer(ids, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), tile)), pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(ids)],
                                                 names=["tile", "anchor", "anchor_id"])

    return tiles.select("tile", "ids").mapInArrow(run, "tile long, anchor int, anchor_id long")


def relabelled(df: DataFrame) -> DataFrame:
    """The rows with ``label`` moved on by one (modulo 10) where the id is divisible by 7."""
    return df.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


#: The same result from all scores of every anchor.
ORACLE = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
pos AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same) q WHERE k <= 5),
neg AS (
  SELECT pos.*, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY pos.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS k
  FROM pos JOIN s ON s.anchor_id = pos.anchor_id AND NOT same
    AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
SELECT anchor_id, positive_id, CAST(k AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM neg WHERE k <= 5
"""
