"""Distribution shift between the early and late windows.

PSI and its variants are functions of CELLS. The PSI null distribution under
a random re-split of the pooled rows is drawn per feature from the
multivariate hypergeometric of the bin counts -- a group of at most
``max_levels + 2`` counts, handled in ``applyInPandas`` with a seed derived
from the feature name, so features run in parallel and results do not depend
on column order.

The joint (energy) test and the marginal AD / CvM tests read every row of both
windows, and so do their permutations: AD and CvM deal the early rows down a
tree of value ranges (``plans/dealing.py``), the energy test relabels rows by
keyed permutations along sorted projections.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.permutation import position
from ..functions.sampling import multivariate_hypergeometric
from ..plans.cumulative import cumulative
from ..plans.dealing import deal, marked_places, seeded
from ..policy import PSI_EPS, DSPolicy
from ..session import cut_lineage
from . import rank as R
from . import woe as W


def seed_of(name: str, base: int = 0) -> int:
    return (zlib.crc32(name.encode()) + base * 7919) % (2 ** 31 - 1)


def bin_counts(cells: DataFrame, binning: DataFrame) -> DataFrame:
    """(feature, bin_idx, n_core, ref, cur): complete per-bin counts, both windows."""
    full = W.complete_cells(cells, binning, ["early", "late"])
    piv = full.groupBy("feature", "bin_idx").agg(
        F.sum(F.when(F.col("window") == "early", F.col("n")).otherwise(0)).alias("ref"),
        F.sum(F.when(F.col("window") == "late", F.col("n")).otherwise(0)).alias("cur"))
    return piv.join(binning.select("feature", "n_core"), "feature")


def _contrib(df: DataFrame, keys=("feature",), eps: float = PSI_EPS) -> DataFrame:
    w = Window.partitionBy(*keys)
    p_ref = F.greatest(F.try_divide(F.col("ref"), F.sum("ref").over(w)), F.lit(eps))
    p_cur = F.greatest(F.try_divide(F.col("cur"), F.sum("cur").over(w)), F.lit(eps))
    return df.withColumn("contrib", (p_cur - p_ref) * F.log(p_cur / p_ref))


def psi(counts: DataFrame, eps: float = PSI_EPS) -> DataFrame:
    return _contrib(counts, eps=eps).groupBy("feature").agg(F.sum("contrib").alias("psi"))


def psi_excl_null(counts: DataFrame, eps: float = PSI_EPS) -> DataFrame:
    kept = counts.where(F.col("bin_idx") != F.col("n_core"))
    tot = kept.groupBy("feature").agg(F.sum("ref").alias("sr"), F.sum("cur").alias("sc"))
    ok = kept.join(tot.where((F.col("sr") > 0) & (F.col("sc") > 0)).select("feature"), "feature")
    val = psi(ok, eps).withColumnRenamed("psi", "psi_excl_null")
    return tot.select("feature").join(val, "feature", "left")


def top_bucket(counts: DataFrame, eps: float = PSI_EPS) -> DataFrame:
    """Bin with the largest PSI contribution, the lowest bin index on ties."""
    c = _contrib(counts, eps=eps)
    w = Window.partitionBy("feature").orderBy(F.col("contrib").desc(), F.col("bin_idx").asc())
    return (c.withColumn("rk", F.row_number().over(w)).where(F.col("rk") == 1)
             .select("feature", F.col("bin_idx").alias("top_bin_idx"), F.col("contrib").alias("top_contrib")))


def _psi_np(ref: np.ndarray, cur: np.ndarray, eps: float) -> np.ndarray:
    """Row-wise PSI of count matrices (draws x bins)."""
    pr = np.maximum(ref / ref.sum(axis=-1, keepdims=True), eps)
    pc = np.maximum(cur / cur.sum(axis=-1, keepdims=True), eps)
    return ((pc - pr) * np.log(pc / pr)).sum(axis=-1)


def draw_split(pooled: np.ndarray, n_ref: int, draws: int, rng) -> np.ndarray:
    """Early-window counts of ``draws`` random re-splits of the pooled counts."""
    return multivariate_hypergeometric(pooled, n_ref, draws, rng)


def psi_null(counts: DataFrame, draws: int = 200, base_seed: int = 0, eps: float = PSI_EPS) -> DataFrame:
    """Observed PSI, permutation p-value ``(1 + #{null >= obs}) / (B + 1)``,
    99 % quantile and median of the null, per feature."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin_idx")
        name = pdf["feature"].iloc[0]
        ref = pdf["ref"].to_numpy(dtype=np.int64)
        cur = pdf["cur"].to_numpy(dtype=np.int64)
        obs = float(_psi_np(ref[None, :].astype(float), cur[None, :].astype(float), eps)[0])
        pooled = ref + cur
        rng = np.random.default_rng(seed_of(name, base_seed))
        dr = draw_split(pooled, int(ref.sum()), draws, rng)
        null = _psi_np(dr.astype(float), (pooled[None, :] - dr).astype(float), eps)
        return pd.DataFrame({
            "feature": [name], "psi": [obs],
            "p_perm": [(1 + int(np.sum(null >= obs))) / (draws + 1)],
            "psi_null_q99": [float(np.quantile(null, 0.99))],
            "psi_null_median": [float(np.median(null))]})

    schema = ("feature string, psi double, p_perm double, psi_null_q99 double, "
              "psi_null_median double")
    return counts.select("feature", "bin_idx", "ref", "cur").groupBy("feature").applyInPandas(run, schema)


def null_shares(values: DataFrame) -> DataFrame:
    isnull = F.col("vnum").isNull() & F.col("vtxt").isNull()
    g = values.groupBy("feature").agg(
        F.sum(F.when(F.col("window") == "early", F.col("n")).otherwise(0)).alias("n_ref"),
        F.sum(F.when((F.col("window") == "early") & isnull, F.col("n")).otherwise(0)).alias("null_ref"),
        F.sum(F.when(F.col("window") == "late", F.col("n")).otherwise(0)).alias("n_cur"),
        F.sum(F.when((F.col("window") == "late") & isnull, F.col("n")).otherwise(0)).alias("null_cur"))
    return g.select("feature", (F.col("null_ref") / F.col("n_ref")).alias("null_share_ref"),
                    (F.col("null_cur") / F.col("n_cur")).alias("null_share_cur"),
                    (F.col("null_cur") / F.col("n_cur") - F.col("null_ref") / F.col("n_ref")).alias("null_share_delta"))


def scan(audit, policy: DSPolicy = DSPolicy(), labels: DataFrame | None = None) -> DataFrame:
    """Per column: PSI, its null (q99, permutation p), null-share movement,
    PSI without the null bin, top bucket; BH across columns; PSI / null q99."""
    from .binning import bin_labels
    counts = bin_counts(audit.cells, audit.binning)
    nul = psi_null(counts, policy.permutations)
    ex = psi_excl_null(counts)
    top = top_bucket(counts).join(bin_labels(audit.binning).withColumnRenamed("bin_idx", "top_bin_idx"),
                                  ["feature", "top_bin_idx"], "left")
    ns = null_shares(audit.values)
    b = audit.binning.select(F.col("feature"), F.col("degenerate"))
    rep = (b.join(ns, "feature", "left").join(nul, "feature", "left").join(ex, "feature", "left")
            .join(top.select("feature", F.col("bin").alias("top_bucket")), "feature", "left"))
    rep = rep.select(F.col("feature").alias("column"), "psi", "psi_null_q99", "p_perm",
                     "null_share_ref", "null_share_cur", "null_share_delta", "psi_excl_null",
                     "top_bucket", F.coalesce(F.col("degenerate"), F.lit("")).alias("note"))
    rep = R.bh_adjust(cut_lineage(rep), "p_perm", "p_perm_bh")
    return rep.withColumn("psi_over_null", F.col("psi") / F.col("psi_null_q99"))


def noise_floor(report: DataFrame, policy: DSPolicy = DSPolicy()) -> DataFrame:
    sig = F.col("p_perm_bh").isNotNull() & (F.col("p_perm_bh") < policy.alpha)
    mat = F.col("psi").isNotNull() & (F.col("psi") > policy.psi_threshold)
    return report.agg(F.percentile("psi_null_q99", 0.5).alias("median_null_q99"),
                      F.count(F.when(sig, F.lit(1))).alias("significant"),
                      F.count(F.when(mat, F.lit(1))).alias("material"),
                      F.count(F.when(sig & mat, F.lit(1))).alias("both"),
                      F.max("psi").alias("max_psi"))


# ------------------------------------------------------------- whole tables ---
def hashed_sample(frame: DataFrame, id_col: str, n_sub: int, seed: int = 0) -> DataFrame:
    """The ``n_sub`` rows with the smallest seeded hash of their id: a fixed-size
    sample independent of row order (top-k, bounded by ``n_sub``)."""
    return frame.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), F.col(id_col)).limit(n_sub)


#: Rows of one sorted piece of a projection.
RUN_ROWS = 4096


def directions(d: int, many: int, seed: int) -> np.ndarray:
    """``many`` random unit vectors of length ``d`` (one, and no choice, in one dimension)."""
    if d == 1:
        return np.ones((1, 1))
    v = np.random.default_rng([seed, d]).standard_normal((many, d))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _numbered(rows: DataFrame, order) -> DataFrame:
    """``rows`` with ``idx`` = 0, 1, ... in the given order (range partitions and an offset each)."""
    at = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    at = cut_lineage(at)
    part = F.shiftright("at", 33)
    sizes = at.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row per partition
    first = sizes.select("part", F.coalesce(before, F.lit(0)).alias("first"))
    return at.join(F.broadcast(first), part == F.col("part")).withColumn(
        "idx", F.col("first") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("at", "part", "first")


def _projected(rows: DataFrame, axes: np.ndarray, n: int, total: int, perms: int, seed: int) -> DataFrame:
    """``(k, v, early)`` per row and direction; ``early`` packs one bit per labelling: the
    given windows first, then ``perms`` keyed permutations of them."""
    keys = np.random.default_rng([seed, perms]).integers(0, 2**63, perms)

    def run(batches):
        for pdf in batches:
            z, idx = np.array(pdf["z"].tolist(), float).reshape(len(pdf), -1), pdf["idx"].to_numpy()
            marks = np.vstack([pdf["early"].to_numpy(bool)[None], *(position(idx, total, int(key))[None] < n for key in keys)])
            bits = [b.tobytes() for b in np.packbits(marks, axis=0).T]
            for k, axis in enumerate(axes):
                yield pd.DataFrame({"k": k, "v": z @ axis, "early": bits})

    return rows.select("idx", "early", "z").mapInPandas(run, "k int, v double, early binary")


_RUN = "k int, run long, rows int, first double, vs binary, bits binary, got array<long>"


def _runs(projected: DataFrame, many: int) -> DataFrame:
    """The projections in order, ``RUN_ROWS`` rows to a row; ``got``: early ones in each of ``many`` labellings."""
    def run(batches):
        number, k_now, held = TaskContext.get().partitionId() << 32, None, []

        def flush():
            v, bits = zip(*held)
            packed = b"".join(bits)
            got = _labels(packed, len(v), many).sum(0, dtype=np.int64)
            return pd.DataFrame([(k_now, number, len(v), v[0], np.array(v).tobytes(), packed, got)],
                                columns=["k", "run", "rows", "first", "vs", "bits", "got"])

        for pdf in batches:
            for k, v, e in zip(pdf["k"].tolist(), pdf["v"].tolist(), pdf["early"].tolist()):
                if held and (k != k_now or len(held) >= RUN_ROWS):
                    yield flush()
                    number, held = number + 1, []
                k_now = k
                held.append((v, e))
        if held:
            yield flush()

    return projected.repartitionByRange("k", "v").sortWithinPartitions("k", "v").mapInPandas(run, _RUN)


def _labels(bits: bytes, rows: int, many: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8).reshape(rows, -1), axis=1)[:, :many]


def energy_test(fw: DataFrame, columns, id_col: str, many: int = 16, perms: int = 199, seed: int = 0) -> DataFrame:
    """Energy two-sample test of early vs late on every complete row, standardised on
    the early window; permutation p ``(1 + #{E* >= E}) / (R + 1)``.

    Sliced: the energy distance is, up to a constant of the dimension, the mean over
    directions of the one-dimensional one, ``2nm/N`` times the integral of (F - G)**2,
    which sorted runs and counts before each run give without pairs. ``many`` random
    directions estimate that mean; in one dimension it is exact. A permutation
    relabels whole rows, the same way in every direction.
    """
    spark = fw.sparkSession
    cols = list(columns)
    both = fw.where(F.col("window").isin("early", "late"))
    for c in cols:
        both = both.where(F.col(c).isNotNull())
    early = F.col("window") == "early"
    stats = both.agg(F.count(F.when(early, 1)).alias("n"), F.count(F.when(~early, 1)).alias("m"),
                     *[f(F.when(early, F.col(c).cast("double"))).alias(f"{name}{i}") for i, c in enumerate(cols)
                       for name, f in (("mean", F.avg), ("sd", F.stddev_samp))]).first()
    n, m = stats["n"], stats["m"]
    if n < 50 or m < 50:
        return spark.createDataFrame([(None, None, n, m)], "statistic double, p_value double, n_ref long, n_cur long")
    scale = [s if s and math.isfinite(s) else 1.0 for s in (stats[f"sd{i}"] for i in range(len(cols)))]
    z = F.array(*[(F.col(c).cast("double") - F.lit(stats[f"mean{i}"])) / F.lit(scale[i]) for i, c in enumerate(cols)])
    rows = both.select(early.alias("early"), z.alias("z"), F.xxhash64(F.col(id_col), F.lit(seed)).alias("h"), F.col(id_col).alias("id"))
    axes = directions(len(cols), many, seed)
    runs = cut_lineage(_runs(_projected(_numbered(rows, ["h", "id"]), axes, n, n + m, perms, seed), perms + 1))

    counts = runs.select("k", "run", F.posexplode("got").alias("perm", "got"))
    upto = Window.partitionBy("k", "perm").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    before = (counts.select("k", "run", "perm", F.coalesce(F.sum("got").over(upto), F.lit(0)).alias("before"))
                    .groupBy("k", "run").agg(F.sort_array(F.collect_list(F.struct("perm", "before"))).alias("before")))
    along = Window.partitionBy("k").orderBy("run")
    places = runs.select("k", "run", F.lead("first").over(along).alias("after"), F.coalesce(
        F.sum("rows").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("rows_before"))
    factor = 2.0 * n * m / (n + m) * math.sqrt(math.pi) * math.exp(math.lgamma((len(cols) + 1) / 2) - math.lgamma(len(cols) / 2)) / len(axes)

    def partial(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(perms + 1)
        for vs, bits, r, start, upto_run, after in zip(pdf["vs"], pdf["bits"], pdf["rows"], pdf["rows_before"], pdf["before"], pdf["after"]):
            v = np.frombuffer(vs)
            gap = np.diff(np.append(v, v[-1] if after is None or np.isnan(after) else after))
            e = np.cumsum(_labels(bits, r, perms + 1), axis=0, dtype=np.int64) + np.asarray(upto_run, np.int64)
            place = np.arange(start + 1, start + r + 1)[:, None]
            total += gap @ (e / n - (place - e) / m) ** 2
        return pd.DataFrame({"perm": np.arange(perms + 1), "part": total})

    joined = (runs.join(before, ["k", "run"]).join(places, ["k", "run"])
                  .select("k", "run", "vs", "bits", "rows", "rows_before", F.col("before.before").alias("before"), "after"))
    # one run at a time: a batch of whole runs grows with the rows of its partition
    parts = joined.groupBy("k", "run").applyInPandas(partial, "perm int, part double")
    e = parts.groupBy("perm").agg((F.sum("part") * F.lit(factor)).alias("e"))
    obs = e.where("perm = 0").select(F.col("e").alias("statistic"), F.lit(1).alias("_one"))
    # the same labelling summed in another order must not count as smaller
    ge = F.count(F.when(F.col("e") >= F.col("statistic") * (1 - 1e-12), 1))
    j = e.where("perm > 0").withColumn("_one", F.lit(1)).join(obs, "_one").agg(F.first("statistic").alias("statistic"), ge.alias("ge"))
    return j.select("statistic", ((1 + F.col("ge")) / F.lit(perms + 1.0)).alias("p_value"),
                    F.lit(n).cast("long").alias("n_ref"), F.lit(m).cast("long").alias("n_cur"))


def _ecdf_stats(a: np.ndarray, b: np.ndarray, power: float = 2.0):
    """CvM- and AD-type statistics over the joint sample: at every joint point
    |F_a - F_b|^p (CvM) and the same over E(1-E) of the joint ECDF (AD)."""
    x = np.concatenate([a, b])
    order = np.argsort(x, kind="mergesort")
    xs = x[order]
    from_a = (order < len(a)).astype(float)
    fa = np.cumsum(from_a) / len(a)
    fb = np.cumsum(1 - from_a) / len(b)
    # evaluate at the last occurrence of each tied value
    last = np.r_[xs[1:] != xs[:-1], True]
    cnt = np.diff(np.r_[-1, np.nonzero(last)[0]])
    e = (np.nonzero(last)[0] + 1) / len(x)
    h = np.abs(fa[last] - fb[last]) ** power
    cvm = float((h * cnt).sum())
    ok = (e > 0) & (e < 1)
    ad = float((h[ok] * cnt[ok] / (e[ok] * (1 - e[ok]))).sum())
    return ad, cvm


#: Rows of a leaf of the tree that the permutations deal down (a heavier value is a leaf of its own).
LEAF_ROWS = 8192
#: Draws that a leaf handles at once.
DRAWS_AT_ONCE = 64


def value_counts_by_window(values: DataFrame, columns) -> DataFrame:
    """``(feature, vnum, a, b)``: early and late rows per distinct value, with cumulative sums."""
    v = (values.where(F.col("feature").isin(list(columns)) & F.col("vnum").isNotNull())
               .groupBy("feature", "vnum")
               .agg(F.sum(F.when(F.col("window") == "early", F.col("n")).otherwise(0)).alias("a"),
                    F.sum(F.when(F.col("window") == "late", F.col("n")).otherwise(0)).alias("b")))
    return cumulative(v, ["feature"], "vnum", ["a", "b"])


def _leaf_stats(pdf: pd.DataFrame, got: np.ndarray, before: np.ndarray, rng) -> tuple:
    """AD and CvM sums over one leaf's values: the observed windows, then every draw."""
    pdf = pdf.sort_values("vnum")
    c = (pdf["a"] + pdf["b"]).to_numpy(np.int64)
    n_a, n_b = int(pdf["a_total"].iloc[0]), int(pdf["b_total"].iloc[0])
    rows = int(pdf["a_below"].iloc[0] + pdf["b_below"].iloc[0]) + np.cumsum(c)
    e = rows / (n_a + n_b)
    weight = np.where((e > 0) & (e < 1), 1 / np.where((e > 0) & (e < 1), e * (1 - e), 1.0), 0.0)

    def stats(early):
        h = (early / n_a - (rows - early) / n_b) ** 2 * c
        return h @ weight, h.sum(axis=1)

    out = [stats((pdf["a_below"] + pdf["a"]).to_numpy(np.int64)[None, :])]
    starts = np.concatenate(([0], np.cumsum(c)[:-1]))
    for lo in range(0, len(got), DRAWS_AT_ONCE):
        k, b = got[lo:lo + DRAWS_AT_ONCE], before[lo:lo + DRAWS_AT_ONCE]
        if len(c) == 1:
            inside = k[:, None]
        else:
            inside = np.cumsum(np.add.reduceat(marked_places(int(c.sum()), k, rng), starts, axis=1, dtype=np.int64), axis=1)
        out.append(stats(b[:, None] + inside))
    return tuple(np.concatenate(x) for x in zip(*out))


def marginal_tests(values: DataFrame, columns, nboot: int = 500, seed: int = 0) -> DataFrame:
    """Two-sample AD and CvM statistics over every row, their permutation p-values
    ``(1 + #{null >= stat}) / (B + 1)`` and Cliff's delta, per column; BH over columns.

    A permutation re-deals the early rows over the pooled, ordered values: down the
    tree to leaves of about LEAF_ROWS rows, inside a leaf to its values. Null
    where a window has fewer than 50 values or there are fewer than 3 distinct ones.
    """
    c = cut_lineage(value_counts_by_window(values, columns))
    rows = F.col("a") + F.col("b")
    below = F.col("a_below") + F.col("b_below")
    c = c.withColumn("leaf", 2 * F.floor(below / LEAF_ROWS).cast("long") + F.when(rows > LEAF_ROWS, 1).otherwise(0))
    size = c.groupBy("feature").agg(F.first("a_total").alias("marked"), F.first("b_total").alias("others"), F.count(F.lit(1)).alias("distinct"))
    ok = size.where((F.col("marked") >= 50) & (F.col("others") >= 50) & (F.col("distinct") >= 3))
    dealt = deal(c.groupBy("feature", "leaf").agg(F.sum(rows).alias("rows")), ok, nboot, seed)

    def run(vals: pd.DataFrame, leaf: pd.DataFrame) -> pd.DataFrame:
        if leaf.empty or vals.empty:
            return pd.DataFrame(columns=["feature", "draw", "ad", "cvm"])
        name, at = leaf["feature"].iloc[0], int(leaf["leaf"].iloc[0])
        ad, cvm = _leaf_stats(vals, np.asarray(leaf["got"].iloc[0], np.int64), np.asarray(leaf["before"].iloc[0], np.int64),
                              seeded(seed, name, -1 % 2**32, at))
        return pd.DataFrame({"feature": name, "draw": np.arange(len(ad)), "ad": ad, "cvm": cvm})

    vals = c.select(F.col("feature").alias("of"), F.col("leaf").alias("at"), "vnum", "a", "b", "a_below", "b_below", "a_total", "b_total")
    parts = vals.groupBy("of", "at").cogroup(dealt.groupBy("feature", "leaf")).applyInPandas(
        run, "feature string, draw int, ad double, cvm double")
    sums = cut_lineage(parts.groupBy("feature", "draw").agg(F.sum("ad").alias("ad"), F.sum("cvm").alias("cvm")))
    obs = sums.where("draw = 0").select("feature", F.col("ad").alias("ad_stat"), F.col("cvm").alias("cvm_stat"))
    # the same split summed in another order must not count as smaller
    p = [((1 + F.count(F.when(F.col(k) >= F.col(f"{k}_stat") * (1 - 1e-12), 1))) / F.lit(nboot + 1.0)).alias(f"{k}_p") for k in ("ad", "cvm")]
    tests = sums.where("draw > 0").join(obs, "feature").groupBy("feature", "ad_stat", "cvm_stat").agg(*p)
    delta = R.cliffs_delta(values.where(F.col("feature").isin(list(columns)))).select("feature", "cliffs_delta")
    out = (size.select("feature", F.col("marked").alias("n_ref"), F.col("others").alias("n_cur"))
               .join(tests, "feature", "left").join(delta, "feature", "left")
               .select(F.col("feature").alias("column"), "n_ref", "n_cur", "ad_stat", "ad_p", "cvm_stat", "cvm_p",
                       F.when(F.col("ad_stat").isNotNull(), F.col("cliffs_delta")).alias("cliffs_delta")))
    out = R.bh_adjust(cut_lineage(out), "ad_p", "ad_p_bh")
    return R.bh_adjust(out, "cvm_p", "cvm_p_bh")


def ecdf_stats_all(values: DataFrame, columns) -> DataFrame:
    """The AD- and CvM-type statistics over every row of both windows, from
    VALUES: per distinct value the early and late counts, their exact
    cumulative sums (bucketed plan), then |F_early - F_late|^2 weighted by the
    value's count (CvM) and also divided by E(1 - E) of the pooled ECDF (AD)."""
    c = value_counts_by_window(values, columns)
    fa = (F.col("a_below") + F.col("a")) / F.col("a_total")
    fb = (F.col("b_below") + F.col("b")) / F.col("b_total")
    e = (F.col("a_below") + F.col("a") + F.col("b_below") + F.col("b")) / (F.col("a_total") + F.col("b_total"))
    h = (fa - fb) * (fa - fb) * (F.col("a") + F.col("b"))
    return c.groupBy("feature").agg(
        F.sum(h).alias("cvm_stat_all"),
        F.sum(F.when((e > 0) & (e < 1), h / (e * (1 - e))).otherwise(0.0)).alias("ad_stat_all"))
