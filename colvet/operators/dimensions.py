"""Dimensionality of column blocks: parallel analysis, first-component share,
tetrachoric correlation of binary columns.

The data pass is one aggregation per block (median for imputation, then sums
of products for the correlation matrix). Eigenvalues and the tetrachoric solve
work on those p x p summaries only. The noise reference resamples every column
on its own: rows are dealt by a hash of their id into batches, and inside a batch
each column is drawn with replacement, independently of the others; a batch
gives the products of all its resampled tables, so values meet without a shuffle
per draw. Columns are centred inside the batch first, so that what batches
differ by does not correlate.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dist import norm_cdf, norm_ppf
from ..session import cut_lineage
from ..plans.dealing import seeded
from .binning import type7_quantiles


def block_medians(rows: DataFrame, columns) -> DataFrame:
    counts = rows.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("vnum"))
                                            for c in columns])))
    counts = counts.where(F.col("vnum").isNotNull()).groupBy("feature", "vnum").agg(F.count(F.lit(1)).alias("c"))
    nn = counts.groupBy("feature").agg(F.sum("c").alias("nonnull"))
    return type7_quantiles(counts.join(nn, "feature"), ["feature"], [0.5]).select("feature", F.col("q").alias("median"))




def _matrix(pdf: pd.DataFrame):
    names = sorted(set(pdf["a"]))
    ix = {c: i for i, c in enumerate(names)}
    m = np.eye(len(names))
    for a, b, r in zip(pdf["a"], pdf["b"], pdf["r"]):
        m[ix[a], ix[b]] = r
    return names, m


#: Rows of a batch, about, in which columns are resampled together.
BATCH_ROWS = 20_000


def _block_plan(rows: DataFrame, blocks: DataFrame) -> tuple:
    """Columns of each block that ``rows`` has, and every column's median (one number per column)."""
    bl = {r["block"]: sorted(set(r["cols"]) & set(rows.columns)) for r in
          blocks.groupBy("block").agg(F.collect_list("column").alias("cols")).collect()}  # block definitions
    bl = {b: c for b, c in bl.items() if c}
    cols = sorted({c for cs in bl.values() for c in cs})
    med = {r["feature"]: r["median"] for r in block_medians(rows, cols).collect()}
    return bl, {c: (med.get(c) if med.get(c) is not None else 0.0) for c in cols}


def resampled_products(rows: DataFrame, plan: tuple, id_col: str, n_iter: int, seed: int = 0) -> DataFrame:
    """``(block, it, i, j, v)``: sums (j = -1), products and the row count (i = j = -1) of the rows
    with every column resampled on its own, ``n_iter`` times. Depends on ids and seed alone."""
    bl, med = plan
    cols = sorted(med)
    batches = max(1, -(-rows.count() // BATCH_ROWS))
    batch = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(batches)).alias("batch")
    data = rows.select(batch, F.col(id_col).alias("_id"), *[F.col(c).cast("double").alias(c) for c in cols])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_id", *cols])
        x = {c: np.where(pdf[c].isna(), med[c], pdf[c]) for c in cols}
        x = {c: v - v.mean() for c, v in x.items()}
        m, out = len(pdf), []
        for it in range(n_iter):
            drawn = {c: v[seeded(seed, c, it, int(pdf["batch"].iloc[0])).integers(0, m, m)] for c, v in x.items()}
            for b, cs in bl.items():
                z = np.column_stack([drawn[c] for c in cs])
                g, s = z.T @ z, z.sum(axis=0)
                i, j = np.triu_indices(len(cs))
                out.append(pd.DataFrame({"block": b, "it": it, "i": np.r_[-1, np.arange(len(cs)), i],
                                         "j": np.r_[-1, np.full(len(cs), -1), j], "v": np.r_[float(m), s, g[i, j]]}))
        return pd.concat(out)

    return (data.groupBy("batch").applyInPandas(run, "block string, it int, i int, j int, v double")
                .groupBy("block", "it", "i", "j").agg(F.sum("v").alias("v")))


def noise_eigenvalues(products: DataFrame, plan: tuple) -> DataFrame:
    """``(block, it, ev array<double>)``: descending eigenvalues of each resampled table's
    correlations over its varying columns."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        block, it = pdf["block"].iloc[0], int(pdf["it"].iloc[0])
        p = len(plan[0][block])
        n, s, g = 0.0, np.zeros(p), np.zeros((p, p))
        for i, j, v in zip(pdf["i"], pdf["j"], pdf["v"]):
            if i < 0:
                n = v
            elif j < 0:
                s[i] = v
            else:
                g[i, j] = g[j, i] = v
        cov = g - np.outer(s, s) / max(n, 1.0)
        var = np.diag(cov)
        keep = var > 1e-12 * np.maximum(1.0, np.diag(g))
        d = 1 / np.sqrt(var[keep])
        ev = np.sort(np.linalg.eigvalsh(cov[np.ix_(keep, keep)] * np.outer(d, d)))[::-1] if keep.any() else np.zeros(0)
        return pd.DataFrame({"of": [block], "it": [it], "ev": [ev.tolist()]})

    return products.groupBy("block", "it").applyInPandas(run, "of string, it int, ev array<double>")


def parallel_analysis(corr: DataFrame, noise: DataFrame, quant: float = 0.95) -> DataFrame:
    """Per block: components whose eigenvalue beats the noise quantile (stop at
    the first that does not), the compression it implies and the first
    component's share of variance."""

    def run(pdf: pd.DataFrame, drawn: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:
            return pd.DataFrame(columns=["block", "columns", "components", "compression", "variance_first_component", "note"])
        block = pdf["block"].iloc[0]
        names, m = _matrix(pdf)
        p = len(names)
        if p < 3:
            return pd.DataFrame({"block": [block], "columns": [p], "components": [None],
                                 "compression": [None], "variance_first_component": [None],
                                 "note": ["fewer than three varying columns"]})
        ev = np.sort(np.linalg.eigvalsh(m))[::-1]
        # a resample may leave a nearly constant column constant: such draws end earlier
        table = np.zeros((len(drawn), p))
        for row, x in zip(table, drawn["ev"]):
            row[:min(p, len(x))] = x[:p]
        bar = np.quantile(table, quant, axis=0)
        k = 0
        while k < p and ev[k] > bar[k]:
            k += 1
        return pd.DataFrame({"block": [block], "columns": [p], "components": [k],
                             "compression": [p / max(k, 1)], "variance_first_component": [float(ev[0] / ev.sum())],
                             "note": [""]})

    schema = ("block string, columns long, components long, compression double, "
              "variance_first_component double, note string")
    return corr.groupBy("block").cogroup(noise.groupBy("of")).applyInPandas(run, schema)


# ---------------------------------------------------------------- tetrachoric
_GL_X, _GL_W = np.polynomial.legendre.leggauss(40)


def bvn_upper(h: float, k: float, rho: float) -> float:
    """P(X > h, Y > k) for a standard bivariate normal with correlation rho
    (Plackett's integral over the correlation, Gauss-Legendre)."""
    base = (1 - norm_cdf(h)) * (1 - norm_cdf(k))
    if rho == 0:
        return base
    r = 0.5 * rho * (_GL_X + 1)
    dens = np.exp(-(h * h - 2 * r * h * k + k * k) / (2 * (1 - r * r))) / (2 * math.pi * np.sqrt(1 - r * r))
    return base + 0.5 * rho * float((_GL_W * dens).sum())


def tetrachoric(n11: float, n10: float, n01: float, n00: float, correct: float = 0.5) -> float:
    cells = [n11, n10, n01, n00]
    if any(c == 0 for c in cells):
        cells = [c if c > 0 else correct for c in cells]
    n11, n10, n01, n00 = cells
    n = n11 + n10 + n01 + n00
    pa, pb = (n11 + n10) / n, (n11 + n01) / n
    h, k = norm_ppf(1 - pa), norm_ppf(1 - pb)
    target = n11 / n
    lo, hi = -0.9999, 0.9999
    for _ in range(80):
        mid = 0.5 * (lo + hi)
        if bvn_upper(h, k, mid) < target:
            lo = mid
        else:
            hi = mid
    return 0.5 * (lo + hi)


def binary_columns(rows: DataFrame, columns) -> DataFrame:
    """``rows`` cut to those of ``columns`` that take exactly two values (numbers, texts or
    logicals), as 0 and 1 in the order of the values; null stays null."""
    cols = [c for c in columns if c in rows.columns]
    ends = rows.agg(*[f(c).alias(f"{name}{i}") for i, c in enumerate(cols) for name, f in (("lo", F.min), ("hi", F.max))]).first()
    between = rows.agg(*[F.count(F.when((F.col(c) != F.lit(ends[f"lo{i}"])) & (F.col(c) != F.lit(ends[f"hi{i}"])), 1)).alias(f"m{i}")
                         for i, c in enumerate(cols) if ends[f"lo{i}"] != ends[f"hi{i}"]] or [F.lit(0)]).first().asDict()
    kept = [(i, c) for i, c in enumerate(cols) if between.get(f"m{i}") == 0]
    return rows.select(*[(F.col(c) == F.lit(ends[f"hi{i}"])).cast("int").alias(c) for i, c in kept])


def tetrachoric_summary(rows: DataFrame, columns) -> DataFrame:
    """``(columns, mean_off_diagonal, mean_pearson, note)``: the mean absolute latent correlation among the
    binary ones of ``columns``, over all rows, beside the mean absolute Pearson correlation."""
    two = binary_columns(rows, columns)
    k = len(two.columns)
    if k < 2:
        return rows.sparkSession.createDataFrame([(k, None, None, "fewer than two binary columns")],
                                                 "columns long, mean_off_diagonal double, mean_pearson double, note string")
    return tetrachoric_pairs(two, two.columns).agg(
        F.lit(k).cast("long").alias("columns"), F.avg(F.abs("tetrachoric")).alias("mean_off_diagonal"),
        F.avg(F.abs(F.nanvl("pearson", F.lit(None).cast("double")))).alias("mean_pearson"), F.lit("").alias("note"))


def tetrachoric_pairs(rows: DataFrame, binaries) -> DataFrame:
    """2x2 counts for every pair of binary columns in one aggregation, then the
    latent correlation per pair; with the Pearson (phi) for comparison."""
    cols = list(binaries)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    aggs = []
    for a, b in pairs:
        ok = F.col(a).isNotNull() & F.col(b).isNotNull()
        for va, vb in ((1, 1), (1, 0), (0, 1), (0, 0)):
            aggs.append(F.sum(F.when(ok & (F.col(a) == va) & (F.col(b) == vb), 1).otherwise(0)).alias(f"{a}\u0001{b}\u0001{va}{vb}"))
    row = rows.agg(*aggs)
    t = row.select(F.inline(F.array(*[F.struct(
        F.lit(a).alias("a"), F.lit(b).alias("b"),
        *[F.col(f"`{a}\u0001{b}\u0001{c}`").cast("double").alias(f"n{c}") for c in ("11", "10", "01", "00")])
        for a, b in pairs])))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rho = [tetrachoric(*r) for r in zip(pdf["n11"], pdf["n10"], pdf["n01"], pdf["n00"])]
        n = pdf["n11"] + pdf["n10"] + pdf["n01"] + pdf["n00"]
        pa = (pdf["n11"] + pdf["n10"]) / n
        pb = (pdf["n11"] + pdf["n01"]) / n
        phi = (pdf["n11"] / n - pa * pb) / np.sqrt(pa * (1 - pa) * pb * (1 - pb))
        return pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "tetrachoric": rho, "pearson": phi})

    return t.mapInPandas(lambda it: (run(p) for p in it),
                         "a string, b string, tetrachoric double, pearson double")


def all_block_corr(rows: DataFrame, blocks: DataFrame, plan: tuple | None = None) -> DataFrame:
    """(block, a, b, r, n) for every block in a fixed number of passes: medians
    of all block columns in one exact quantile job, then one pass over the rows
    in which each task adds up, per block, the median-imputed sums and
    cross-products; correlations (constant columns dropped) come from the sums."""
    spark = rows.sparkSession
    plan = plan or _block_plan(rows, blocks)
    cols = sorted(plan[1])
    plan = spark.sparkContext.broadcast(plan)
    data = rows.select(*[F.col(c).cast("double").alias(c) for c in cols])

    def partial(it):
        blk, md = plan.value
        for pdf in it:
            recs = []
            for b, cs in blk.items():
                x = pdf[cs].to_numpy(dtype=float)
                m = np.array([md[c] for c in cs])[None, :]
                # imputed at the median, then centred on it: the sums stay small
                # relative to the spread, so the covariance loses no precision
                x = np.where(np.isnan(x), m, x) - m
                recs.append((b, -1, -1, float(len(x))))
                s1 = x.sum(axis=0)
                g = x.T @ x
                for i in range(len(cs)):
                    recs.append((b, i, -1, float(s1[i])))
                    for j in range(i, len(cs)):
                        recs.append((b, i, j, float(g[i, j])))
            yield pd.DataFrame(recs, columns=["block", "i", "j", "v"])

    sums = (data.mapInPandas(partial, "block string, i int, j int, v double")
                .groupBy("block", "i", "j").agg(F.sum("v").alias("v")))

    def corr(pdf: pd.DataFrame) -> pd.DataFrame:
        blk, _ = plan.value
        b = pdf["block"].iloc[0]
        cs = blk[b]
        k = len(cs)
        n = s1 = None
        s1 = np.zeros(k)
        g = np.zeros((k, k))
        for i, j, v in zip(pdf["i"], pdf["j"], pdf["v"]):
            if i < 0:
                n = v
            elif j < 0:
                s1[i] = v
            else:
                g[i, j] = g[j, i] = v
        if not n or n < 2:
            return pd.DataFrame(columns=["block", "a", "b", "r", "n"])
        cov = (g - np.outer(s1, s1) / n) / (n - 1)
        var = np.diag(cov)
        keep = [i for i in range(k) if var[i] > 1e-12 * max(1.0, abs(g[i, i]) / n)]
        recs = []
        for i in keep:
            for j in keep:
                r = 1.0 if i == j else float(cov[i, j] / np.sqrt(var[i] * var[j]))
                recs.append((b, cs[i], cs[j], r, int(n)))
        return pd.DataFrame(recs, columns=["block", "a", "b", "r", "n"])

    return sums.groupBy("block").applyInPandas(corr, "block string, a string, b string, r double, n long")


def scan(rows: DataFrame, blocks: DataFrame, id_col: str = "row_id", n_iter: int = 30, seed: int = 0) -> DataFrame:
    """Parallel analysis for every block (numeric members)."""
    plan = _block_plan(rows, blocks)
    noise = noise_eigenvalues(resampled_products(rows, plan, id_col, n_iter, seed), plan)
    return parallel_analysis(cut_lineage(all_block_corr(rows, blocks, plan)), noise)
