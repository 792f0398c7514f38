"""Missingness: families of columns that go missing together, Little's MCAR
test, and whether absence predicts the label.

Little's test needs, per missingness pattern, the row count and the sums and
cross-products of the observed values. Those are one ``groupBy(pattern)``
over all rows (no subsample); the EM estimate of the mean and covariance and
the statistic then run on that pattern table -- at most ``2^k`` rows for k
columns -- in one task per family.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pyspark.sql.types import BooleanType, NumericType

from ..functions.dist import chi2_sf
from ..session import cut_lineage
from . import rank as R


def null_counts(values: DataFrame, features, window: str = "early") -> DataFrame:
    isnull = F.col("vnum").isNull() & F.col("vtxt").isNull()
    return (values.where((F.col("window") == window) & F.col("feature").isin(list(features)))
                  .groupBy("feature")
                  .agg(F.sum(F.when(isnull, F.col("n")).otherwise(0)).alias("null_count"),
                       F.sum("n").alias("rows")))


def families(values: DataFrame, features, min_size: int = 2) -> DataFrame:
    """(null_count, size, feature, position) for every family of >= ``min_size``
    columns sharing an exact, non-zero null count (largest family first)."""
    spark = values.sparkSession
    order = spark.createDataFrame([(f, i) for i, f in enumerate(features)], "feature string, position int")
    nc = null_counts(values, features).where(F.col("null_count") > 0).join(order, "feature")
    w = Window.partitionBy("null_count")
    return (nc.withColumn("size", F.count(F.lit(1)).over(w)).where(F.col("size") >= min_size)
              .select(F.col("null_count").cast("long").alias("null_count"), F.col("size").cast("long").alias("size"),
                      "feature", "position", "rows"))


def reference_columns(values: DataFrame, numeric, max_null: float = 0.001, min_distinct: int = 5,
                      limit: int = 6) -> DataFrame:
    """First ``limit`` numeric columns (in declared order) with null share <=
    ``max_null`` and more than ``min_distinct`` distinct values, early window."""
    spark = values.sparkSession
    order = spark.createDataFrame([(f, i) for i, f in enumerate(numeric)], "feature string, position int")
    e = values.where((F.col("window") == "early") & F.col("feature").isin(list(numeric)))
    st = e.groupBy("feature").agg(
        (F.sum(F.when(F.col("vnum").isNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("null_share"))
    dc = e.where(F.col("vnum").isNotNull()).select("feature", "vnum").distinct() \
          .groupBy("feature").agg(F.count(F.lit(1)).alias("distinct"))
    c = order.join(st, "feature").join(dc, "feature") \
             .where((F.col("null_share") <= max_null) & (F.col("distinct") > min_distinct))
    w = Window.orderBy("position")
    return c.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= limit).select("feature", "position")


def pattern_stats(frame: DataFrame, columns) -> DataFrame:
    """Per missingness pattern of ``columns``: rows, sums and cross-products of
    the observed values (null where unobserved)."""
    cols = list(columns)
    pat = F.concat(*[F.when(F.col(c).isNull(), F.lit("0")).otherwise(F.lit("1")) for c in cols])
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.sum(F.col(c).cast("double")).alias(f"s_{i}") for i, c in enumerate(cols)]
    for i, a in enumerate(cols):
        for j in range(i, len(cols)):
            aggs.append(F.sum(F.col(a).cast("double") * F.col(cols[j]).cast("double")).alias(f"x_{i}_{j}"))
    return frame.groupBy(pat.alias("pattern")).agg(*aggs)


def little_mcar(pdf: pd.DataFrame, k: int, max_iter: int = 500, tol: float = 1e-8):
    """EM on pattern sufficient statistics, then Little's d^2, df, p."""
    pats = []
    for _, r in pdf.iterrows():
        obs = np.array([ch == "1" for ch in r["pattern"]])
        n = float(r["n"])
        s = np.array([r[f"s_{i}"] if obs[i] else 0.0 for i in range(k)], dtype=float)
        xx = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                if obs[i] and obs[j]:
                    xx[i, j] = xx[j, i] = r[f"x_{i}_{j}"]
        pats.append((obs, n, s, xx))
    N = sum(p[1] for p in pats)
    # start: available-case means and variances
    mu = np.zeros(k)
    var = np.ones(k)
    for i in range(k):
        ni = sum(p[1] for p in pats if p[0][i])
        if ni > 0:
            mu[i] = sum(p[2][i] for p in pats if p[0][i]) / ni
            var[i] = max(sum(p[3][i, i] for p in pats if p[0][i]) / ni - mu[i] ** 2, 1e-12)
    sig = np.diag(var)
    for _ in range(max_iter):
        t1 = np.zeros(k)
        t2 = np.zeros((k, k))
        for obs, n, s, xx in pats:
            o, m = np.where(obs)[0], np.where(~obs)[0]
            if len(m) == 0:
                t1 += s
                t2 += xx
                continue
            if len(o) == 0:
                t1 += n * mu
                t2 += n * (sig + np.outer(mu, mu))
                continue
            soo = sig[np.ix_(o, o)]
            b = sig[np.ix_(m, o)] @ np.linalg.inv(soo)
            a = mu[m] - b @ mu[o]
            so = s[o]
            xoo = xx[np.ix_(o, o)]
            bs = b @ so
            t1[o] += so
            t1[m] += n * a + bs
            t2[np.ix_(o, o)] += xoo
            mo = np.outer(a, so) + b @ xoo
            t2[np.ix_(m, o)] += mo
            t2[np.ix_(o, m)] += mo.T
            cmm = sig[np.ix_(m, m)] - b @ sig[np.ix_(o, m)]
            t2[np.ix_(m, m)] += n * np.outer(a, a) + np.outer(a, bs) + np.outer(bs, a) + b @ xoo @ b.T + n * cmm
        mu_new = t1 / N
        sig_new = t2 / N - np.outer(mu_new, mu_new)
        done = np.max(np.abs(mu_new - mu)) < tol and np.max(np.abs(sig_new - sig)) < tol
        mu, sig = mu_new, sig_new
        if done:
            break
    d2, dfo = 0.0, 0
    for obs, n, s, xx in pats:
        o = np.where(obs)[0]
        if len(o) == 0:
            continue
        diff = s[o] / n - mu[o]
        d2 += n * float(diff @ np.linalg.solve(sig[np.ix_(o, o)], diff))
        dfo += len(o)
    df = dfo - k
    return d2, df, len(pats)


def drop_constant(pdf: pd.DataFrame, k: int):
    """Drop columns with no variance among their observed values (from the
    pattern sums), re-indexing the pattern bits, sums and cross-products."""
    keep = []
    for i in range(k):
        obs = pdf["pattern"].str[i] == "1"
        n = pdf.loc[obs, "n"].sum()
        if n < 2:
            continue
        s1 = pdf.loc[obs, f"s_{i}"].sum()
        s2 = pdf.loc[obs, f"x_{i}_{i}"].sum()
        if s2 / n - (s1 / n) ** 2 > 1e-12 * max(1.0, s2 / n):
            keep.append(i)
    if len(keep) == k:
        return pdf, k
    out = pd.DataFrame({"pattern": pdf["pattern"].map(lambda p: "".join(p[i] for i in keep)), "n": pdf["n"]})
    for a, i in enumerate(keep):
        out[f"s_{a}"] = pdf[f"s_{i}"]
        for b in range(a, len(keep)):
            j = keep[b]
            out[f"x_{a}_{b}"] = pdf[f"x_{min(i, j)}_{max(i, j)}"]
    # patterns that now coincide are pooled
    agg = out.groupby("pattern", as_index=False).sum(numeric_only=True)
    return agg, len(keep)


def mcar_test(frame: DataFrame, fams: DataFrame, refs: list, probe: int = 3) -> DataFrame:
    """Little's test per family: the first ``probe`` members plus the reference
    columns (minus members).

    One pass over the rows serves every family: each task adds up, per family
    and missingness pattern, the row count, sums and cross-products of the
    observed values; a group-by sums the task partials; one family's pattern
    table (at most 2^k rows) is solved per task.
    """
    spark = frame.sparkSession
    schema = "null_count long, mcar_statistic double, mcar_df long, patterns long, mcar_p double, note string"
    members = (fams.groupBy("null_count")
                   .agg(F.sort_array(F.collect_list(F.struct("position", "feature"))).alias("m"))
                   .collect())  # one row per family: bounded by the number of columns
    if not refs:
        return spark.createDataFrame([(int(r["null_count"]), None, None, None, None,
                                       "no always-observed reference columns") for r in members], schema)
    plan = {}
    numeric = {f.name for f in frame.schema.fields if isinstance(f.dataType, (NumericType, BooleanType))}
    no_number = []
    for r in members:
        every = [x["feature"] for x in r["m"]]
        mem = [c for c in every if c in numeric]
        if mem:
            plan[int(r["null_count"])] = mem[:probe] + [c for c in refs if c not in every]
        else:
            no_number.append((int(r["null_count"]), None, None, None, None, "no numeric columns in the family"))
    without = spark.createDataFrame(no_number, schema)
    if not plan:
        return without
    cols = sorted({c for cs in plan.values() for c in cs})
    rows = frame.select(*[F.col(c).cast("double").alias(c) for c in cols])
    bplan = spark.sparkContext.broadcast(plan)  # schema-sized

    def partial(it):
        fam_cols = bplan.value
        for pdf in it:
            recs = []
            for fam, cs in fam_cols.items():
                x = pdf[cs].to_numpy(dtype=float)
                obs = ~np.isnan(x)
                xz = np.where(obs, x, 0.0)
                kinds, which = np.unique(obs, axis=0, return_inverse=True)
                for p, kind in enumerate(kinds):
                    pat = "".join("1" if o else "0" for o in kind)
                    idx = np.flatnonzero(which.ravel() == p)
                    sub = xz[idx]
                    recs.append((fam, pat, "n", -1, -1, float(len(idx))))
                    sums = sub.sum(axis=0)
                    cross = sub.T @ sub
                    for i in range(len(cs)):
                        if pat[i] == "1":
                            recs.append((fam, pat, "s", i, -1, float(sums[i])))
                            for j in range(i, len(cs)):
                                if pat[j] == "1":
                                    recs.append((fam, pat, "x", i, j, float(cross[i, j])))
            yield pd.DataFrame(recs, columns=["null_count", "pattern", "stat", "i", "j", "v"])

    stats = (rows.mapInPandas(partial, "null_count long, pattern string, stat string, i int, j int, v double")
                 .groupBy("null_count", "pattern", "stat", "i", "j").agg(F.sum("v").alias("v")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fam = int(pdf["null_count"].iloc[0])
        k = len(bplan.value[fam])
        wide = {}
        for pat, st, i, j, v in zip(pdf["pattern"], pdf["stat"], pdf["i"], pdf["j"], pdf["v"]):
            row = wide.setdefault(pat, {"pattern": pat})
            if st == "n":
                row["n"] = v
            elif st == "s":
                row[f"s_{i}"] = v
            else:
                row[f"x_{i}_{j}"] = v
        table = pd.DataFrame(list(wide.values()))
        for i in range(k):
            for c in [f"s_{i}"] + [f"x_{i}_{j}" for j in range(i, k)]:
                if c not in table:
                    table[c] = np.nan
        table, k2 = drop_constant(table, k)
        if k2 < 2:
            return pd.DataFrame({"null_count": [fam], "mcar_statistic": [None], "mcar_df": [None],
                                 "patterns": [None], "mcar_p": [None], "note": ["not enough varying columns"]})
        try:
            d2, df, npat = little_mcar(table, k2)
            return pd.DataFrame({"null_count": [fam], "mcar_statistic": [d2], "mcar_df": [df],
                                 "patterns": [npat], "mcar_p": [chi2_sf(d2, df) if df > 0 else None],
                                 "note": [""]})
        except np.linalg.LinAlgError:
            return pd.DataFrame({"null_count": [fam], "mcar_statistic": [None], "mcar_df": [None],
                                 "patterns": [None], "mcar_p": [None], "note": ["test not estimable"]})

    return stats.groupBy("null_count").applyInPandas(run, schema).unionByName(without)


def indicator_auc(values: DataFrame, fams: DataFrame) -> DataFrame:
    """AUC (DeLong CI) of the first member's missing flag against the label."""
    first = (fams.withColumn("_first", F.min("position").over(Window.partitionBy("null_count")))
                 .where(F.col("position") == F.col("_first")).select("null_count", "feature"))
    v = values.where(F.col("window") == "early").join(first, "feature")
    g = v.groupBy("null_count", (F.col("vnum").isNull() & F.col("vtxt").isNull()).cast("double").alias("score")) \
         .agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("pos"),
              F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("neg"))
    a = R.auc_delong(g, ["null_count"], bounded=True)
    return a.select("null_count", F.col("auc").alias("indicator_auc"), F.col("lower").alias("indicator_auc_lo"),
                    F.col("upper").alias("indicator_auc_hi"))


def scan(audit) -> DataFrame:
    spec = audit.spec
    fams = cut_lineage(families(audit.values, spec.features))
    refs = [r["feature"] for r in reference_columns(audit.values, spec.measured).orderBy("position").collect()]
    early = audit.fw.where(F.col("window") == "early")
    test = mcar_test(early, fams, refs)
    auc = indicator_auc(audit.values, fams)
    info = fams.groupBy("null_count").agg(
        F.first("size").alias("size"), F.first("rows").alias("rows"),
        F.sort_array(F.collect_list(F.struct("position", "feature")))[0]["feature"].alias("example"))
    r = cut_lineage(info.join(test, "null_count", "left").join(auc, "null_count", "left"))
    r = r.select(F.col("null_count").cast("string").alias("family"), "size", "null_count",
                 (F.col("null_count") / F.col("rows")).alias("null_share"), "mcar_statistic", "mcar_p",
                 "mcar_df", "patterns", "indicator_auc", "indicator_auc_lo", "indicator_auc_hi", "example",
                 F.coalesce(F.col("note"), F.lit("no always-observed reference columns")).alias("note"))
    r = R.bh_adjust(r, "mcar_p", "mcar_p_bh")
    sig = (F.col("mcar_p_bh").isNotNull() & (F.col("mcar_p_bh") < 0.05) & F.col("indicator_auc_lo").isNotNull()
           & ((F.col("indicator_auc_lo") > 0.5) | (F.col("indicator_auc_hi") < 0.5)))
    return r.withColumn("absence_is_signal", sig)
