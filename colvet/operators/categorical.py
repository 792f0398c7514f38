"""Categorical association: Cramer's V against the label and against the window.

Levels are lumped to the ``max_levels`` most frequent early-window levels
(``__other__`` for the rest, ``__null__`` for missing). The contingency tables
are grouped counts; V needs no grid of empty cells because
``sum over all cells (o - e)^2 / e = sum over non-empty cells o^2 / e - n``.
The bootstrap interval resamples the cells (a multinomial draw of n on the
observed cell shares), one task per (column, target) -- each table is at most
``(max_levels + 2) x 2`` cells.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dist import chi2_sf
from ..policy import NULL_BUCKET, OTHER_BUCKET, CatPolicy
from ..session import cut_lineage
from . import rank as R
from .shift import seed_of


def _levels(values: DataFrame, features) -> DataFrame:
    """VALUES of ``features`` with the level in ``vtxt``: a true / false column travels as 1 / 0."""
    told = F.when(F.col("vnum") == 1, F.lit("TRUE")).when(F.col("vnum") == 0, F.lit("FALSE"))
    return values.where(F.col("feature").isin(list(features))).withColumn("vtxt", F.coalesce("vtxt", told))


def kept_levels(values: DataFrame, features, max_levels: int) -> DataFrame:
    early = (_levels(values, features).where((F.col("window") == "early") & F.col("vtxt").isNotNull())
                   .groupBy("feature", "vtxt").agg(F.sum("n").alias("c")))
    w = Window.partitionBy("feature").orderBy(F.col("c").desc(), F.col("vtxt").asc())
    return early.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= max_levels) \
                .select("feature", F.col("vtxt").alias("kept"))


def contingency(values: DataFrame, features, max_levels: int = 50) -> DataFrame:
    """(feature, target, a, b, n): lumped level x label (early window) and
    lumped level x window (both windows)."""
    # renamed before the join: both sides come from VALUES, so positional
    # references would be ambiguous
    kept = kept_levels(values, features, max_levels).select(F.col("feature").alias("k_feature"), "kept")
    v = _levels(values, features)
    j = v.join(F.broadcast(kept), (F.col("feature") == F.col("k_feature")) & (F.col("vtxt") == F.col("kept")),
               "left").drop("k_feature")
    lump = (F.when(F.col("vtxt").isNull(), F.lit(NULL_BUCKET))
             .when(F.col("kept").isNotNull(), F.col("vtxt"))
             .otherwise(F.lit(OTHER_BUCKET)))
    lv = j.select("feature", "window", "y", lump.alias("a"), "n")
    lab = (lv.where(F.col("window") == "early")
             .groupBy("feature", F.lit("label").alias("target"), "a", F.col("y").cast("string").alias("b"))
             .agg(F.sum("n").alias("n")))
    win = (lv.groupBy("feature", F.lit("window").alias("target"), "a", F.col("window").alias("b"))
             .agg(F.sum("n").alias("n")))
    return lab.unionByName(win)


def cramers_v(cont: DataFrame, min_rows: int = 50) -> DataFrame:
    """V with and without Bergsma's correction, chi-squared and its df."""
    k = ["feature", "target"]
    ra = cont.groupBy(*k, "a").agg(F.sum("n").alias("ra"))
    cb = cont.groupBy(*k, "b").agg(F.sum("n").alias("cb"))
    m = cont.groupBy(*k).agg(F.sum("n").alias("nn"), F.countDistinct("a").alias("r"),
                             F.countDistinct("b").alias("c"))
    j = cont.join(ra, [*k, "a"]).join(cb, [*k, "b"]).join(m, k)
    chi = j.groupBy(*k).agg(
        (F.sum(F.col("n").cast("double") * F.col("n") / (F.col("ra").cast("double") * F.col("cb") / F.col("nn")))
         - F.max("nn")).alias("chi2"))
    t = m.join(chi, k)
    n, r, c = F.col("nn").cast("double"), F.col("r"), F.col("c")
    ok = (F.col("nn") >= min_rows) & (r >= 2) & (c >= 2)
    raw = F.sqrt(F.try_divide(F.col("chi2") / n, F.least(r - 1, c - 1)))
    phi2 = F.greatest(F.lit(0.0), F.col("chi2") / n - F.try_divide((r - 1) * (c - 1), n - 1))
    rt = r - F.try_divide((r - 1) * (r - 1), n - 1)
    ct = c - F.try_divide((c - 1) * (c - 1), n - 1)
    denom = F.least(rt - 1, ct - 1)
    v = F.when(denom > 0, F.sqrt(F.try_divide(phi2, denom)))
    return t.select(*k, F.col("nn").cast("long").alias("n"), F.col("r").cast("long").alias("r"),
                    F.col("c").cast("long").alias("c"), F.when(ok, F.col("chi2")).alias("chi2"),
                    F.when(ok, ((r - 1) * (c - 1)).cast("long")).alias("df"),
                    F.when(ok, v).alias("v"), F.when(ok, raw).alias("v_raw"))


def _v_from_table(tab: np.ndarray, r: int, c: int) -> float:
    n = tab.sum()
    if n <= 1:
        return float("nan")
    rs, cs = tab.sum(axis=1), tab.sum(axis=0)
    e = np.outer(rs, cs) / n
    keep = e > 0
    chi2 = float(((tab[keep] - e[keep]) ** 2 / e[keep]).sum())
    phi2 = max(0.0, chi2 / n - (r - 1) * (c - 1) / (n - 1))
    rt = r - (r - 1) ** 2 / (n - 1)
    ct = c - (c - 1) ** 2 / (n - 1)
    d = min(rt - 1, ct - 1)
    return math.sqrt(phi2 / d) if d > 0 else float("nan")


def bootstrap(cont: DataFrame, draws: int = 300, conf_level: float = 0.95, min_rows: int = 50,
              seed: int = 0) -> DataFrame:
    """Observed V, percentile interval from ``draws`` multinomial resamples of
    the cells, and the chi-squared test p-value (Yates on 2x2 tables)."""
    lo_q, hi_q = (1 - conf_level) / 2, 1 - (1 - conf_level) / 2

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        f, tg = pdf["feature"].iloc[0], pdf["target"].iloc[0]
        tab = pdf.pivot_table(index="a", columns="b", values="n", aggfunc="sum", fill_value=0)
        t = tab.to_numpy(dtype=float)
        r, c = t.shape
        n = t.sum()
        if n < min_rows or r < 2 or c < 2:
            return pd.DataFrame({"feature": [f], "target": [tg], "v": [None], "lower": [None],
                                 "upper": [None], "p_value": [None]})
        v = _v_from_table(t, r, c)
        e = np.outer(t.sum(1), t.sum(0)) / n
        if r == 2 and c == 2:
            yates = np.minimum(0.5, np.abs(t - e))
            stat = float(((np.abs(t - e) - yates) ** 2 / e).sum())
        else:
            stat = float(((t - e) ** 2 / e).sum())
        p = chi2_sf(stat, (r - 1) * (c - 1))
        rng = np.random.default_rng(seed_of(f"{f}:{tg}", seed))
        d = rng.multinomial(int(n), (t / n).ravel(), size=draws).reshape(draws, r, c)
        vs = np.array([_v_from_table(d[i].astype(float), r, c) for i in range(draws)])
        vs = vs[~np.isnan(vs)]
        lo, hi = (float(np.quantile(vs, lo_q)), float(np.quantile(vs, hi_q))) if len(vs) else (None, None)
        return pd.DataFrame({"feature": [f], "target": [tg], "v": [v], "lower": [lo], "upper": [hi],
                             "p_value": [p]})

    schema = "feature string, target string, v double, lower double, upper double, p_value double"
    return cont.groupBy("feature", "target").applyInPandas(run, schema)


def scan(audit, policy: CatPolicy = CatPolicy()) -> DataFrame:
    feats = list(audit.spec.categorical)
    cont = cut_lineage(contingency(audit.values, feats, policy.max_levels))
    b = bootstrap(cont, policy.draws, policy.conf_level, policy.min_rows)
    levels = kept_levels(audit.values, feats, policy.max_levels).groupBy("feature") \
        .agg(F.count(F.lit(1)).alias("levels"))
    lab = b.where(F.col("target") == "label").select(
        "feature", F.col("v").alias("v_label"), F.col("lower").alias("v_label_lo"),
        F.col("upper").alias("v_label_hi"), F.col("p_value").alias("p_label"))
    win = b.where(F.col("target") == "window").select(
        "feature", F.col("v").alias("v_window"), F.col("lower").alias("v_window_lo"),
        F.col("upper").alias("v_window_hi"), F.col("p_value").alias("p_window"))
    r = cut_lineage(levels.join(lab, "feature", "left").join(win, "feature", "left"))
    measurable = F.col("v_label").isNotNull()
    better = F.coalesce(F.col("v_window").isNotNull() & F.when(
        measurable, F.col("v_window_lo") > F.col("v_label_hi")).otherwise(F.col("v_window_lo") > policy.period_floor),
        F.lit(False))
    r = r.select(F.col("feature").alias("column"), "levels", measurable.alias("label_measurable"),
                 "v_label", "v_label_lo", "v_label_hi", "v_window", "v_window_lo", "v_window_hi",
                 "p_label", "p_window", better.alias("knows_period_better"))
    r = R.bh_adjust(r, "p_label", "p_label_bh")
    return R.bh_adjust(r, "p_window", "p_window_bh")
