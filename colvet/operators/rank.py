"""Rank statistics from grouped counts: AUC with DeLong interval, Somers' D,
unpaired DeLong test, Benjamini-Hochberg.

Input is always a table of ``(keys..., score, pos, neg)``, one row per distinct
score. For a score value v with ``pos`` cases and ``neg`` controls, ``N<`` the
controls below it and ``P>`` the cases above it:

    V10(v) = (N< + neg/2) / N        V01(v) = (P> + pos/2) / P
    AUC    = sum pos*V10 / P
    var    = sum pos (V10-AUC)^2 / ((P-1) P) + sum neg (V01-AUC)^2 / ((N-1) N)

which is DeLong's placement variance, computed without pairs. Cumulative
sums come from windows when a key has few distinct scores (WoE scores: at
most ``max_levels + 2``), and from the bucketed cumulative plan otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dist import norm_ppf
from ..plans.cumulative import cumulative


def placements(groups: DataFrame, keys, score: str = "score", bounded: bool = True) -> DataFrame:
    keys = list(keys)
    if bounded:
        below = Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
        whole = Window.partitionBy(*keys)
        g = groups.select(*keys, score, "pos", "neg",
                          F.coalesce(F.sum("neg").over(below), F.lit(0)).alias("neg_below"),
                          F.coalesce(F.sum("pos").over(below), F.lit(0)).alias("pos_below"),
                          F.sum("pos").over(whole).alias("pos_total"),
                          F.sum("neg").over(whole).alias("neg_total"))
    else:
        g = cumulative(groups.select(*keys, score, "pos", "neg"), keys, score, ["pos", "neg"])
    P, N = F.col("pos_total"), F.col("neg_total")
    return (g.withColumn("v10", F.try_divide(F.col("neg_below") + F.col("neg") / 2.0, N))
             .withColumn("v01", F.try_divide((P - F.col("pos_below") - F.col("pos")) + F.col("pos") / 2.0, P)))


def auc_delong(groups: DataFrame, keys, score: str = "score", bounded: bool = True,
               conf_level: float = 0.95) -> DataFrame:
    """AUC (direction fixed: higher score = case), DeLong variance and CI.

    Null AUC when fewer than two score values, or a class is missing.
    Output: keys, auc, var, lower, upper, n, pos_total, neg_total, n_scores. One pass
    over the placements.
    """
    keys = list(keys)
    if not keys:
        groups = groups.withColumn("_k0", F.lit(0))
        out = auc_delong(groups, ["_k0"], score, bounded, conf_level)
        return out.drop("_k0")
    pl = placements(groups.where((F.col("pos") + F.col("neg")) > 0), keys, score, bounded)
    # squared placements around 1/2: their spread around the AUC, the mean of both, follows
    out = pl.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("pos") * F.col("v10")), F.first("pos_total")).alias("auc"),
        F.first("pos_total").alias("pos_total"), F.first("neg_total").alias("neg_total"),
        F.count(F.lit(1)).alias("n_scores"),
        F.sum(F.col("pos") * (F.col("v10") - 0.5) * (F.col("v10") - 0.5)).alias("qx"),
        F.sum(F.col("neg") * (F.col("v01") - 0.5) * (F.col("v01") - 0.5)).alias("qy"))
    P, N = F.col("pos_total"), F.col("neg_total")
    Pd, Nd = P.cast("double"), N.cast("double")
    off = (F.col("auc") - 0.5) * (F.col("auc") - 0.5)
    sx, sy = F.greatest(F.lit(0.0), F.col("qx") - Pd * off), F.greatest(F.lit(0.0), F.col("qy") - Nd * off)
    var = F.try_divide(sx, (Pd - 1) * Pd) + F.try_divide(sy, (Nd - 1) * Nd)
    ok = (P > 0) & (N > 0) & (F.col("n_scores") >= 2)
    z = norm_ppf(1 - (1 - conf_level) / 2)
    out = out.select(*keys,
                     F.when(ok, F.col("auc")).alias("auc"),
                     F.when(ok & (P > 1) & (N > 1), var).alias("var"),
                     (P + N).alias("n"), P.alias("pos_total"), N.alias("neg_total"), "n_scores")
    half = F.lit(z) * F.sqrt("var")
    return out.select("*",
                      F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("auc") - half)).alias("lower"),
                      F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("auc") + half)).alias("upper"))


def value_groups(values: DataFrame, by=()) -> DataFrame:
    """VALUES (numeric, non-null) summed to (feature, by..., score=vnum, pos, neg)."""
    return (values.where(F.col("vnum").isNotNull())
                  .groupBy("feature", *by, F.col("vnum").alias("score"))
                  .agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("pos"),
                       F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("neg")))


def somers_d(values: DataFrame, by=()) -> DataFrame:
    """Somers' D and C index of each numeric feature against the label, on
    complete cases; text features get null (no order to measure)."""
    a = auc_delong(value_groups(values, by), ["feature", *by], bounded=False)
    return a.select("feature", *by, F.col("auc").alias("c_index"),
                    (2 * F.col("auc") - 1).alias("dxy"), "n")


def bh_adjust(df: DataFrame, p: str, out: str, family=()) -> DataFrame:
    """Benjamini-Hochberg within each family, in one pass.

    ``m`` counts only non-null p-values; nulls sort last, so they never enter
    the running minimum taken from the largest rank down, and stay null. A
    family is one scan (one row per column): the window holds a schema-sized
    number of rows.
    """
    fam = list(family)
    base = Window.partitionBy(*fam) if fam else Window.partitionBy()
    order = base.orderBy(F.col(p).asc_nulls_last())
    t = (df.withColumn("_m", F.count(p).over(base))
           .withColumn("_r", F.row_number().over(order))
           .withColumn("_raw", F.col(p) * F.col("_m") / F.col("_r")))
    down = base.orderBy(F.col("_r").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return (t.withColumn(out, F.when(F.col(p).isNotNull(),
                                     F.least(F.lit(1.0), F.min("_raw").over(down))))
             .drop("_m", "_r", "_raw"))


def delong_unpaired_stat(a1: str, v1: str, n1: str, a2: str, v2: str, n2: str):
    """t statistic and Welch-type degrees of freedom of two independent AUCs."""
    s = F.col(v1) + F.col(v2)
    t = F.try_divide(F.col(a1) - F.col(a2), F.sqrt(s))
    df = F.try_divide(s * s, F.try_divide(F.col(v1) ** 2, F.col(n1) - 1) + F.try_divide(F.col(v2) ** 2, F.col(n2) - 1))
    return t, df


def cliffs_delta(values: DataFrame) -> DataFrame:
    """Cliff's delta (2*AUC-1) of late against early values, per numeric feature:
    the window plays the label, every non-null row counts."""
    groups = (values.where(F.col("vnum").isNotNull())
                    .groupBy("feature", F.col("vnum").alias("score"))
                    .agg(F.sum(F.when(F.col("window") == "late", F.col("n")).otherwise(0)).alias("pos"),
                         F.sum(F.when(F.col("window") == "early", F.col("n")).otherwise(0)).alias("neg")))
    a = auc_delong(groups, ["feature"], bounded=False)
    return a.select("feature", (2 * F.col("auc") - 1).alias("cliffs_delta"), "n")
