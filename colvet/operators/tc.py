"""Time consistency: does a column's relation to the label hold from the early
to the late window?

The early window's WoE scorecard scores both windows; each window gets an AUC
with a DeLong interval, the two are compared by an unpaired DeLong test, and
across the scan Benjamini-Hochberg decides which differences are real. Every
step is a function of CELLS (scores) or VALUES (raw ranks for Somers' D), so
the whole scan is one set of small aggregations over all features at once.

Verdict (on AUC figures already rounded to 4 places, as reported):
inverted   train lower > 0.5, holdout upper < 0.5, BH p < alpha, Gini drop >= min
weak       both intervals contain 0.5
pass       otherwise;  ``unstable`` = not inverted, BH p < alpha, drop >= min.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dist import p_t_two_sided
from ..plans.pipeline import Audit
from ..policy import TCPolicy
from ..session import cut_lineage
from . import rank as R
from . import woe as W


def r4(c):
    """Round to 4 places, half to even, on the scaled double."""
    return F.bround(c * F.lit(1e4), 0) / F.lit(1e4)


def feature_guards(a: Audit, policy: TCPolicy = TCPolicy()) -> DataFrame:
    """Per feature: window sizes, positives, null rates, train distinct count
    and the first degenerate reason (ordered cheapest first)."""
    v = a.values
    notnull = F.col("vnum").isNotNull() | F.col("vtxt").isNotNull()
    per = (v.groupBy("feature")
            .agg(F.sum(F.when(F.col("window") == "early", F.col("n")).otherwise(0)).alias("n_train"),
                 F.sum(F.when(F.col("window") == "late", F.col("n")).otherwise(0)).alias("n_holdout"),
                 F.sum(F.when((F.col("window") == "early") & (F.col("y") == 1), F.col("n")).otherwise(0)).alias("pos_train"),
                 F.sum(F.when((F.col("window") == "late") & (F.col("y") == 1), F.col("n")).otherwise(0)).alias("pos_holdout"),
                 F.sum(F.when((F.col("window") == "early") & ~notnull, F.col("n")).otherwise(0)).alias("null_train"),
                 F.sum(F.when((F.col("window") == "late") & ~notnull, F.col("n")).otherwise(0)).alias("null_holdout")))
    distinct = (v.where((F.col("window") == "early") & notnull)
                 .select("feature", "vnum", "vtxt").distinct()
                 .groupBy("feature").agg(F.count(F.lit(1)).alias("distinct_train")))
    g = per.join(distinct, "feature", "left").fillna(0, ["distinct_train"])
    g = g.join(a.binning.select("feature", F.col("degenerate").alias("bin_degenerate")), "feature", "left")
    note = (F.when((F.col("n_train") < policy.min_rows) | (F.col("n_holdout") < policy.min_rows),
                   F.lit(f"window smaller than min_rows={policy.min_rows}"))
             .when((F.col("pos_train") == 0) | (F.col("pos_train") == F.col("n_train"))
                   | (F.col("pos_holdout") == 0) | (F.col("pos_holdout") == F.col("n_holdout")),
                   F.lit("a window has only one class"))
             .when(F.least("pos_train", "pos_holdout") < policy.min_positives,
                   F.lit(f"fewer than min_positives={policy.min_positives}"))
             .when(F.col("null_train") == F.col("n_train"), F.lit("all-null in the training window"))
             .when(F.col("distinct_train") < 2, F.lit("constant in the training window"))
             .when(F.col("bin_degenerate").isNotNull(), F.col("bin_degenerate")))
    return g.withColumn("guard", note)


def scored_auc(a: Audit, conf_level: float = 0.95) -> DataFrame:
    """AUC, variance and CI of each window scored with the early WoE."""
    scored = W.score_cells(a.cells, a.woe_of("early"))
    groups = scored.groupBy("feature", "window", "score").agg(F.sum("pos").alias("pos"),
                                                               F.sum("neg").alias("neg"))
    return R.auc_delong(groups, ["feature", "window"], "score", bounded=True, conf_level=conf_level)


def feature_stats(a: Audit, policy: TCPolicy = TCPolicy()) -> DataFrame:
    """One row per feature with every per-feature statistic (before BH)."""
    g = feature_guards(a, policy)
    auc = scored_auc(a, policy.conf_level)
    tr = auc.where(F.col("window") == "early").select(
        "feature", F.col("auc").alias("a_tr"), F.col("var").alias("v_tr"),
        F.col("lower").alias("lo_tr"), F.col("upper").alias("hi_tr"), F.col("n").alias("ok_tr"))
    ho = auc.where(F.col("window") == "late").select(
        "feature", F.col("auc").alias("a_ho"), F.col("var").alias("v_ho"),
        F.col("lower").alias("lo_ho"), F.col("upper").alias("hi_ho"), F.col("n").alias("ok_ho"))
    ivs = W.information_value(a.woe).groupBy("feature").agg(
        F.max(F.when(F.col("window") == "early", F.col("iv"))).alias("iv_tr"),
        F.max(F.when(F.col("window") == "late", F.col("iv"))).alias("iv_ho"))
    agree = W.woe_agreement(a.woe_of("early"), a.woe_of("late"), policy.woe_eps)
    numeric = a.values.where(F.col("feature").isin(list(a.spec.numeric)))
    dxy = R.somers_d(numeric, by=("window",)).groupBy("feature").agg(
        F.max(F.when(F.col("window") == "early", F.col("dxy"))).alias("d_tr"),
        F.max(F.when(F.col("window") == "late", F.col("dxy"))).alias("d_ho"))
    s = (g.join(tr, "feature", "left").join(ho, "feature", "left").join(ivs, "feature", "left")
          .join(agree, "feature", "left").join(dxy, "feature", "left"))
    note = F.coalesce(F.col("guard"),
                      F.when(F.col("a_tr").isNull() | F.col("a_ho").isNull(),
                             F.lit("AUC not estimable on the scored window")),
                      F.lit(""))
    s = s.withColumn("note", note)
    t, df = R.delong_unpaired_stat("a_tr", "v_tr", "ok_tr", "a_ho", "v_ho", "ok_ho")
    return s.withColumn("t_delong", t).withColumn("df_delong", df)


def feature_report(a: Audit, policy: TCPolicy = TCPolicy(), with_p: bool = True) -> DataFrame:
    """``time_consistency_feature`` for every feature: rounded figures, or the
    degenerate row (only sizes and raw null rates) when a guard fires."""
    s = feature_stats(a, policy)
    ok = F.col("note") == ""

    def measured(c):
        return F.when(ok, c)

    cols = [
        "feature",
        measured(r4(F.col("a_tr"))).alias("auc_train"), measured(r4(F.col("a_ho"))).alias("auc_holdout"),
        measured(r4(F.col("a_ho") - F.col("a_tr"))).alias("delta"),
        measured(r4(F.col("lo_tr"))).alias("auc_train_lo"), measured(r4(F.col("hi_tr"))).alias("auc_train_hi"),
        measured(r4(F.col("lo_ho"))).alias("auc_holdout_lo"), measured(r4(F.col("hi_ho"))).alias("auc_holdout_hi"),
        measured(r4(F.col("d_tr"))).alias("dxy_train"), measured(r4(F.col("d_ho"))).alias("dxy_holdout"),
        measured(r4(F.col("iv_tr"))).alias("iv_train"), measured(r4(F.col("iv_ho"))).alias("iv_holdout"),
        measured(r4(F.col("rho"))).alias("woe_rho"), measured(r4(F.col("flip_mass"))).alias("woe_flip_mass"),
        measured(F.col("t_delong")).alias("t_delong"), measured(F.col("df_delong")).alias("df_delong"),
        F.col("n_train").cast("long").alias("n_train"), F.col("n_holdout").cast("long").alias("n_holdout"),
        F.when(ok, r4(F.col("null_train") / F.col("n_train")))
         .otherwise(F.when(F.col("n_train") > 0, F.col("null_train") / F.col("n_train")).otherwise(F.lit(1.0)))
         .alias("null_rate_train"),
        F.when(ok, r4(F.col("null_holdout") / F.col("n_holdout")))
         .otherwise(F.when(F.col("n_holdout") > 0, F.col("null_holdout") / F.col("n_holdout")).otherwise(F.lit(1.0)))
         .alias("null_rate_holdout"),
        "note",
    ]
    out = s.select(*cols)
    if with_p:
        out = out.withColumn("p_delong", p_t_two_sided(F.col("t_delong"), F.col("df_delong")))
    return out


def scan(a: Audit, policy: TCPolicy = TCPolicy()) -> DataFrame:
    """Full scan: BH over the DeLong p-values, verdict and ``unstable`` flag."""
    rep = cut_lineage(feature_report(a, policy, with_p=True))
    rep = R.bh_adjust(rep, "p_delong", "p_delong_bh")
    drop = (2 * F.col("auc_train") - 1) - (2 * F.col("auc_holdout") - 1)
    sig = F.col("p_delong_bh").isNotNull() & (F.col("p_delong_bh") < policy.alpha)
    inverted = ((F.col("auc_train_lo") > 0.5) & (F.col("auc_holdout_hi") < 0.5) & sig
                & (drop >= policy.min_gini_drop))
    weak = ((F.col("auc_train_lo") <= 0.5) & (F.col("auc_train_hi") >= 0.5)
            & (F.col("auc_holdout_lo") <= 0.5) & (F.col("auc_holdout_hi") >= 0.5))
    verdict = (F.when(F.col("note") != "", F.lit("degenerate"))
                .when(inverted, F.lit("inverted"))
                .when(weak, F.lit("weak")).otherwise(F.lit("pass")))
    rep = rep.withColumn("verdict", verdict)
    unstable = F.coalesce(sig & (F.col("verdict") != "inverted") & (drop >= policy.min_gini_drop),
                          F.lit(False))
    return rep.withColumn("unstable", unstable)


def margin_crosstab(report: DataFrame) -> DataFrame:
    """Tested verdict against the fixed-margin rules (0.52 / 0.48 / +-0.02)."""
    legacy = (F.when(F.col("auc_train").isNull() | F.col("auc_holdout").isNull(), F.lit("degenerate"))
               .when((F.col("auc_train") >= 0.52) & (F.col("auc_holdout") <= 0.48), F.lit("inverted"))
               .when((F.abs(F.col("auc_train") - 0.5) < 0.02) & (F.abs(F.col("auc_holdout") - 0.5) < 0.02),
                     F.lit("weak"))
               .otherwise(F.lit("pass")))
    return (report.groupBy(legacy.alias("margin"), F.col("verdict").alias("tested"))
                  .agg(F.count(F.lit(1)).alias("n")))
