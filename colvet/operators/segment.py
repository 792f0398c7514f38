"""Segment qualification: does a column's signal survive inside segments?

Everything runs on the early window. Exposure is the WoE sign of the column's
bin (early, pooled binning); the 2x2xK tables are CELLS regrouped by segment
and exposure; Cochran-Mantel-Haenszel and Breslow-Day are closed-form sums
over strata (the Breslow-Day expected cell is a quadratic root per stratum).
Only the chi-squared tails are finished in Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dist import p_chi2
from ..plans import suffstats as S
from ..policy import SQPolicy
from ..session import cut_lineage
from . import rank as R
from . import woe as W


def segment_values(audit) -> DataFrame:
    """VALUES of the early window by segment (segment as text, null kept)."""
    spec = audit.spec
    feats = [f for f in spec.features if f != spec.segment]
    early = audit.fw.where(F.col("window") == "early") \
                    .withColumn("seg", F.col(spec.segment).cast("string"))
    return S.values_table(early, spec, feats, by=("seg",))


def dichotomy(audit) -> DataFrame:
    """(feature, bin_idx, exposed): exposed = early WoE > 0 and the bin is populated.
    The null bin carries no exposure (null rows leave the tables)."""
    w = audit.woe_of("early").join(audit.binning.select("feature", "n_core"), "feature")
    return w.where(F.col("bin_idx") != F.col("n_core")).select(
        "feature", "bin_idx", ((F.col("woe") > 0) & (F.col("n") > 0)).alias("exposed"))


def strata(audit, seg_cells: DataFrame) -> DataFrame:
    """2x2 tables per (feature, segment): a exposed/pos, b exposed/neg,
    c unexposed/pos, d unexposed/neg; ``usable`` when both exposures and both
    outcomes occur in the stratum."""
    d = dichotomy(audit)
    j = seg_cells.where(F.col("seg").isNotNull()).join(d, ["feature", "bin_idx"], "inner")
    t = j.groupBy("feature", "seg").agg(
        F.sum(F.when(F.col("exposed"), F.col("pos")).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("exposed"), F.col("neg")).otherwise(0)).alias("b"),
        F.sum(F.when(~F.col("exposed"), F.col("pos")).otherwise(0)).alias("c"),
        F.sum(F.when(~F.col("exposed"), F.col("neg")).otherwise(0)).alias("d"))
    usable = ((F.col("a") + F.col("b") > 0) & (F.col("c") + F.col("d") > 0)
              & (F.col("a") + F.col("c") > 0) & (F.col("b") + F.col("d") > 0))
    return t.withColumn("usable", usable)


def cmh_bd(tables: DataFrame, policy: SQPolicy = SQPolicy(), with_p: bool = True) -> DataFrame:
    """Mantel-Haenszel common OR and chi-squared (no continuity correction),
    Breslow-Day homogeneity statistic at that OR (no Tarone correction)."""
    n = F.col("a") + F.col("b") + F.col("c") + F.col("d")
    t = tables.withColumn("nn", n)
    rows = t.groupBy("feature").agg(F.sum("nn").alias("ok_rows"),
                                    F.count(F.when(F.col("usable"), F.lit(1))).alias("strata_used"),
                                    F.count(F.when(~F.col("usable"), F.lit(1))).alias("strata_dropped"))
    u = t.where(F.col("usable"))
    # unexposed row first, outcome 0 first: x11 = d, row1 = c + d, col1 = b + d
    r1 = (F.col("c") + F.col("d")).cast("double")
    r2 = (F.col("a") + F.col("b")).cast("double")
    c1 = (F.col("b") + F.col("d")).cast("double")
    c2 = (F.col("a") + F.col("c")).cast("double")
    u = u.withColumn("nn", F.col("nn").cast("double"))
    u = u.select("feature", "a", "b", "c", "d", "nn",
                 (F.col("a").cast("double") * F.col("d") / F.col("nn")).alias("ad_n"),
                 (F.col("b").cast("double") * F.col("c") / F.col("nn")).alias("bc_n"),
                 (r1 * c1 / F.col("nn")).alias("e11"),
                 (r1 * r2 * c1 * c2 / (F.col("nn") * F.col("nn") * (F.col("nn") - 1))).alias("v11"),
                 r1.alias("r1"), c1.alias("c1"), c2.alias("c2"))
    mh = u.groupBy("feature").agg(
        F.try_divide(F.sum("ad_n"), F.sum("bc_n")).alias("cmh_or"),
        F.try_divide((F.sum("d") - F.sum("e11")) * (F.sum("d") - F.sum("e11")), F.sum("v11")).alias("cmh_stat"))
    bd = u.join(mh.select("feature", "cmh_or"), "feature")
    OR = F.col("cmh_or")
    q0 = -F.col("r1") * F.col("c1") * OR
    q1 = F.col("c2") - F.col("r1") + OR * (F.col("c1") + F.col("r1"))
    q2 = F.lit(1.0) - OR
    disc = F.sqrt(q1 * q1 - 4 * q2 * q0)
    ra = F.try_divide(-q1 + disc, 2 * q2)
    rb = F.try_divide(-q1 - disc, 2 * q2)
    upper = F.least(F.col("c1"), F.col("r1"))
    ok_a = (ra > 0) & (ra <= upper)
    A = (F.when(q2 == 0, F.try_divide(-q0, q1))
          .when(ok_a, ra)
          .otherwise(rb))
    bd = bd.withColumn("A", A)
    one = F.lit(1.0)
    var = F.try_divide(one, F.try_divide(one, F.col("A")) + F.try_divide(one, F.col("r1") - F.col("A"))
                       + F.try_divide(one, F.col("c1") - F.col("A"))
                       + F.try_divide(one, F.col("nn") - F.col("r1") - F.col("c1") + F.col("A")))
    bd = bd.withColumn("term", F.try_divide((F.col("d") - F.col("A")) * (F.col("d") - F.col("A")), var)) \
           .groupBy("feature").agg(F.sum("term").alias("bd_stat"))
    out = rows.join(mh, "feature", "left").join(bd, "feature", "left")
    testable = (F.col("ok_rows") >= policy.min_rows) & (F.col("strata_used") >= 2)
    note = (F.when(F.col("ok_rows") < policy.min_rows, F.lit("too few usable rows"))
             .when(F.col("strata_used") < 2, F.lit("fewer than two usable strata"))
             .otherwise(F.lit("")))
    out = out.select("feature",
                     F.when(testable, F.col("cmh_or")).alias("cmh_or"),
                     F.when(testable, F.col("cmh_stat")).alias("cmh_stat"),
                     F.when(testable, F.col("bd_stat")).alias("bd_stat"),
                     F.when(testable, F.col("strata_used") - 1).alias("bd_df"),
                     F.when(F.col("ok_rows") >= policy.min_rows, F.col("strata_used"))
                      .otherwise(F.lit(0)).cast("long").alias("strata_used"),
                     F.when(F.col("ok_rows") >= policy.min_rows, F.col("strata_dropped"))
                      .cast("long").alias("strata_dropped"),
                     note.alias("note"))
    if with_p:
        out = (out.withColumn("cmh_p", p_chi2(F.col("cmh_stat"), F.lit(1.0)))
                  .withColumn("bd_p", p_chi2(F.col("bd_stat"), F.col("bd_df").cast("double"))))
    return out


def directionless_auc(audit, seg_vals: DataFrame, policy: SQPolicy = SQPolicy()) -> DataFrame:
    """max(AUC, 1 - AUC) per (feature, segment) and pooled (segment ``__pooled__``).

    Numeric columns rank raw values (null rows dropped); text columns are
    scored by the pooled early WoE, null rows included (their bin has a WoE).
    Needs >= 100 rows, >= 10 positives and >= 2 distinct scores.
    """
    spec = audit.spec
    numeric = [f for f in spec.numeric if f != spec.segment]
    text = [f for f in spec.text if f != spec.segment]
    num = seg_vals.where(F.col("feature").isin(numeric) & F.col("vnum").isNotNull())
    g_seg = num.where(F.col("seg").isNotNull()).groupBy("feature", "seg", F.col("vnum").alias("score")).agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("neg"))
    g_all = num.groupBy("feature", F.lit("__pooled__").alias("seg"), F.col("vnum").alias("score")).agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("neg"))
    a_num = R.auc_delong(g_seg.unionByName(g_all), ["feature", "seg"], bounded=False)

    seg_cells = S.cells_table(seg_vals.where(F.col("feature").isin(text)), audit.binning, by=("seg",))
    scored = W.score_cells(seg_cells, audit.woe_of("early"), by=("seg",))
    t_seg = scored.where(F.col("seg").isNotNull()).groupBy("feature", "seg", "score").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    t_all = scored.groupBy("feature", F.lit("__pooled__").alias("seg"), "score").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    a_txt = R.auc_delong(t_seg.unionByName(t_all), ["feature", "seg"], bounded=True)

    a = a_num.unionByName(a_txt)
    ok = ((F.col("n") >= policy.min_rows) & (F.col("pos_total") >= policy.min_positives)
          & (F.col("n_scores") >= 2) & F.col("auc").isNotNull())
    return a.select("feature", "seg", F.when(ok, F.greatest(F.col("auc"), 1 - F.col("auc"))).alias("auc"))


def scan(audit, policy: SQPolicy = SQPolicy()) -> DataFrame:
    spec = audit.spec
    sv = segment_values(audit)
    sv = cut_lineage(sv)
    seg_cells = S.cells_table(sv, audit.binning, by=("seg",))
    tests = cut_lineage(cmh_bd(strata(audit, seg_cells), policy))
    auc = cut_lineage(directionless_auc(audit, sv, policy))
    seg_sizes = (audit.fw.where((F.col("window") == "early") & F.col(spec.segment).isNotNull())
                 .groupBy(F.col(spec.segment).cast("string").alias("seg")).agg(F.count(F.lit(1)).alias("rows")))
    w = Window.orderBy(F.col("rows").desc(), F.col("seg").asc())
    dominant = seg_sizes.withColumn("rk", F.row_number().over(w)).where(F.col("rk") == 1) \
                        .select(F.col("seg").alias("dominant_segment"), F.lit(1).alias("_one"))
    n_levels = seg_sizes.agg(F.count(F.lit(1)).alias("segments_total")).withColumn("_one", F.lit(1))
    feats = audit.binning.select("feature").where(F.col("feature") != spec.segment).withColumn("_one", F.lit(1))
    base = feats.join(dominant, "_one").join(n_levels, "_one")
    pooled = auc.where(F.col("seg") == "__pooled__").select("feature", F.col("auc").alias("pooled_auc"))
    per = auc.where(F.col("seg") != "__pooled__")
    agg = per.groupBy("feature").agg(F.count("auc").alias("segments_measurable"),
                                     F.min("auc").alias("min_segment_auc"), F.max("auc").alias("max_segment_auc"))
    dom = per.join(dominant.drop("_one"), per["seg"] == dominant["dominant_segment"]) \
             .select("feature", F.col("auc").alias("dominant_auc"))
    r = (base.join(pooled, "feature", "left").join(dom, "feature", "left").join(agg, "feature", "left")
             .join(tests, "feature", "left"))
    r = r.select(F.col("feature").alias("column"), "pooled_auc", "dominant_segment", "dominant_auc",
                 F.col("dominant_auc").isNotNull().alias("measurable_in_dominant"),
                 F.coalesce(F.col("segments_measurable"), F.lit(0)).alias("segments_measurable"),
                 "segments_total", "min_segment_auc", "max_segment_auc",
                 (F.col("pooled_auc") - F.col("dominant_auc")).alias("gap_dominant"),
                 "cmh_or", "cmh_p", "bd_p", F.coalesce(F.col("strata_used"), F.lit(0)).alias("strata_used"),
                 F.coalesce(F.col("note"), F.lit("too few usable rows")).alias("note"))
    r = R.bh_adjust(cut_lineage(r), "cmh_p", "cmh_p_bh")
    r = R.bh_adjust(r, "bd_p", "bd_p_bh")
    art = (((F.col("cmh_p_bh").isNotNull()) & (F.col("cmh_p_bh") > policy.alpha) & (F.col("pooled_auc") > policy.artefact_auc))
           | (~F.col("measurable_in_dominant") & F.col("pooled_auc").isNotNull() & (F.col("pooled_auc") > policy.artefact_auc)))
    het = F.col("bd_p_bh").isNotNull() & (F.col("bd_p_bh") < policy.alpha)
    return r.withColumn("segment_artefact", art).withColumn("heterogeneous", het)
