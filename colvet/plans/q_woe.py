"""Registered queries: windows, binning, WoE."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import binning as B
from ..operators import windows as Wn
from ..operators import woe as W
from ..sources.frames import EVENTS_SPEC, load_frame
from . import oracle_sql as O
from . import suffstats as S
from .pipeline import prepare
from .registry import register

P = O.pipeline("events")
P_NOWOE = O.pipeline("events", woe=False)
EV = "WITH " + O.FRAME_SQL["events"].lstrip()


# ---------------------------------------------------------------- windows ---
@register("flt_quantile_nearest", sql=EV + """
, tq AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS rk, count(*) OVER () AS n FROM frame),
probs(i, p) AS (VALUES (0, 0.0), (1, 0.17), (2, 0.5), (3, 0.75), (4, 0.83), (5, 0.85), (6, 0.9), (7, 1.0))
SELECT i, p::DOUBLE AS p, t AS value FROM probs JOIN tq ON tq.rk = round_even(p::DOUBLE * (tq.n - 1), 0)
""", floats=("p",))
def q_quantile_nearest(spark, sf):
    """Nearest-rank order statistics of the events time axis."""
    fr, spec = load_frame(spark, sf, "events")
    probs = [0.0, 0.17, 0.5, 0.75, 0.83, 0.85, 0.9, 1.0]
    vals = Wn.quantile_nearest(fr, spec.time, probs)
    return spark.createDataFrame([(i, p, int(v)) for i, (p, v) in enumerate(zip(probs, vals))],
                                 "i int, p double, value long")


@register("flt_time_windows", sql="WITH " + O.FRAME_SQL["events"].lstrip() + "," + O.windows_sql() + """
SELECT "window", count(*) AS rows, min(t) AS t_min, max(t) AS t_max, sum(y)::BIGINT AS positives
FROM fw GROUP BY ALL""")
def q_time_windows(spark, sf):
    """Rows, time range and positives of the early and late windows."""
    a = prepare(spark, sf)
    return a.fw.groupBy("window").agg(F.count(F.lit(1)).alias("rows"), F.min("t").alias("t_min"),
                                      F.max("t").alias("t_max"),
                                      F.sum("y").cast("long").alias("positives"))


@register("flt_window_span", sql="WITH " + O.FRAME_SQL["events"].lstrip() + "," + O.windows_sql() + """
SELECT "window", count(*) AS rows, round((max(t) - min(t)) / 86400.0, 1) AS calendar_days,
       sum(y)::BIGINT AS positives
FROM fw GROUP BY ALL""", floats=("calendar_days",))
def q_window_span(spark, sf):
    """Rows, calendar days and positives of each audit window."""
    a = prepare(spark, sf)
    return Wn.window_span(a.fw, a.spec.time, a.spec.label)


_SPLIT_SQL = EV + "," + O.edges_sql((0.75, 0.85, 0.90)) + """,
seg AS (SELECT CASE WHEN t <= e0 THEN 'train' WHEN t <= e1 THEN 'gap' WHEN t <= e2 THEN 'validation'
                    ELSE 'test' END AS segment, t, y FROM frame, edges),
per AS (SELECT segment, count(*) AS rows, sum(y)::BIGINT AS positives, min(t) AS lo_, max(t) AS hi_
        FROM seg GROUP BY segment)
SELECT segment, rows, positives,
       round((CASE segment WHEN 'train' THEN e0 WHEN 'gap' THEN e1 WHEN 'validation' THEN e2 ELSE hi_ END
            - CASE segment WHEN 'train' THEN lo_ WHEN 'gap' THEN e0 WHEN 'validation' THEN e1 ELSE e2 END)
            / 86400.0, 1) AS calendar_days
FROM per, edges"""


@register("flt_split_table", sql=_SPLIT_SQL, floats=("calendar_days",))
def q_split_table(spark, sf):
    """Train / gap / validation / test at the 0.75, 0.85, 0.90 nearest-rank cuts: rows, positives, days."""
    fr, spec = load_frame(spark, sf, "events")
    return Wn.split_table(fr, spec.time, spec.label)


@register("flt_gap_cost", sql=EV + "," + O.edges_sql((0.75, 0.85)) + """
SELECT sum(CASE WHEN t > e0 AND t <= e1 THEN 1 ELSE 0 END)::BIGINT AS gap_rows,
       round(sum(CASE WHEN t > e0 AND t <= e1 THEN 1 ELSE 0 END) / count(*), 6) AS gap_share,
       sum(CASE WHEN t > e0 AND t <= e1 THEN y ELSE 0 END)::BIGINT AS gap_positives,
       round((max(e1) - max(e0)) / 86400.0, 1) AS gap_days
FROM frame, edges""", floats=("gap_share", "gap_days"))
def q_gap_cost(spark, sf):
    """Rows, share, positives and calendar days of the unassigned gap."""
    fr, spec = load_frame(spark, sf, "events")
    return Wn.gap_cost(fr, spec.time, spec.label)


# ---------------------------------------------------------------- binning ---
_BIN_LONG = """
SELECT feature, kind, degenerate, null_share, n_core + 1 AS n_bins, bin_idx,
       CASE WHEN kind = 'numeric' AND bin_idx < n_core THEN edges[bin_idx + 1] END AS lo,
       CASE WHEN kind = 'numeric' AND bin_idx < n_core THEN edges[bin_idx + 2] END AS hi,
       CASE WHEN kind = 'discrete' AND bin_idx < n_core - 1 THEN vals[bin_idx + 1] END AS value,
       CASE WHEN bin_idx = n_core THEN '__null__'
            WHEN kind <> 'numeric' AND bin_idx = n_core - 1 THEN '__other__'
            WHEN kind = 'categorical' THEN levels[bin_idx + 1] END AS level
FROM (SELECT b.*, r.bin_idx FROM binning2 b
      LEFT JOIN LATERAL (SELECT unnest(range(0, b.n_core + 1))::INTEGER AS bin_idx) r ON TRUE)"""


@register("bin_fit", sql=P_NOWOE + _BIN_LONG, floats=("null_share", "lo", "hi", "value"))
def q_bin_fit(spark, sf):
    """Binning fitted on the early window, one row per bin."""
    a = prepare(spark, sf)
    b = a.binning.select("*", F.explode_outer(F.sequence(F.lit(0), F.col("n_core"))).alias("bin_idx"))
    i = F.col("bin_idx")
    num = (F.col("kind") == "numeric") & (i < F.col("n_core"))
    return b.select(
        "feature", "kind", "degenerate", "null_share", (F.col("n_core") + 1).alias("n_bins"),
        i.cast("int").alias("bin_idx"),
        F.when(num, F.element_at("edges", i + 1)).alias("lo"),
        F.when(num, F.element_at("edges", i + 2)).alias("hi"),
        F.when((F.col("kind") == "discrete") & (i < F.col("n_core") - 1),
               F.element_at("vals", i + 1)).alias("value"),
        F.when(i == F.col("n_core"), F.lit("__null__"))
         .when((F.col("kind") != "numeric") & (i == F.col("n_core") - 1), F.lit("__other__"))
         .when(F.col("kind") == "categorical", F.element_at("levels", i + 1)).alias("level"))


@register("bin_assign", sql=P_NOWOE + "\nSELECT feature, \"window\", bin_idx, n, pos, neg FROM cells")
def q_bin_assign(spark, sf):
    """Both windows assigned to the early-window bins (CELLS)."""
    a = prepare(spark, sf)
    return a.cells.select("feature", "window", "bin_idx", "n", "pos", "neg")


@register("join_bin_range", sql=P_NOWOE + """
SELECT v.feature, v.vnum AS value, least(len(list_filter(b.edges, lambda e: e <= v.vnum)) - 1, b.n_core - 1) AS bin_idx,
       sum(v.n) AS n
FROM vals v JOIN binning2 b USING (feature)
WHERE b.kind = 'numeric' AND b.degenerate IS NULL AND v.vnum IS NOT NULL
GROUP BY ALL""", floats=("value",))
def q_join_bin_range(spark, sf):
    """Value -> [e_i, e_{i+1}) by a broadcast edge array (no shuffle of the values)."""
    a = prepare(spark, sf)
    b = a.binning.where((F.col("kind") == "numeric") & F.col("degenerate").isNull())
    j = a.values.where(F.col("vnum").isNotNull()).join(F.broadcast(b), "feature")
    return (j.withColumn("bin_idx", S.assign_bin_expr())
             .groupBy("feature", F.col("vnum").alias("value"), "bin_idx")
             .agg(F.sum("n").alias("n")))


@register("join_lookup", sql=P_NOWOE + """
SELECT v.feature, v.vnum AS value_num, v.vtxt AS value_txt, (""" + O.bin_expr() + """)::INTEGER AS bin_idx,
       sum(v.n) AS n
FROM vals v JOIN binning2 b USING (feature)
WHERE b.kind <> 'numeric' AND b.degenerate IS NULL
GROUP BY ALL""", floats=("value_num",))
def q_join_lookup(spark, sf):
    """Value -> bin by exact match; unmatched -> ``__other__``, null -> ``__null__``."""
    a = prepare(spark, sf)
    b = a.binning.where((F.col("kind") != "numeric") & F.col("degenerate").isNull())
    j = a.values.join(F.broadcast(b), "feature")
    return (j.withColumn("bin_idx", S.assign_bin_expr())
             .groupBy("feature", F.col("vnum").alias("value_num"), F.col("vtxt").alias("value_txt"),
                      "bin_idx")
             .agg(F.sum("n").alias("n")))


@register("join_complete_levels", sql=P + """
SELECT feature, "window", bin_idx, n, pos, neg FROM woe_full""")
def q_complete_levels(spark, sf):
    """Every bin of every fitted feature for both windows, empty bins as zeros."""
    a = prepare(spark, sf)
    return W.complete_cells(a.cells, a.binning, ["early", "late"]) \
            .select("feature", "window", "bin_idx", "n", "pos", "neg")


_WOE_F = ("share", "p_pos", "p_neg", "woe", "iv_part")


@register("woe_table", sql=P + """
SELECT feature, "window", bin_idx, n, pos, neg, share, p_pos, p_neg, woe, iv_part FROM woe""",
          floats=_WOE_F)
def q_woe_table(spark, sf):
    """Weight of evidence per bin, early and late windows (flagship)."""
    return prepare(spark, sf).woe


@register("woe_iv", sql=P + """
SELECT feature, "window", sum(iv_part) AS iv FROM woe GROUP BY ALL""", floats=("iv",))
def q_woe_iv(spark, sf):
    """Information value per feature and window."""
    return W.information_value(prepare(spark, sf).woe)


@register("woe_score", sql=P + """
SELECT c.feature, c."window", c.bin_idx, w.woe AS score, c.n, c.pos, c.neg
FROM cells c JOIN woe w ON w.feature = c.feature AND w.bin_idx = c.bin_idx AND w."window" = 'early'
""", floats=("score",))
def q_woe_score(spark, sf):
    """Every cell of both windows scored with the early-window WoE."""
    a = prepare(spark, sf)
    return W.score_cells(a.cells, a.woe_of("early")) \
            .select("feature", "window", "bin_idx", "score", "n", "pos", "neg")


@register("join_early_late_bins", sql=P + """
SELECT e.feature, e.bin_idx, e.woe AS woe_early, l.woe AS woe_late, e.n AS n_early, l.n AS n_late
FROM woe e JOIN woe l ON e.feature = l.feature AND e.bin_idx = l.bin_idx
WHERE e."window" = 'early' AND l."window" = 'late'""", floats=("woe_early", "woe_late"))
def q_early_late(spark, sf):
    """Early and late WoE side by side, bin by bin."""
    a = prepare(spark, sf)
    e = a.woe_of("early").select("feature", "bin_idx", F.col("woe").alias("woe_early"),
                                 F.col("n").alias("n_early"))
    l = a.woe_of("late").select("feature", "bin_idx", F.col("woe").alias("woe_late"),
                                F.col("n").alias("n_late"))
    return e.join(l, ["feature", "bin_idx"])


WOE_AGREE_SQL = """,
agree_j AS (
  SELECT e.feature, e.bin_idx, e.woe AS w_ref, l.woe AS w_cur, e.n AS n_ref, l.n AS n_cur, l.share AS s_cur
  FROM woe e JOIN woe l ON e.feature = l.feature AND e.bin_idx = l.bin_idx
  WHERE e."window" = 'early' AND l."window" = 'late'),
agree_u AS (
  SELECT feature, w_ref, w_cur,
         rank() OVER (PARTITION BY feature ORDER BY w_ref)
           + (count(*) OVER (PARTITION BY feature, w_ref) - 1) / 2.0 AS ra,
         rank() OVER (PARTITION BY feature ORDER BY w_cur)
           + (count(*) OVER (PARTITION BY feature, w_cur) - 1) / 2.0 AS rb
  FROM agree_j WHERE n_ref > 0 AND n_cur > 0),
agree_r AS (SELECT feature, count(*) AS usable_bins,
                   CASE WHEN isnan(corr(ra, rb)) THEN NULL ELSE corr(ra, rb) END AS rho
            FROM agree_u GROUP BY feature),
agree AS (
  SELECT j.feature,
         CASE WHEN coalesce(max(r.usable_bins), 0) >= 3 THEN max(r.rho) END AS rho,
         sum(CASE WHEN j.n_ref > 0 AND j.n_cur > 0 AND abs(j.w_ref) > 0.05 AND abs(j.w_cur) > 0.05
                       AND sign(j.w_ref) <> sign(j.w_cur) THEN j.s_cur ELSE 0.0 END) AS flip_mass
  FROM agree_j j LEFT JOIN agree_r r USING (feature) GROUP BY j.feature)"""


@register("woe_agreement", sql=P + WOE_AGREE_SQL + "\nSELECT feature, rho, flip_mass FROM agree",
          floats=("rho", "flip_mass"))
def q_woe_agreement(spark, sf):
    """Spearman of early and late WoE over populated bins, and late mass in sign-flipped bins."""
    a = prepare(spark, sf)
    return W.woe_agreement(a.woe_of("early"), a.woe_of("late"))


_AMOUNT_SQL = ("WITH " + O.FRAME_SQL["events"].lstrip() + ","
               + O.values_sql(EVENTS_SPEC, src="frame", by=(), features=["value"]) + ","
               + O.binning_sql(EVENTS_SPEC, ref=None, features=["value"])
               + O.cells_sql(by=())
               + """,
cells1 AS (SELECT *, 'all' AS scope FROM cells)"""
               + O.woe_sql(cells="cells1", by_values=("all",), by="scope") + """,
ivs AS (SELECT sum(iv_part) AS iv FROM woe),
lab AS (SELECT quantile_cont(CASE WHEN y = 0 THEN value END, 0.5) AS median_neg,
               quantile_cont(CASE WHEN y = 1 THEN value END, 0.5) AS median_pos,
               avg(CASE WHEN y = 0 THEN value END) AS mean_neg,
               avg(CASE WHEN y = 1 THEN value END) AS mean_pos FROM frame)
SELECT w.bin_idx, w.n, w.pos, w.share, w.woe, w.iv_part, ivs.iv, lab.*
FROM woe w, ivs, lab""")


@register("woe_amount_profile", sql=_AMOUNT_SQL,
          floats=("share", "woe", "iv_part", "iv", "median_neg", "median_pos", "mean_neg", "mean_pos"))
def q_amount_profile(spark, sf):
    """WoE of ``value`` over the whole frame, its IV, median and mean by label."""
    fr, spec = load_frame(spark, sf, "events")
    vals = S.values_table(fr, spec, ["value"], by=())
    b = B.fit(vals, spec, ["value"], ref_window=None)
    cells = S.cells_table(vals, b, by=()).withColumn("scope", F.lit("all"))
    woe = W.woe_table(W.complete_cells(cells, b, ["all"], by_col="scope"), by=("scope",))
    iv = woe.agg(F.sum("iv_part").alias("iv"))
    counts = (vals.groupBy("y", "vnum").agg(F.sum("n").alias("c"))
                  .where(F.col("vnum").isNotNull()))
    tot = counts.groupBy("y").agg(F.sum("c").alias("nonnull"))
    med = B.type7_quantiles(counts.join(tot, "y"), ["y"], [0.5])
    means = counts.groupBy("y").agg((F.sum(F.col("vnum") * F.col("c")) / F.sum("c")).alias("mean"))
    lab = med.join(means, "y").agg(
        F.max(F.when(F.col("y") == 0, F.col("q"))).alias("median_neg"),
        F.max(F.when(F.col("y") == 1, F.col("q"))).alias("median_pos"),
        F.max(F.when(F.col("y") == 0, F.col("mean"))).alias("mean_neg"),
        F.max(F.when(F.col("y") == 1, F.col("mean"))).alias("mean_pos"))
    # iv and lab are one row each: joined on a constant key.
    return (woe.select("bin_idx", "n", "pos", "share", "woe", "iv_part", F.lit(1).alias("_one"))
               .join(iv.withColumn("_one", F.lit(1)), "_one")
               .join(lab.withColumn("_one", F.lit(1)), "_one").drop("_one"))
