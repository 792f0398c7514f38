"""Registered queries: rank statistics and time consistency."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rank as R
from ..operators import tc as TC
from ..sources.frames import EVENTS_SPEC
from . import oracle_sql as O
from .pipeline import prepare
from .q_woe import WOE_AGREE_SQL
from .registry import register

P = O.pipeline("events")
NUMERIC_IN = ", ".join(f"'{f}'" for f in EVENTS_SPEC.numeric)

GUARDS_SQL = """,
g AS (
  SELECT feature,
    sum(CASE WHEN "window" = 'early' THEN n ELSE 0 END) AS n_train,
    sum(CASE WHEN "window" = 'late' THEN n ELSE 0 END) AS n_holdout,
    sum(CASE WHEN "window" = 'early' AND y = 1 THEN n ELSE 0 END) AS pos_train,
    sum(CASE WHEN "window" = 'late' AND y = 1 THEN n ELSE 0 END) AS pos_holdout,
    sum(CASE WHEN "window" = 'early' AND vnum IS NULL AND vtxt IS NULL THEN n ELSE 0 END) AS null_train,
    sum(CASE WHEN "window" = 'late' AND vnum IS NULL AND vtxt IS NULL THEN n ELSE 0 END) AS null_holdout
  FROM vals GROUP BY feature),
gd AS (SELECT feature, count(*) AS distinct_train FROM (
         SELECT DISTINCT feature, vnum, vtxt FROM vals
         WHERE "window" = 'early' AND (vnum IS NOT NULL OR vtxt IS NOT NULL)) x GROUP BY feature),
guards AS (
  SELECT g.*, coalesce(gd.distinct_train, 0) AS distinct_train,
    CASE WHEN g.n_train < 100 OR g.n_holdout < 100 THEN 'window smaller than min_rows=100'
         WHEN g.pos_train = 0 OR g.pos_train = g.n_train OR g.pos_holdout = 0 OR g.pos_holdout = g.n_holdout
              THEN 'a window has only one class'
         WHEN least(g.pos_train, g.pos_holdout) < 10 THEN 'fewer than min_positives=10'
         WHEN g.null_train = g.n_train THEN 'all-null in the training window'
         WHEN coalesce(gd.distinct_train, 0) < 2 THEN 'constant in the training window'
         WHEN b.degenerate IS NOT NULL THEN b.degenerate END AS guard
  FROM g LEFT JOIN gd USING (feature) LEFT JOIN binning2 b USING (feature))"""

def stats_sql(numeric) -> str:
    """Per-feature statistics (CTE ``st``) after a frame's pipeline."""
    numeric_in = ", ".join(f"'{f}'" for f in numeric)
    return GUARDS_SQL + """,
sc AS (SELECT c.feature, c."window", w.woe AS score, sum(c.pos) AS pos, sum(c.neg) AS neg
       FROM cells c JOIN woe w ON w.feature = c.feature AND w.bin_idx = c.bin_idx AND w."window" = 'early'
       GROUP BY ALL)""" + O.auc_sql("sc", ["feature", '"window"'], "sauc") + f""",
dv AS (SELECT feature, "window", vnum AS score, sum(CASE WHEN y = 1 THEN n ELSE 0 END) AS pos,
              sum(CASE WHEN y = 0 THEN n ELSE 0 END) AS neg
       FROM vals WHERE vnum IS NOT NULL AND feature IN ({numeric_in}) GROUP BY ALL)""" + \
    O.auc_sql("dv", ["feature", '"window"'], "dauc") + WOE_AGREE_SQL + """,
ivs AS (SELECT feature, max(CASE WHEN "window" = 'early' THEN iv END) AS iv_tr,
               max(CASE WHEN "window" = 'late' THEN iv END) AS iv_ho
        FROM (SELECT feature, "window", sum(iv_part) AS iv FROM woe GROUP BY ALL) x GROUP BY feature),
dxy AS (SELECT feature, max(CASE WHEN "window" = 'early' THEN 2 * auc - 1 END) AS d_tr,
               max(CASE WHEN "window" = 'late' THEN 2 * auc - 1 END) AS d_ho FROM dauc GROUP BY feature),
st0 AS (
  SELECT g.*, tr.auc AS a_tr, tr.var AS v_tr, tr.lower AS lo_tr, tr.upper AS hi_tr, tr.n AS ok_tr,
         ho.auc AS a_ho, ho.var AS v_ho, ho.lower AS lo_ho, ho.upper AS hi_ho, ho.n AS ok_ho,
         ivs.iv_tr, ivs.iv_ho, ag.rho, ag.flip_mass, dxy.d_tr, dxy.d_ho
  FROM guards g
  LEFT JOIN (SELECT * FROM sauc WHERE "window" = 'early') tr USING (feature)
  LEFT JOIN (SELECT * FROM sauc WHERE "window" = 'late') ho USING (feature)
  LEFT JOIN ivs USING (feature) LEFT JOIN agree ag USING (feature) LEFT JOIN dxy USING (feature)),
st AS (
  SELECT *, coalesce(guard, CASE WHEN a_tr IS NULL OR a_ho IS NULL
                                 THEN 'AUC not estimable on the scored window' END, '') AS note,
         (a_tr - a_ho) / sqrt(v_tr + v_ho) AS t_delong,
         (v_tr + v_ho) * (v_tr + v_ho) / (v_tr * v_tr / (ok_tr - 1) + v_ho * v_ho / (ok_ho - 1)) AS df_delong
  FROM st0)"""


STATS_SQL = stats_sql(EVENTS_SPEC.numeric)


def _keep(x):
    return f"CASE WHEN note = '' THEN {O.r4(x)} END"


FEATURE_SELECT = f"""
SELECT feature,
  {_keep('a_tr')} AS auc_train, {_keep('a_ho')} AS auc_holdout, {_keep('a_ho - a_tr')} AS delta,
  {_keep('lo_tr')} AS auc_train_lo, {_keep('hi_tr')} AS auc_train_hi,
  {_keep('lo_ho')} AS auc_holdout_lo, {_keep('hi_ho')} AS auc_holdout_hi,
  {_keep('d_tr')} AS dxy_train, {_keep('d_ho')} AS dxy_holdout,
  {_keep('iv_tr')} AS iv_train, {_keep('iv_ho')} AS iv_holdout,
  {_keep('rho')} AS woe_rho, {_keep('flip_mass')} AS woe_flip_mass,
  CASE WHEN note = '' THEN t_delong END AS t_delong, CASE WHEN note = '' THEN df_delong END AS df_delong,
  n_train::BIGINT AS n_train, n_holdout::BIGINT AS n_holdout,
  CASE WHEN note = '' THEN {O.r4('null_train::DOUBLE / n_train')}
       WHEN n_train > 0 THEN null_train::DOUBLE / n_train ELSE 1.0 END AS null_rate_train,
  CASE WHEN note = '' THEN {O.r4('null_holdout::DOUBLE / n_holdout')}
       WHEN n_holdout > 0 THEN null_holdout::DOUBLE / n_holdout ELSE 1.0 END AS null_rate_holdout,
  note
FROM st"""

FEATURE_SQL = P + STATS_SQL + FEATURE_SELECT

TC_FLOATS = ("auc_train", "auc_holdout", "delta", "auc_train_lo", "auc_train_hi", "auc_holdout_lo",
             "auc_holdout_hi", "dxy_train", "dxy_holdout", "iv_train", "iv_holdout", "woe_rho",
             "woe_flip_mass", "t_delong", "df_delong", "null_rate_train", "null_rate_holdout")


def scan_sql(frame: str) -> str:
    """The whole scan of a frame (CTE ``tc``): p-values by quadrature, BH, verdicts."""
    return O.pipeline(frame) + stats_sql(O.SPECS[frame].numeric) + ",\nft AS (" + FEATURE_SELECT + f"""),
fp AS (SELECT *, CASE WHEN t_delong IS NOT NULL THEN {O.t_p('t_delong', 'df_delong')} END AS p_delong FROM ft)""" + \
        O.bh_sql("fp", "fb", "p_delong", "p_delong_bh") + """,
fv AS (SELECT *, (2 * auc_train - 1) - (2 * auc_holdout - 1) AS gini_drop, coalesce(p_delong_bh < 0.05, FALSE) AS sig FROM fb),
fw2 AS (
  SELECT *, CASE WHEN note <> '' THEN 'degenerate'
                 WHEN auc_train_lo > 0.5 AND auc_holdout_hi < 0.5 AND sig AND gini_drop >= 0.04::DOUBLE THEN 'inverted'
                 WHEN auc_train_lo <= 0.5 AND auc_train_hi >= 0.5 AND auc_holdout_lo <= 0.5 AND auc_holdout_hi >= 0.5 THEN 'weak'
                 ELSE 'pass' END AS verdict FROM fv),
tc AS (SELECT * EXCLUDE (gini_drop, sig), coalesce(sig AND verdict <> 'inverted' AND gini_drop >= 0.04::DOUBLE, FALSE) AS unstable FROM fw2)"""


@register("tc_guards", sql=P + GUARDS_SQL + """
SELECT feature, n_train::BIGINT AS n_train, n_holdout::BIGINT AS n_holdout, pos_train::BIGINT AS pos_train,
       pos_holdout::BIGINT AS pos_holdout, null_train::BIGINT AS null_train,
       null_holdout::BIGINT AS null_holdout, distinct_train::BIGINT AS distinct_train, guard
FROM guards""")
def q_tc_guards(spark, sf):
    """Window sizes, positives, nulls, distinct values and the first degenerate reason per feature."""
    g = TC.feature_guards(prepare(spark, sf))
    return g.select("feature", *[F.col(c).cast("long").alias(c) for c in
                                 ("n_train", "n_holdout", "pos_train", "pos_holdout", "null_train",
                                  "null_holdout", "distinct_train")], "guard")


@register("tc_feature", sql=FEATURE_SQL, floats=TC_FLOATS)
def q_tc_feature(spark, sf):
    """Per-feature time-consistency figures (statistic side; p-value by unit test)."""
    return TC.feature_report(prepare(spark, sf), with_p=False)


@register("tc_scan", sql=scan_sql("events") + "\nSELECT * FROM tc", floats=(*TC_FLOATS, "p_delong", "p_delong_bh"))
def q_tc_scan(spark, sf):
    """Whole scan with DeLong p-values, BH and verdicts."""
    return TC.scan(prepare(spark, sf))


@register("tc_margin_crosstab", sql=scan_sql("events") + """
SELECT CASE WHEN auc_train IS NULL OR auc_holdout IS NULL THEN 'degenerate'
            WHEN auc_train >= 0.52::DOUBLE AND auc_holdout <= 0.48::DOUBLE THEN 'inverted'
            WHEN abs(auc_train - 0.5) < 0.02::DOUBLE AND abs(auc_holdout - 0.5) < 0.02::DOUBLE THEN 'weak'
            ELSE 'pass' END AS margin, verdict AS tested, count(*)::BIGINT AS n FROM tc GROUP BY ALL""")
def q_tc_margin(spark, sf):
    """Tested verdicts against the fixed-margin rules."""
    return TC.margin_crosstab(TC.scan(prepare(spark, sf)))


# ------------------------------------------------------------------ ranks ---
@register("rank_somers_d", sql=P + f""",
dv AS (SELECT feature, "window", vnum AS score, sum(CASE WHEN y = 1 THEN n ELSE 0 END) AS pos,
              sum(CASE WHEN y = 0 THEN n ELSE 0 END) AS neg
       FROM vals WHERE vnum IS NOT NULL AND feature IN ({NUMERIC_IN}) GROUP BY ALL)"""
          + O.auc_sql("dv", ["feature", '"window"'], "dauc") + """
SELECT feature, "window", auc AS c_index, 2 * auc - 1 AS dxy, n FROM dauc""",
          floats=("c_index", "dxy"))
def q_somers(spark, sf):
    """Somers' D and C of each numeric feature against the label, per window."""
    a = prepare(spark, sf)
    return R.somers_d(a.values.where(F.col("feature").isin(list(a.spec.numeric))), by=("window",))


@register("rank_auc_delong", sql=P + """,
sc AS (SELECT c.feature, c."window", w.woe AS score, sum(c.pos) AS pos, sum(c.neg) AS neg
       FROM cells c JOIN woe w ON w.feature = c.feature AND w.bin_idx = c.bin_idx AND w."window" = 'early'
       GROUP BY ALL)""" + O.auc_sql("sc", ["feature", '"window"'], "sauc") + """
SELECT feature, "window", auc, var, lower, upper, n FROM sauc""",
          floats=("auc", "var", "lower", "upper"))
def q_auc_delong(spark, sf):
    """AUC with DeLong CI of each window scored by the early WoE (fixed direction)."""
    return TC.scored_auc(prepare(spark, sf)).select("feature", "window", "auc", "var", "lower",
                                                    "upper", "n")


@register("rank_delong_unpaired", sql=P + STATS_SQL + """
SELECT feature, t_delong, df_delong FROM st WHERE a_tr IS NOT NULL AND a_ho IS NOT NULL""",
          floats=("t_delong", "df_delong"))
def q_delong_unpaired(spark, sf):
    """Unpaired DeLong statistic and Welch degrees of freedom, early vs late."""
    s = TC.feature_stats(prepare(spark, sf))
    return s.where(F.col("a_tr").isNotNull() & F.col("a_ho").isNotNull()) \
            .select("feature", "t_delong", "df_delong")


@register("rank_cliffs_delta", sql=P + f""",
cv AS (SELECT feature, vnum AS score, sum(CASE WHEN "window" = 'late' THEN n ELSE 0 END) AS pos,
              sum(CASE WHEN "window" = 'early' THEN n ELSE 0 END) AS neg
       FROM vals WHERE vnum IS NOT NULL AND feature IN ({NUMERIC_IN}) GROUP BY ALL)"""
          + O.auc_sql("cv", ["feature"], "cauc") + """
SELECT feature, 2 * auc - 1 AS cliffs_delta, n FROM cauc""", floats=("cliffs_delta",))
def q_cliffs(spark, sf):
    """Cliff's delta of late against early values (window as the label), all rows."""
    a = prepare(spark, sf)
    return R.cliffs_delta(a.values.where(F.col("feature").isin(list(a.spec.numeric))))
