"""Registered queries: categorical association (2.10) and missingness (2.12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import categorical as C
from ..operators import missingness as M
from ..sources.frames import EVENTS_SPEC
from . import oracle_sql as O
from .pipeline import prepare
from .registry import register

P = "WITH " + O.FRAME_SQL["events"].lstrip() + "," + O.windows_sql() + "," + O.values_sql(EVENTS_SPEC)
NUM = ", ".join(f"'{f}'" for f in EVENTS_SPEC.numeric)


def contingency_sql(frame: str) -> str:
    """The lumped level tables of a frame's categorical columns (CTE ``cont``)."""
    spec = O.SPECS[frame]
    cats = ", ".join(f"'{f}'" for f in spec.categorical)
    flags = ", ".join(f"'{f}'" for f in spec.logical)
    told = f"CASE WHEN feature IN ({flags}) THEN CASE vnum WHEN 1 THEN 'TRUE' WHEN 0 THEN 'FALSE' END ELSE vtxt END" if flags else "vtxt"
    return "WITH " + O.FRAME_SQL[frame].lstrip() + "," + O.windows_sql() + "," + O.values_sql(spec) + f""",
cvals AS (SELECT feature, "window", y, {told} AS vtxt, n FROM vals WHERE feature IN ({cats})),
tl AS (SELECT feature, vtxt FROM (
         SELECT feature, vtxt, row_number() OVER (PARTITION BY feature ORDER BY c DESC, vtxt) AS rn
         FROM (SELECT feature, vtxt, sum(n) AS c FROM cvals
               WHERE "window" = 'early' AND vtxt IS NOT NULL GROUP BY ALL) x) y
       WHERE rn <= 50),
lv AS (SELECT v.feature, v."window", v.y,
              CASE WHEN v.vtxt IS NULL THEN '__null__' WHEN tl.vtxt IS NOT NULL THEN v.vtxt ELSE '__other__' END AS a,
              v.n
       FROM cvals v LEFT JOIN tl ON tl.feature = v.feature AND tl.vtxt = v.vtxt),
cont AS (SELECT feature, 'label' AS target, a, y::VARCHAR AS b, sum(n) AS n FROM lv WHERE "window" = 'early' GROUP BY ALL
         UNION ALL
         SELECT feature, 'window' AS target, a, "window" AS b, sum(n) AS n FROM lv GROUP BY ALL)"""


CONT_SQL = contingency_sql("events")

V_SQL = CONT_SQL + """,
ra AS (SELECT feature, target, a, sum(n) AS ra FROM cont GROUP BY ALL),
cb AS (SELECT feature, target, b, sum(n) AS cb FROM cont GROUP BY ALL),
m AS (SELECT feature, target, sum(n) AS nn, count(DISTINCT a) AS r, count(DISTINCT b) AS c FROM cont GROUP BY ALL),
chi AS (SELECT t.feature, t.target,
               sum(t.n::DOUBLE * t.n / (ra.ra::DOUBLE * cb.cb / m.nn)) - max(m.nn) AS chi2
        FROM cont t JOIN ra USING (feature, target, a) JOIN cb USING (feature, target, b)
        JOIN m USING (feature, target) GROUP BY ALL),
vv AS (SELECT m.*, chi.chi2, m.nn::DOUBLE AS nd FROM m JOIN chi USING (feature, target)),
vv2 AS (SELECT *, (nn >= 50 AND r >= 2 AND c >= 2) AS ok,
               least((r - (r - 1) * (r - 1) / (nd - 1)) - 1, (c - (c - 1) * (c - 1) / (nd - 1)) - 1) AS denom,
               greatest(0.0, chi2 / nd - (r - 1) * (c - 1) / (nd - 1)) AS phi2 FROM vv)
"""


@register("cat_contingency", sql=CONT_SQL + "\nSELECT feature, target, a, b, n FROM cont")
def q_cont(spark, sf):
    """Lumped level x label (early) and lumped level x window counts."""
    a = prepare(spark, sf)
    return C.contingency(a.values, EVENTS_SPEC.text)


@register("cat_cramers_v", sql=V_SQL + """
SELECT feature, target, nn::BIGINT AS n, r::BIGINT AS r, c::BIGINT AS c,
       CASE WHEN ok AND denom > 0 THEN sqrt(phi2 / denom) END AS v,
       CASE WHEN ok THEN sqrt((chi2 / nd) / least(r - 1, c - 1)) END AS v_raw FROM vv2""",
          floats=("v", "v_raw"))
def q_v(spark, sf):
    """Cramer's V with and without Bergsma's correction, label and window tables."""
    a = prepare(spark, sf)
    return C.cramers_v(C.contingency(a.values, EVENTS_SPEC.text)).select("feature", "target", "n", "r", "c",
                                                                        "v", "v_raw")


@register("cat_chisq", sql=V_SQL + """
SELECT feature, target, CASE WHEN ok THEN chi2 END AS chi2, CASE WHEN ok THEN ((r - 1) * (c - 1))::BIGINT END AS df
FROM vv2""", floats=("chi2",))
def q_chisq(spark, sf):
    """Pearson chi-squared statistic and df of each table (p-value: see cat_bootstrap_ci)."""
    a = prepare(spark, sf)
    return C.cramers_v(C.contingency(a.values, EVENTS_SPEC.text)).select("feature", "target", "chi2", "df")


@register("cat_bootstrap_ci")
def q_boot(spark, sf):
    """V with a 95 % percentile interval from 500 multinomial cell resamples, chi-squared p."""
    a = prepare(spark, sf)
    return C.bootstrap(C.contingency(a.values, EVENTS_SPEC.text), draws=500)


@register("cat_scan")
def q_cat_scan(spark, sf):
    """V against the label and the window with bootstrap intervals, BH, knows_period_better."""
    return C.scan(prepare(spark, sf))


# ------------------------------------------------------------ missingness ---
FEATS_ORDER = ", ".join(f"('{f}', {i})" for i, f in enumerate(EVENTS_SPEC.features))
NUM_ORDER = ", ".join(f"('{f}', {i})" for i, f in enumerate(EVENTS_SPEC.numeric))

FAM_SQL = P + f""",
ord(feature, position) AS (VALUES {FEATS_ORDER}),
nc AS (SELECT feature, sum(CASE WHEN vnum IS NULL AND vtxt IS NULL THEN n ELSE 0 END) AS null_count, sum(n) AS rows
       FROM vals WHERE "window" = 'early' GROUP BY feature),
fam AS (SELECT nc.null_count::BIGINT AS null_count, count(*) OVER (PARTITION BY nc.null_count)::BIGINT AS size,
               nc.feature, ord.position, nc.rows
        FROM nc JOIN ord USING (feature) WHERE nc.null_count > 0),
fam2 AS (SELECT * FROM fam WHERE size >= 2)"""


@register("ms_families", sql=FAM_SQL + "\nSELECT null_count, size, feature, position FROM fam2")
def q_families(spark, sf):
    """Columns sharing an exact non-zero null count (early window), size >= 2."""
    a = prepare(spark, sf)
    return M.families(a.values, EVENTS_SPEC.features).select("null_count", "size", "feature", "position")


@register("ms_reference_columns", sql=P + f""",
ord(feature, position) AS (VALUES {NUM_ORDER}),
st AS (SELECT feature, sum(CASE WHEN vnum IS NULL THEN n ELSE 0 END)::DOUBLE / sum(n) AS null_share
       FROM vals WHERE "window" = 'early' AND feature IN ({NUM}) GROUP BY feature),
dc AS (SELECT feature, count(DISTINCT vnum) AS d FROM vals WHERE "window" = 'early' AND feature IN ({NUM})
       AND vnum IS NOT NULL GROUP BY feature)
SELECT feature, position FROM (
  SELECT ord.feature, ord.position, row_number() OVER (ORDER BY ord.position) AS rk
  FROM ord JOIN st USING (feature) JOIN dc USING (feature) WHERE st.null_share <= 0.001 AND dc.d > 5) x
WHERE rk <= 6""")
def q_refs(spark, sf):
    """First numeric columns that are nearly always present and vary."""
    a = prepare(spark, sf)
    return M.reference_columns(a.values, EVENTS_SPEC.numeric)


PAT_COLS = ["s_acctbal", "s_nationkey", "value", "k", "c_acctbal", "c_nationkey"]


def _pattern_sql():
    pat = " || ".join(f"CASE WHEN {c} IS NULL THEN '0' ELSE '1' END" for c in PAT_COLS)
    aggs = ["count(*) AS n"] + [f"sum({c}::DOUBLE) AS s_{i}" for i, c in enumerate(PAT_COLS)]
    for i, a in enumerate(PAT_COLS):
        for j in range(i, len(PAT_COLS)):
            aggs.append(f"sum({a}::DOUBLE * {PAT_COLS[j]}::DOUBLE) AS x_{i}_{j}")
    return ("WITH " + O.FRAME_SQL["events"].lstrip() + "," + O.windows_sql() +
            f"\nSELECT {pat} AS pattern, {', '.join(aggs)} FROM fw WHERE \"window\" = 'early' GROUP BY 1")


@register("ms_pattern_stats", sql=_pattern_sql(),
          floats=tuple([f"s_{i}" for i in range(len(PAT_COLS))]
                        + [f"x_{i}_{j}" for i in range(len(PAT_COLS)) for j in range(i, len(PAT_COLS))]))
def q_patterns(spark, sf):
    """Per missingness pattern of the supplier family plus references: n, sums, cross-products."""
    a = prepare(spark, sf)
    return M.pattern_stats(a.fw.where(F.col("window") == "early"), PAT_COLS)


@register("ms_mcar_test")
def q_mcar(spark, sf):
    """Little's MCAR test per missingness family (EM on pattern statistics of all rows)."""
    a = prepare(spark, sf)
    fams = M.families(a.values, EVENTS_SPEC.features)
    refs = [r["feature"] for r in M.reference_columns(a.values, EVENTS_SPEC.numeric).orderBy("position").collect()]
    return M.mcar_test(a.fw.where(F.col("window") == "early"), fams, refs)


@register("ms_indicator_auc", sql=FAM_SQL + """,
first AS (SELECT null_count, feature FROM (
            SELECT null_count, feature, row_number() OVER (PARTITION BY null_count ORDER BY position) AS rk FROM fam2) x
          WHERE rk = 1),
ig AS (SELECT f.null_count, CASE WHEN v.vnum IS NULL AND v.vtxt IS NULL THEN 1.0 ELSE 0.0 END AS score,
              sum(CASE WHEN v.y = 1 THEN v.n ELSE 0 END) AS pos, sum(CASE WHEN v.y = 0 THEN v.n ELSE 0 END) AS neg
       FROM vals v JOIN first f USING (feature) WHERE v."window" = 'early' GROUP BY ALL)""" +
          O.auc_sql("ig", ["null_count"], "iauc") + """
SELECT null_count, auc AS indicator_auc, lower AS indicator_auc_lo, upper AS indicator_auc_hi FROM iauc""",
          floats=("indicator_auc", "indicator_auc_lo", "indicator_auc_hi"))
def q_ind_auc(spark, sf):
    """AUC with DeLong interval of each family's missing flag against the label."""
    a = prepare(spark, sf)
    return M.indicator_auc(a.values, M.families(a.values, EVENTS_SPEC.features))


@register("ms_scan")
def q_ms_scan(spark, sf):
    """Families, MCAR test, indicator AUC, BH and absence_is_signal."""
    return M.scan(prepare(spark, sf))
