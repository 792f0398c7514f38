"""Registered queries: distribution shift."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rank as R
from ..operators import shift as SH
from ..sources.frames import EVENTS_SPEC
from . import oracle_sql as O
from .pipeline import prepare
from .registry import register

P = O.pipeline("events")

BC_SQL = """,
bc AS (SELECT feature, bin_idx, sum(CASE WHEN "window" = 'early' THEN n ELSE 0 END) AS ref,
              sum(CASE WHEN "window" = 'late' THEN n ELSE 0 END) AS cur FROM woe_full GROUP BY ALL),
bcn AS (SELECT bc.*, b.n_core FROM bc JOIN binning2 b USING (feature))"""


def contrib_sql(src: str, name: str) -> str:
    pr = "greatest(ref::DOUBLE / sum(ref) OVER w, 1e-6::DOUBLE)"
    pc = "greatest(cur::DOUBLE / sum(cur) OVER w, 1e-6::DOUBLE)"
    return f""",
{name} AS (SELECT *, ({pc} - {pr}) * ln({pc} / {pr}) AS contrib FROM {src}
           WINDOW w AS (PARTITION BY feature))"""


@register("ds_psi", sql=P + BC_SQL + contrib_sql("bcn", "ctb") + """
SELECT feature, sum(contrib) AS psi FROM ctb GROUP BY feature""", floats=("psi",))
def q_psi(spark, sf):
    """Population stability index of every binned feature, early -> late."""
    a = prepare(spark, sf)
    return SH.psi(SH.bin_counts(a.cells, a.binning))


@register("ds_psi_excl_null", sql=P + BC_SQL + """,
kept AS (SELECT * FROM bcn WHERE bin_idx <> n_core),
kt AS (SELECT feature, sum(ref) AS sr, sum(cur) AS sc FROM kept GROUP BY feature),
ok AS (SELECT kept.* FROM kept JOIN kt USING (feature) WHERE sr > 0 AND sc > 0)""" + contrib_sql("ok", "ctb") + """
SELECT kt.feature, v.psi_excl_null FROM kt
LEFT JOIN (SELECT feature, sum(contrib) AS psi_excl_null FROM ctb GROUP BY feature) v USING (feature)""",
          floats=("psi_excl_null",))
def q_psi_excl_null(spark, sf):
    """PSI with the null bin dropped from both windows."""
    a = prepare(spark, sf)
    return SH.psi_excl_null(SH.bin_counts(a.cells, a.binning))


@register("ds_top_bucket", sql=P + BC_SQL + contrib_sql("bcn", "ctb") + """
SELECT feature, top_bin_idx, top_contrib FROM (
  SELECT feature, bin_idx AS top_bin_idx, contrib AS top_contrib,
         row_number() OVER (PARTITION BY feature ORDER BY contrib DESC, bin_idx ASC) AS rk FROM ctb) x
WHERE rk = 1""", floats=("top_contrib",))
def q_top_bucket(spark, sf):
    """Bin with the largest PSI contribution per feature (lowest bin on ties)."""
    a = prepare(spark, sf)
    return SH.top_bucket(SH.bin_counts(a.cells, a.binning))


@register("ds_psi_null")
def q_psi_null(spark, sf):
    """PSI null by hypergeometric re-splits (200 draws per feature)."""
    a = prepare(spark, sf)
    return SH.psi_null(SH.bin_counts(a.cells, a.binning), draws=200)


@register("ds_scan")
def q_ds_scan(spark, sf):
    """PSI, its hypergeometric null, null-share movement, top bucket, BH and PSI over null q99."""
    return SH.scan(prepare(spark, sf))


@register("ds_noise_floor")
def q_noise_floor(spark, sf):
    """Median null q99 and the significant / material / both counts of the shift scan."""
    return SH.noise_floor(SH.scan(prepare(spark, sf)))


@register("ds_energy_test")
def q_energy(spark, sf):
    """Energy test of the joint distribution of the always-present numeric columns, over every complete row."""
    a = prepare(spark, sf)
    return SH.energy_test(a.fw, ["value", "k", "c_acctbal", "c_nationkey"], a.spec.id)


NUMERIC_IN = ", ".join(f"'{f}'" for f in EVENTS_SPEC.numeric)


@register("ds_ecdf_stats", sql=P + f""",
ev AS (SELECT feature, vnum, sum(CASE WHEN "window" = 'early' THEN n ELSE 0 END) AS a,
              sum(CASE WHEN "window" = 'late' THEN n ELSE 0 END) AS b
       FROM vals WHERE vnum IS NOT NULL AND feature IN ({NUMERIC_IN}) GROUP BY ALL),
ec AS (SELECT *, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER (PARTITION BY feature) AS na,
              sum(b) OVER (PARTITION BY feature) AS nb
       FROM ev WINDOW w AS (PARTITION BY feature ORDER BY vnum)),
eh AS (SELECT feature, (ca::DOUBLE / na - cb::DOUBLE / nb) * (ca::DOUBLE / na - cb::DOUBLE / nb) * (a + b) AS h,
              (ca + cb)::DOUBLE / (na + nb) AS e, na, nb,
              b * ((ca - a) + a / 2.0) AS wins, na * nb AS pairs FROM ec)
SELECT feature AS "column", sum(CASE WHEN e > 0 AND e < 1 THEN h / (e * (1 - e)) ELSE 0.0 END) AS ad_stat,
       sum(h) AS cvm_stat, 2 * (sum(wins)::DOUBLE / max(pairs)) - 1 AS cliffs_delta
FROM eh GROUP BY feature""", floats=("ad_stat", "cvm_stat", "cliffs_delta"))
def q_ecdf_stats(spark, sf):
    """Anderson-Darling and Cramer-von Mises statistics and Cliff's delta of each numeric column, over every row."""
    a = prepare(spark, sf)
    cols = list(EVENTS_SPEC.numeric)
    stats = SH.ecdf_stats_all(a.values, cols).select("feature", F.col("ad_stat_all").alias("ad_stat"), F.col("cvm_stat_all").alias("cvm_stat"))
    delta = R.cliffs_delta(a.values.where(F.col("feature").isin(cols))).select("feature", "cliffs_delta")
    return stats.join(delta, "feature").withColumnRenamed("feature", "column")


def _marginal(spark, sf, kind):
    a = prepare(spark, sf)
    return SH.marginal_tests(a.values, list(EVENTS_SPEC.numeric)).select(
        "column", "n_ref", "n_cur", f"{kind}_stat", f"{kind}_p", f"{kind}_p_bh", "cliffs_delta")


@register("ds_ad_test")
def q_ad(spark, sf):
    """Two-sample Anderson-Darling: statistic and 500 permutations over every row, Cliff's delta beside them."""
    return _marginal(spark, sf, "ad")


@register("ds_cvm_test")
def q_cvm(spark, sf):
    """Two-sample Cramer-von Mises: statistic and 500 permutations over every row, Cliff's delta beside them."""
    return _marginal(spark, sf, "cvm")
