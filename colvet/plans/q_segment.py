"""Registered queries: segment qualification."""

from __future__ import annotations

from ..operators import segment as SQ
from ..plans import suffstats as S
from . import oracle_sql as O
from .pipeline import prepare
from .registry import register

def _sql(frame: str) -> tuple:
    """Reference SQL of a frame: strata and tests, segment AUCs, the whole scan (CTE ``sq``)."""
    spec = O.SPECS[frame]
    seg_feats = [f for f in spec.features if f != spec.segment]
    num = ", ".join(f"'{f}'" for f in spec.numeric if f != spec.segment)
    txt = ", ".join(f"'{f}'" for f in spec.text if f != spec.segment)

    base = O.pipeline(frame) + """,
early AS (SELECT *, c_mktsegment::VARCHAR AS seg FROM fw WHERE "window" = 'early')""" + \
        "," + O.values_sql(spec, src="early", by=("seg",), features=seg_feats, name="svals") + \
        O.cells_sql(src="svals", by=("seg",), name="scells") + """,
dich AS (SELECT w.feature, w.bin_idx, (w.woe > 0 AND w.n > 0) AS exposed
         FROM woe w JOIN binning2 b USING (feature) WHERE w."window" = 'early' AND w.bin_idx <> b.n_core),
strat AS (SELECT c.feature, c.seg,
                 sum(CASE WHEN d.exposed THEN c.pos ELSE 0 END) AS a, sum(CASE WHEN d.exposed THEN c.neg ELSE 0 END) AS b,
                 sum(CASE WHEN NOT d.exposed THEN c.pos ELSE 0 END) AS c, sum(CASE WHEN NOT d.exposed THEN c.neg ELSE 0 END) AS d
          FROM scells c JOIN dich d USING (feature, bin_idx) WHERE c.seg IS NOT NULL GROUP BY ALL),
strat2 AS (SELECT *, (a + b > 0 AND c + d > 0 AND a + c > 0 AND b + d > 0) AS usable, a + b + c + d AS nn FROM strat),
srows AS (SELECT feature, sum(nn) AS ok_rows, count(CASE WHEN usable THEN 1 END) AS strata_used,
                 count(CASE WHEN NOT usable THEN 1 END) AS strata_dropped FROM strat2 GROUP BY feature),
u AS (SELECT feature, a, b, c, d, nn::DOUBLE AS nn, a::DOUBLE * d / nn::DOUBLE AS ad_n, b::DOUBLE * c / nn::DOUBLE AS bc_n,
             (c + d)::DOUBLE * (b + d)::DOUBLE / nn::DOUBLE AS e11,
             (c + d)::DOUBLE * (a + b)::DOUBLE * (b + d)::DOUBLE * (a + c)::DOUBLE / (nn::DOUBLE * nn::DOUBLE * (nn::DOUBLE - 1)) AS v11,
             (c + d)::DOUBLE AS r1, (b + d)::DOUBLE AS c1, (a + c)::DOUBLE AS c2
      FROM strat2 WHERE usable),
mh AS (SELECT feature, sum(ad_n) / sum(bc_n) AS cmh_or,
              (sum(d) - sum(e11)) * (sum(d) - sum(e11)) / sum(v11) AS cmh_stat FROM u GROUP BY feature),
q AS (SELECT u.*, mh.cmh_or AS o_r, -u.r1 * u.c1 * mh.cmh_or AS q0,
             u.c2 - u.r1 + mh.cmh_or * (u.c1 + u.r1) AS q1, 1.0 - mh.cmh_or AS q2 FROM u JOIN mh USING (feature)),
q2 AS (SELECT *, (-q1 + sqrt(q1 * q1 - 4 * q2 * q0)) / (2 * q2) AS ra,
              (-q1 - sqrt(q1 * q1 - 4 * q2 * q0)) / (2 * q2) AS rb FROM q),
qa AS (SELECT *, CASE WHEN q2 = 0 THEN -q0 / q1 WHEN ra > 0 AND ra <= least(c1, r1) THEN ra ELSE rb END AS aa FROM q2),
bd AS (SELECT feature, sum((d - aa) * (d - aa) / (1.0 / (1.0 / aa + 1.0 / (r1 - aa) + 1.0 / (c1 - aa) + 1.0 / (nn - r1 - c1 + aa)))) AS bd_stat
       FROM qa GROUP BY feature),
tests AS (
  SELECT s.feature,
         CASE WHEN s.ok_rows >= 100 AND s.strata_used >= 2 THEN mh.cmh_or END AS cmh_or,
         CASE WHEN s.ok_rows >= 100 AND s.strata_used >= 2 THEN mh.cmh_stat END AS cmh_stat,
         CASE WHEN s.ok_rows >= 100 AND s.strata_used >= 2 THEN bd.bd_stat END AS bd_stat,
         CASE WHEN s.ok_rows >= 100 AND s.strata_used >= 2 THEN s.strata_used - 1 END AS bd_df,
         (CASE WHEN s.ok_rows >= 100 THEN s.strata_used ELSE 0 END)::BIGINT AS strata_used,
         (CASE WHEN s.ok_rows >= 100 THEN s.strata_dropped END)::BIGINT AS strata_dropped,
         CASE WHEN s.ok_rows < 100 THEN 'too few usable rows' WHEN s.strata_used < 2 THEN 'fewer than two usable strata'
              ELSE '' END AS note
  FROM srows s LEFT JOIN mh USING (feature) LEFT JOIN bd USING (feature))"""

    auc_cte = base + f""",
gnum AS (
  SELECT feature, seg, vnum AS score, sum(CASE WHEN y = 1 THEN n ELSE 0 END) AS pos, sum(CASE WHEN y = 0 THEN n ELSE 0 END) AS neg
  FROM svals WHERE feature IN ({num}) AND vnum IS NOT NULL AND seg IS NOT NULL GROUP BY ALL
  UNION ALL
  SELECT feature, '__pooled__' AS seg, vnum AS score, sum(CASE WHEN y = 1 THEN n ELSE 0 END), sum(CASE WHEN y = 0 THEN n ELSE 0 END)
  FROM svals WHERE feature IN ({num}) AND vnum IS NOT NULL GROUP BY ALL),
sct AS (SELECT c.feature, c.seg, w.woe AS score, c.pos, c.neg FROM scells c
        JOIN woe w ON w.feature = c.feature AND w.bin_idx = c.bin_idx AND w."window" = 'early'
        WHERE c.feature IN ({txt})),
gtxt AS (SELECT feature, seg, score, sum(pos) AS pos, sum(neg) AS neg FROM sct WHERE seg IS NOT NULL GROUP BY ALL
         UNION ALL
         SELECT feature, '__pooled__' AS seg, score, sum(pos), sum(neg) FROM sct GROUP BY ALL),
gall AS (SELECT * FROM gnum UNION ALL SELECT * FROM gtxt)""" + O.auc_sql("gall", ["feature", "seg"], "dauc") + """,
seg_auc AS (SELECT feature, seg, CASE WHEN n >= 100 AND pos_total >= 10 AND auc IS NOT NULL THEN greatest(auc, 1 - auc) END AS auc
            FROM dauc)"""

    scan = auc_cte + f""",
sizes AS (SELECT seg, count(*) AS rows FROM early WHERE seg IS NOT NULL GROUP BY seg),
dominant AS (SELECT seg AS dominant_segment FROM sizes ORDER BY rows DESC, seg LIMIT 1),
per AS (SELECT feature, count(auc) AS segments_measurable, min(auc) AS min_segment_auc, max(auc) AS max_segment_auc
        FROM seg_auc WHERE seg <> '__pooled__' GROUP BY feature),
sr AS (
  SELECT b.feature AS "column", po.auc AS pooled_auc, d.dominant_segment, da.auc AS dominant_auc,
         da.auc IS NOT NULL AS measurable_in_dominant, coalesce(per.segments_measurable, 0)::BIGINT AS segments_measurable,
         (SELECT count(*) FROM sizes)::BIGINT AS segments_total, per.min_segment_auc, per.max_segment_auc,
         po.auc - da.auc AS gap_dominant, t.cmh_or,
         CASE WHEN t.cmh_stat IS NOT NULL THEN {O.chi2_p('t.cmh_stat', '1.0::DOUBLE')} END AS cmh_p,
         CASE WHEN t.bd_stat IS NOT NULL THEN {O.chi2_p('t.bd_stat', 't.bd_df')} END AS bd_p,
         coalesce(t.strata_used, 0)::BIGINT AS strata_used, coalesce(t.note, 'too few usable rows') AS note
  FROM binning2 b, dominant d
  LEFT JOIN (SELECT * FROM seg_auc WHERE seg = '__pooled__') po ON po.feature = b.feature
  LEFT JOIN seg_auc da ON da.feature = b.feature AND da.seg = d.dominant_segment
  LEFT JOIN per ON per.feature = b.feature LEFT JOIN tests t ON t.feature = b.feature
  WHERE b.feature <> '{spec.segment}')""" + O.bh_sql("sr", "s1", "cmh_p", "cmh_p_bh") + \
        O.bh_sql("s1", "s2", "bd_p", "bd_p_bh") + """,
sq AS (SELECT *, (coalesce(cmh_p_bh > 0.05, FALSE) AND coalesce(pooled_auc > 0.55, FALSE))
                 OR (NOT measurable_in_dominant AND coalesce(pooled_auc > 0.55, FALSE)) AS segment_artefact,
              coalesce(bd_p_bh < 0.05, FALSE) AS heterogeneous FROM s2)"""
    return base, auc_cte, scan


BASE, AUC_CTE, SCAN_SQL = _sql("events")


def segment_scan_sql(frame: str) -> str:
    return _sql(frame)[2]


def _audit(spark, sf):
    a = prepare(spark, sf)
    sv = SQ.segment_values(a)
    return a, sv, S.cells_table(sv, a.binning, by=("seg",))


@register("sq_dichotomy", sql=BASE + "\nSELECT feature, bin_idx, exposed FROM dich")
def q_dichotomy(spark, sf):
    """Exposure per bin: early WoE > 0 and populated."""
    return SQ.dichotomy(prepare(spark, sf))


@register("sq_strata", sql=BASE + "\nSELECT feature, seg, a, b, c, d, usable FROM strat2")
def q_strata(spark, sf):
    """2x2 tables (exposure x outcome) per segment, with usability."""
    a, sv, sc = _audit(spark, sf)
    return SQ.strata(a, sc)


@register("sq_cmh", sql=BASE + "\nSELECT feature, cmh_or, cmh_stat, strata_used, strata_dropped, note FROM tests",
          floats=("cmh_or", "cmh_stat"))
def q_cmh(spark, sf):
    """Mantel-Haenszel common odds ratio and chi-squared statistic over usable segment strata."""
    a, sv, sc = _audit(spark, sf)
    return SQ.cmh_bd(SQ.strata(a, sc), with_p=False).select("feature", "cmh_or", "cmh_stat", "strata_used",
                                                            "strata_dropped", "note")


@register("sq_breslow_day", sql=BASE + "\nSELECT feature, bd_stat, bd_df FROM tests", floats=("bd_stat",))
def q_bd(spark, sf):
    """Breslow-Day homogeneity statistic and degrees of freedom."""
    a, sv, sc = _audit(spark, sf)
    return SQ.cmh_bd(SQ.strata(a, sc), with_p=False).select("feature", "bd_stat", "bd_df")


@register("rank_auc_directionless", sql=AUC_CTE + "\nSELECT feature, seg, auc FROM seg_auc", floats=("auc",))
def q_auc_dirless(spark, sf):
    """max(AUC, 1-AUC) per segment and pooled, early window."""
    a, sv, sc = _audit(spark, sf)
    return SQ.directionless_auc(a, sv)


@register("sq_scan", sql=SCAN_SQL + "\nSELECT * FROM sq",
          floats=("pooled_auc", "dominant_auc", "min_segment_auc", "max_segment_auc", "gap_dominant", "cmh_or", "cmh_p", "bd_p",
                  "cmh_p_bh", "bd_p_bh"))
def q_sq_scan(spark, sf):
    """Pooled and per-segment AUC, dominant-segment gap, CMH / BD with BH, artefact and heterogeneity flags."""
    return SQ.scan(prepare(spark, sf))
