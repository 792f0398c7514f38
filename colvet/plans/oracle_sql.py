"""Reference SQL (DuckDB dialect) for the correctness check.

Each builder returns CTE text that recomputes one shared intermediate from the
raw tables -- frame, windows, VALUES, binning, CELLS, WoE -- so every oracle
query is a standalone statement over the registered views. The SQL mirrors the
definitions, not the Spark plan: windows run over whole partitions here, which
is fine for a checker at sf0.01.
"""

from __future__ import annotations

from ..sources.frames import EVENTS_SPEC, LINES_SPEC, ORDERS_SPEC, PLANTED_FROM, PLANTED_SPEC, FrameSpec

FRAME_SQL = {
    "events": """
frame AS (
  SELECT e.event_id AS row_id, (epoch_us(e.ts) // 1000000)::BIGINT AS t,
         CASE WHEN e.event_type = 'error' THEN 1 ELSE 0 END AS y, e.event_type,
         e.user_id, e.value::DOUBLE AS value,
         json_extract_string(e.props, '$.k')::BIGINT AS k,
         s.s_acctbal::DOUBLE AS s_acctbal, s.s_nationkey::BIGINT AS s_nationkey,
         c.c_acctbal::DOUBLE AS c_acctbal, c.c_nationkey::BIGINT AS c_nationkey,
         c.c_mktsegment, n.n_name AS c_nation
  FROM events e
  LEFT JOIN supplier s ON e.user_id = s.s_suppkey
  LEFT JOIN customer c ON e.user_id = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey)""",
    "lines": """
frame AS (
  SELECT (epoch_us(l.l_shipdate) // 1000000)::BIGINT AS t, l.l_orderkey, l.l_partkey,
         datediff('day', o.o_orderdate::DATE, l.l_shipdate::DATE)::DOUBLE AS days_since_order,
         CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END AS y, o.o_custkey,
         l.l_quantity::DOUBLE AS l_quantity, l.l_extendedprice::DOUBLE AS l_extendedprice,
         l.l_discount::DOUBLE AS l_discount, l.l_tax::DOUBLE AS l_tax,
         l.l_linenumber::BIGINT AS l_linenumber, o.o_totalprice::DOUBLE AS o_totalprice,
         p.p_size::BIGINT AS p_size, p.p_retailprice::DOUBLE AS p_retailprice,
         c.c_acctbal::DOUBLE AS c_acctbal, c.c_nationkey::BIGINT AS c_nationkey,
         l.l_linestatus, o.o_orderstatus, o.o_orderpriority, p.p_brand, p.p_type, c.c_mktsegment
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN customer c ON o.o_custkey = c.c_custkey)""",
}

FRAME_SQL["planted"] = FRAME_SQL["events"].replace("frame AS (", "whole AS (", 1) + f""",
noise AS (
  SELECT *, (row_id * 7919 + 13) % 1009 / 1009.0::DOUBLE AS u1, (row_id * 104729 + 7) % 997 / 997.0::DOUBLE AS u2,
         (row_id * 15485863 + 3) % 991 / 991.0::DOUBLE AS u3, CASE WHEN t >= {PLANTED_FROM} THEN 1 ELSE 0 END AS late
  FROM whole),
frame AS (
  SELECT * EXCLUDE (u1, u2, u3, late), u1 + 0.35::DOUBLE * y * (1 - 2 * late) AS flip, u2 AS flip_mate,
         u3 + late AS drift_a, u1 * u2 + late AS drift_b FROM noise)"""

FRAME_SQL["orders"] = """
frame AS (
  SELECT o.o_orderkey AS row_id, (epoch_us(o.o_orderdate) // 1000000)::BIGINT AS t,
         CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, o.o_totalprice, c.c_nationkey, c.c_acctbal,
         CASE WHEN abs(c.c_acctbal) >= 100 THEN c.c_acctbal < 0 END AS in_debt, o.o_orderpriority = '1-URGENT' AS urgent,
         o.o_orderpriority, c.c_mktsegment, o.o_custkey
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  WHERE o.o_orderstatus IS NOT NULL AND o.o_orderdate IS NOT NULL)"""

SPECS = {"events": EVENTS_SPEC, "lines": LINES_SPEC, "planted": PLANTED_SPEC, "orders": ORDERS_SPEC}


def dbl(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def edges_sql(probs=(0.0, 0.17, 0.83, 1.0), src: str = "frame", col: str = "t",
              name: str = "edges") -> str:
    """Nearest-rank order statistics: zero-based index round_even(p*(n-1))."""
    picks = ",\n  ".join(
        f"max(CASE WHEN rk = round_even({dbl(p)} * (n - 1), 0) THEN {col} END) AS e{i}"
        for i, p in enumerate(probs))
    return f"""
{name}_rk AS (SELECT {col}, row_number() OVER (ORDER BY {col}) - 1 AS rk,
              count(*) OVER () AS n FROM {src} WHERE {col} IS NOT NULL),
{name} AS (SELECT
  {picks}
  FROM {name}_rk)"""


def windows_sql(train=(0.0, 0.17), holdout=(0.83, 1.0)) -> str:
    tr_close = "<=" if train[1] == 1.0 else "<"
    ho_close = "<=" if holdout[1] == 1.0 else "<"
    return edges_sql((train[0], train[1], holdout[0], holdout[1])) + f""",
fw AS (
  SELECT f.*, CASE WHEN f.t >= e0 AND f.t {tr_close} e1 THEN 'early' ELSE 'late' END AS "window"
  FROM frame f, edges
  WHERE (f.t >= e0 AND f.t {tr_close} e1) OR (f.t >= e2 AND f.t {ho_close} e3))"""


def values_sql(spec: FrameSpec, src: str = "fw", by=('"window"',), features=None,
               name: str = "vals", label: str | None = None) -> str:
    features = list(features or spec.features)
    label = label or spec.label
    bys = ", ".join(by)
    bys_c = (bys + ", ") if by else ""
    parts = []
    for f in features:
        if spec.kind_of(f) == "numeric":
            parts.append(f"SELECT '{f}' AS feature, {bys_c}{label}::INTEGER AS y, "
                         f"{f}::DOUBLE AS vnum, NULL::VARCHAR AS vtxt FROM {src}")
        else:
            parts.append(f"SELECT '{f}' AS feature, {bys_c}{label}::INTEGER AS y, "
                         f"NULL::DOUBLE AS vnum, {f}::VARCHAR AS vtxt FROM {src}")
    union = "\n    UNION ALL ".join(parts)
    return f"""
{name}_long AS (
    {union}),
{name} AS (SELECT feature, {bys_c}y, vnum, vtxt, count(*) AS n
          FROM {name}_long GROUP BY ALL)"""


def kinds_sql(spec: FrameSpec, features=None) -> str:
    features = list(features or spec.features)
    rows = ", ".join(f"('{f}', '{spec.kind_of(f)}')" for f in features)
    return f"\nkinds AS (SELECT * FROM (VALUES {rows}) k(feature, declared))"


def binning_sql(spec: FrameSpec, bins: int = 10, max_levels: int = 20, src: str = "vals",
                ref: str | None = "early", features=None) -> str:
    where = f"WHERE \"window\" = '{ref}'" if ref else ""
    by = 1.0 / bins
    return kinds_sql(spec, features) + f""",
vc AS (SELECT v.feature, vnum, vtxt, sum(n) AS c FROM {src} v JOIN kinds USING (feature)
       {where} GROUP BY ALL),
bstats AS (
  SELECT k.feature, k.declared, coalesce(s.total, 0) AS total, coalesce(s.nonnull, 0) AS nonnull,
         coalesce(s.distinct_n, 0) AS distinct_n
  FROM kinds k LEFT JOIN (
    SELECT feature, sum(c) AS total,
           sum(CASE WHEN vnum IS NOT NULL OR vtxt IS NOT NULL THEN c ELSE 0 END) AS nonnull,
           count(CASE WHEN vnum IS NOT NULL OR vtxt IS NOT NULL THEN 1 END) AS distinct_n
    FROM vc GROUP BY feature) s USING (feature)),
vcum AS (
  SELECT feature, vnum, c,
         coalesce(sum(c) OVER (PARTITION BY feature ORDER BY vnum
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
  FROM vc WHERE vnum IS NOT NULL),
probs AS (SELECT j, CASE WHEN j = 0 THEN 0.0::DOUBLE WHEN j = {bins} THEN 1.0::DOUBLE
                         ELSE j::DOUBLE * {dbl(by)} END AS p FROM range(0, {bins + 1}) r(j)),
qidx AS (
  SELECT s.feature, j, 1.0::DOUBLE + (s.nonnull - 1)::DOUBLE * p AS idx
  FROM bstats s, probs WHERE s.declared = 'numeric' AND s.distinct_n > {bins}),
qidx2 AS (SELECT feature, j, idx, floor(idx)::BIGINT AS lo, ceil(idx)::BIGINT AS hi,
                 idx - floor(idx) AS h FROM qidx),
qv AS (
  SELECT i.feature, i.j,
         CASE WHEN i.idx > i.lo AND xh.vnum <> xl.vnum
              THEN (1.0::DOUBLE - i.h) * xl.vnum + i.h * xh.vnum ELSE xl.vnum END AS q
  FROM qidx2 i
  JOIN vcum xl ON xl.feature = i.feature AND xl.below <= i.lo - 1 AND i.lo - 1 < xl.below + xl.c
  JOIN vcum xh ON xh.feature = i.feature AND xh.below <= i.hi - 1 AND i.hi - 1 < xh.below + xh.c),
qgrid AS (SELECT feature, array_agg(DISTINCT q ORDER BY q) AS grid FROM qv GROUP BY feature),
fewv AS (SELECT v.feature, array_agg(v.vnum ORDER BY v.vnum) AS all_vals
         FROM vc v JOIN bstats s USING (feature)
         WHERE s.declared = 'numeric' AND s.distinct_n <= {bins} AND s.distinct_n >= 2
               AND v.vnum IS NOT NULL GROUP BY v.feature),
topn AS (
  SELECT feature, array_agg(vnum ORDER BY vnum) AS top_vals FROM (
    SELECT v.feature, v.vnum, row_number() OVER (PARTITION BY v.feature ORDER BY v.c DESC, v.vnum ASC) AS rn
    FROM vc v JOIN bstats s USING (feature)
    WHERE s.declared = 'numeric' AND s.distinct_n > {bins} AND v.vnum IS NOT NULL) x
  WHERE rn <= {max_levels} GROUP BY feature),
topt AS (
  SELECT feature, array_agg(vtxt ORDER BY rn) AS top_levels FROM (
    SELECT v.feature, v.vtxt, row_number() OVER (PARTITION BY v.feature ORDER BY v.c DESC, v.vtxt ASC) AS rn
    FROM vc v JOIN bstats s USING (feature)
    WHERE s.declared = 'text' AND v.vtxt IS NOT NULL) x
  WHERE rn <= {max_levels} GROUP BY feature),
b0 AS (
  SELECT s.*, g.grid, f.all_vals, tn.top_vals, tt.top_levels,
         CASE WHEN s.nonnull = 0 THEN 'no non-null values'
              WHEN s.declared = 'numeric' AND s.distinct_n < 2 THEN 'constant' END AS degenerate,
         CASE WHEN s.declared <> 'numeric' THEN 'categorical'
              WHEN s.distinct_n <= {bins} THEN 'discrete'
              WHEN len(g.grid) >= 3 THEN 'numeric' ELSE 'discrete' END AS kind
  FROM bstats s LEFT JOIN qgrid g USING (feature) LEFT JOIN fewv f USING (feature)
  LEFT JOIN topn tn USING (feature) LEFT JOIN topt tt USING (feature)),
binning AS (
  SELECT feature, kind, degenerate,
         CASE WHEN total > 0 THEN (total - nonnull)::DOUBLE / total END AS null_share,
         CASE WHEN kind = 'numeric' AND degenerate IS NULL
              THEN list_concat(['-inf'::DOUBLE], grid[2:len(grid) - 1], ['inf'::DOUBLE]) END AS edges,
         CASE WHEN degenerate IS NOT NULL THEN NULL
              WHEN declared = 'numeric' AND distinct_n <= {bins} THEN all_vals
              WHEN kind = 'discrete' THEN top_vals END AS vals,
         CASE WHEN kind = 'categorical' AND degenerate IS NULL THEN top_levels END AS levels
  FROM b0),
binning2 AS (
  SELECT *, CASE WHEN degenerate IS NOT NULL THEN NULL
                 WHEN kind = 'numeric' THEN len(edges) - 1
                 WHEN kind = 'discrete' THEN len(vals) + 1
                 ELSE len(levels) + 1 END::INTEGER AS n_core
  FROM binning)"""


def bin_expr() -> str:
    return """CASE WHEN v.vnum IS NULL AND v.vtxt IS NULL THEN b.n_core
     WHEN b.kind = 'numeric' THEN least(len(list_filter(b.edges, lambda e: e <= v.vnum)) - 1, b.n_core - 1)
     WHEN b.kind = 'discrete' THEN CASE WHEN coalesce(list_position(b.vals, v.vnum), 0) > 0
                                        THEN list_position(b.vals, v.vnum) - 1 ELSE b.n_core - 1 END
     ELSE CASE WHEN coalesce(list_position(b.levels, v.vtxt), 0) > 0
               THEN list_position(b.levels, v.vtxt) - 1 ELSE b.n_core - 1 END END"""


def cells_sql(src: str = "vals", by=('"window"',), name: str = "cells") -> str:
    bys = ", ".join(f"v.{b}" for b in by)
    bys_c = (bys + ", ") if by else ""
    return f""",
{name} AS (
  SELECT v.feature, {bys_c}({bin_expr()})::INTEGER AS bin_idx,
         sum(v.n) AS n, sum(CASE WHEN v.y = 1 THEN v.n ELSE 0 END) AS pos,
         sum(CASE WHEN v.y = 0 THEN v.n ELSE 0 END) AS neg
  FROM {src} v JOIN binning2 b USING (feature)
  WHERE b.degenerate IS NULL
  GROUP BY ALL)"""


def woe_sql(cells: str = "cells", by_values=("early", "late"), by: str = '"window"',
            name: str = "woe") -> str:
    if by_values is None:
        grid_by = f"JOIN (SELECT DISTINCT feature, {by} FROM {cells}) w USING (feature)"
    else:
        vals = ", ".join(f"('{v}')" for v in by_values)
        grid_by = f", (VALUES {vals}) w({by})"
    return f""",
{name}_grid AS (
  SELECT b.feature, w.{by}, r.bin_idx::INTEGER AS bin_idx
  FROM binning2 b {grid_by}, LATERAL (SELECT unnest(range(0, b.n_core + 1)) AS bin_idx) r
  WHERE b.degenerate IS NULL),
{name}_full AS (
  SELECT g.feature, g.{by}, g.bin_idx, coalesce(c.n, 0) AS n, coalesce(c.pos, 0) AS pos,
         coalesce(c.neg, 0) AS neg
  FROM {name}_grid g LEFT JOIN {cells} c
    ON c.feature = g.feature AND c.{by} = g.{by} AND c.bin_idx = g.bin_idx),
{name}_adj AS (
  SELECT *, pos + CASE WHEN pos = 0 OR neg = 0 THEN 0.5 ELSE 0.0 END AS pos_adj,
            neg + CASE WHEN pos = 0 OR neg = 0 THEN 0.5 ELSE 0.0 END AS neg_adj
  FROM {name}_full),
{name}_p AS (
  SELECT *, pos_adj / sum(pos_adj) OVER w AS p_pos, neg_adj / sum(neg_adj) OVER w AS p_neg,
         CASE WHEN sum(n) OVER w > 0 THEN n / sum(n) OVER w END AS share
  FROM {name}_adj WINDOW w AS (PARTITION BY feature, {by})),
{name} AS (
  SELECT feature, {by}, bin_idx, n, pos, neg, share, p_pos, p_neg, ln(p_pos / p_neg) AS woe,
         (p_pos - p_neg) * ln(p_pos / p_neg) AS iv_part
  FROM {name}_p)"""


def pipeline(frame: str = "events", bins: int = 10, max_levels: int = 20,
             woe: bool = True) -> str:
    """frame -> windows -> VALUES -> binning -> CELLS [-> WoE], as WITH-clause text."""
    spec = SPECS[frame]
    s = "WITH " + FRAME_SQL[frame].lstrip() + "," + windows_sql() + "," + values_sql(spec)
    s += "," + binning_sql(spec, bins, max_levels) + cells_sql()
    if woe:
        s += woe_sql()
    return s


def auc_sql(groups: str, keys, name: str = "auc", z: float = 1.959963984540054) -> str:
    """DeLong AUC from a (keys, score, pos, neg) CTE; mirrors ``rank.auc_delong``."""
    k = ", ".join(keys)
    kv = ", ".join(f"v.{x}" for x in keys)
    return f""",
{name}_pl AS (
  SELECT {k}, score, pos, neg,
         coalesce(sum(neg) OVER wb, 0) AS neg_below, coalesce(sum(pos) OVER wb, 0) AS pos_below,
         sum(pos) OVER wa AS pt, sum(neg) OVER wa AS nt, count(*) OVER wa AS n_scores
  FROM {groups} WHERE pos + neg > 0
  WINDOW wb AS (PARTITION BY {k} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         wa AS (PARTITION BY {k})),
{name}_v AS (
  SELECT *, (neg_below::DOUBLE + neg::DOUBLE / 2.0::DOUBLE) / nt::DOUBLE AS v10,
            ((pt - pos_below - pos)::DOUBLE + pos::DOUBLE / 2.0::DOUBLE) / pt::DOUBLE AS v01
  FROM {name}_pl),
{name}_a AS (SELECT {k}, sum(pos * v10) / max(pt)::DOUBLE AS auc, max(pt) AS pt, max(nt) AS nt,
                    max(n_scores) AS n_scores FROM {name}_v GROUP BY {k}),
{name}_s AS (SELECT {kv}, sum(v.pos * (v.v10 - a.auc) * (v.v10 - a.auc)) AS sx,
                    sum(v.neg * (v.v01 - a.auc) * (v.v01 - a.auc)) AS sy
             FROM {name}_v v JOIN {name}_a a USING ({k}) GROUP BY {kv}),
{name}_0 AS (
  SELECT {k}, CASE WHEN pt > 0 AND nt > 0 AND n_scores >= 2 THEN auc END AS auc,
         CASE WHEN pt > 1 AND nt > 1 AND n_scores >= 2
              THEN sx / ((pt::DOUBLE - 1) * pt::DOUBLE) + sy / ((nt::DOUBLE - 1) * nt::DOUBLE) END AS var,
         pt + nt AS n, pt AS pos_total, nt AS neg_total
  FROM {name}_a JOIN {name}_s USING ({k})),
{name} AS (
  SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, auc - {z!r}::DOUBLE * sqrt(var))) AS lower,
            greatest(0.0::DOUBLE, least(1.0::DOUBLE, auc + {z!r}::DOUBLE * sqrt(var))) AS upper
  FROM {name}_0)"""


def r4(x: str) -> str:
    return f"(round_even(({x}) * 1e4::DOUBLE, 0) / 1e4::DOUBLE)"


#: Intervals of the Simpson sums behind the tail probabilities.
STEPS = 2000


def _simpson(lo: str, hi: str, f) -> str:
    at = f"({lo} + ({hi} - {lo}) * i / {STEPS}.0::DOUBLE)"
    weight = f"(CASE WHEN i = 0 OR i = {STEPS} THEN 1.0::DOUBLE WHEN i % 2 = 1 THEN 4.0::DOUBLE ELSE 2.0::DOUBLE END)"
    return f"(({hi} - {lo}) / {3 * STEPS}.0::DOUBLE * list_sum(list_transform(range({STEPS + 1}), lambda i: {weight} * {f(at)})))"


def t_p(t: str, df: str) -> str:
    """Two-sided p of Student's t: the density is cos(u)**(df - 1) in u = atan(t / sqrt(df))."""
    f = lambda u: f"pow(cos({u}), {df} - 1.0::DOUBLE)"
    angle, reach = f"atan(abs({t}) / sqrt({df}))", f"14.0::DOUBLE / sqrt({df})"
    tail = _simpson(angle, f"least(pi() / 2, {angle} + {reach})", f)
    return f"({tail} / {_simpson('0.0::DOUBLE', f'least(pi() / 2, {reach})', f)})"


def chi2_p(x: str, df: str) -> str:
    """Upper tail of chi-squared: the density of its root w is w**(df - 1) exp(-w**2 / 2)."""
    f = lambda w: f"(pow({w}, {df} - 1.0::DOUBLE) * exp(-{w} * {w} / 2.0::DOUBLE))"
    tail = _simpson(f"sqrt({x})", f"(greatest(sqrt({x}), sqrt({df})) + 14.0::DOUBLE)", f)
    return f"({tail} / {_simpson('0.0::DOUBLE', f'(sqrt({df}) + 14.0::DOUBLE)', f)})"


def bh_sql(src: str, name: str, p: str, out: str) -> str:
    """CTE ``name``: ``src`` with the Benjamini-Hochberg adjustment of ``p``."""
    return f""",
{name}_r AS (SELECT *, count({p}) OVER () AS bh_m, row_number() OVER (ORDER BY {p} NULLS LAST) AS bh_r FROM {src}),
{name} AS (SELECT * EXCLUDE (bh_m, bh_r), CASE WHEN {p} IS NOT NULL THEN least(1.0::DOUBLE, min({p} * bh_m / bh_r) OVER (
             ORDER BY bh_r DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) END AS {out} FROM {name}_r)"""
