"""Registered queries: redundancy (2.11) and dimensionality (2.13)."""

from __future__ import annotations

import json
import os

from pyspark.sql import functions as F

from ..operators import dimensions as DM
from ..operators import redundancy as RD
from ..operators import tc as TC
from ..sources import readers as RDR
from ..sources.frames import EVENTS_SPEC
from . import oracle_sql as O
from .pipeline import prepare
from .q_tc import FEATURE_SELECT, stats_sql
from .registry import register

NUM = list(EVENTS_SPEC.numeric)

def rank_sql(frame: str) -> str:
    """Mid-ranks of a frame's usable numeric columns in the early window (CTE ``rk``)."""
    return "WITH " + O.FRAME_SQL[frame].lstrip() + "," + O.windows_sql() + """,
ev AS (SELECT * FROM fw WHERE "window" = 'early'),
lng AS (""" + " UNION ALL ".join(f"SELECT row_id, '{f}' AS feature, {f}::DOUBLE AS v FROM ev" for f in O.SPECS[frame].numeric) + """),
st AS (SELECT feature, count(v) AS nn, count(DISTINCT v) AS d FROM lng GROUP BY feature),
use AS (SELECT feature, nn FROM st WHERE nn > 100 AND d >= 2),
rk AS (SELECT l.row_id, l.feature, l.v,
              CASE WHEN l.v IS NULL THEN (u.nn + 1) / 2.0
                   ELSE rank() OVER (PARTITION BY l.feature ORDER BY l.v) + (count(*) OVER (PARTITION BY l.feature, l.v) - 1) / 2.0 END AS r
       FROM lng l JOIN use u USING (feature))"""


def spearman_sql(frame: str) -> str:
    return rank_sql(frame) + """,
pr AS (SELECT a.feature AS a, b.feature AS b, corr(a.r, b.r) AS c FROM rk a JOIN rk b USING (row_id)
       WHERE a.feature <> b.feature GROUP BY ALL),
rho AS (SELECT a, b, CASE WHEN c IS NULL OR isnan(c) THEN 0.0 ELSE c END AS rho FROM pr
        UNION ALL SELECT feature, feature, 1.0 FROM use)"""


RANK_SQL, SPEAR_SQL = rank_sql("events"), spearman_sql("events")


@register("rd_rank_columns", sql=RANK_SQL + """
SELECT DISTINCT feature, v AS value, r AS rank FROM rk WHERE v IS NOT NULL
UNION ALL SELECT feature, NULL AS value, (nn + 1) / 2.0 AS rank FROM use""", floats=("value", "rank"))
def q_rank_columns(spark, sf):
    """Mid-rank of every value of each usable numeric column; null -> mean rank."""
    a = prepare(spark, sf)
    return RD.rank_columns(a.values, a.spec.numeric)


@register("rd_spearman_matrix", sql=SPEAR_SQL + "\nSELECT a, b, rho FROM rho", floats=("rho",))
def q_spearman(spark, sf):
    """Spearman matrix of the usable numeric columns (long form, unit diagonal)."""
    a = prepare(spark, sf)
    return RD.spearman_long(a.fw, a.spec.id, RD.rank_columns(a.values, a.spec.numeric))


def _blocks_sql(name="events"):
    with open(os.path.join(RDR.BLOCKS_DIR, f"{name}.json")) as fh:
        doc = json.load(fh)
    return ", ".join(f"('{b['block']}', '{c}')" for b in doc["blocks"] for g in b["groups"] for c in g)


@register("rd_pinned_blocks", sql=SPEAR_SQL + f""",
bm0(block, "column") AS (VALUES {_blocks_sql()}),
bm AS (SELECT DISTINCT bm0.block, bm0."column" FROM bm0 JOIN use ON use.feature = bm0."column"),
j AS (SELECT r.a, r.b, r.rho * r.rho AS r2, ma.block, mb.block AS block_b
      FROM rho r JOIN bm ma ON ma."column" = r.a LEFT JOIN bm mb ON mb."column" = r.b WHERE r.a <> r.b),
inside AS (SELECT block, avg(r2) AS w FROM j WHERE block_b = block AND a < b GROUP BY block),
outside AS (SELECT block, avg(r2) AS o FROM j WHERE block_b IS NULL OR block_b <> block GROUP BY block),
sz AS (SELECT block, count(*) AS n_members FROM bm GROUP BY block HAVING count(*) >= 2)
SELECT sz.block, sz.n_members::BIGINT AS n_members, inside.w AS mean_rho2_within, outside.o AS mean_rho2_between,
       inside.w / outside.o AS ratio, inside.w > outside.o AS holds
FROM sz LEFT JOIN inside USING (block) LEFT JOIN outside USING (block)""",
          floats=("mean_rho2_within", "mean_rho2_between", "ratio"))
def q_pinned_blocks(spark, sf):
    """Mean shared variance inside each pinned block against outside it."""
    a = prepare(spark, sf)
    rho = RD.spearman_long(a.fw, a.spec.id, RD.rank_columns(a.values, a.spec.numeric))
    return RD.pinned_blocks(rho, RDR.load_blocks(spark, "events"))


def _clusters(spark, sf, height):
    a = prepare(spark, sf)
    rho = RD.spearman_long(a.fw, a.spec.id, RD.rank_columns(a.values, a.spec.numeric))
    members, merges = RD.variable_clusters(rho, height)
    return a, rho, members, merges


@register("rd_variable_clusters")
def q_clusters(spark, sf):
    """Average-linkage groups at 1 - rho^2 <= 0.2."""
    a, rho, members, _ = _clusters(spark, sf, 0.2)
    return RD.numbered_groups(members, list(a.spec.numeric))


@register("rd_threshold_grid")
def q_grid(spark, sf):
    """Groups, singletons, largest group for min_rho2 = 0.50 ... 0.95."""
    a, rho, members, merges = _clusters(spark, sf, 0.5)
    feats = [r["feature"] for r in members.select("feature").collect()]  # column names
    rows = RD.threshold_grid(feats, merges)
    return spark.createDataFrame(rows, "min_rho2 double, groups long, singletons long, largest long")


def representatives_sql(frame: str) -> str:
    spec = O.SPECS[frame]
    return f"""
WITH rho AS ({spearman_sql(frame)} SELECT a, b, rho FROM rho),
ft AS ({O.pipeline(frame) + stats_sql(spec.numeric) + FEATURE_SELECT}),
nr AS ({O.pipeline(frame, woe=False)}
       SELECT feature, sum(CASE WHEN vnum IS NULL THEN n ELSE 0 END)::DOUBLE / sum(n) AS null_rate FROM vals WHERE "window" = 'early' GROUP BY feature),
ord(feature, position) AS (VALUES {", ".join(f"('{f}', {i})" for i, f in enumerate(spec.numeric))}),
-- columns this close are all close to each other here, so linking pairs gives the clusters
root AS (SELECT r.a AS feature, min(o.position) AS p0 FROM rho r JOIN ord o ON o.feature = r.b
         WHERE r.a = r.b OR r.rho * r.rho >= 0.8::DOUBLE GROUP BY r.a),
grp AS (SELECT feature, dense_rank() OVER (ORDER BY p0)::VARCHAR AS "group", count(*) OVER (PARTITION BY p0) AS size FROM root),
m AS (SELECT g.*, nr.null_rate, ft.iv_train AS iv FROM grp g LEFT JOIN nr USING (feature) LEFT JOIN ft USING (feature)),
reps AS (
  SELECT "group", size::BIGINT AS size, feature AS "column", first_value(feature) OVER w AS representative,
         feature = first_value(feature) OVER w AS is_representative, null_rate, iv
  FROM m WINDOW w AS (PARTITION BY "group" ORDER BY null_rate, iv DESC NULLS FIRST, feature))"""


@register("rd_representatives", sql=representatives_sql("events") + "\nSELECT * FROM reps", floats=("null_rate", "iv"))
def q_reps(spark, sf):
    """Group representative: least null, then highest IV, then name."""
    a, rho, members, _ = _clusters(spark, sf, 0.2)
    groups = RD.numbered_groups(members, list(a.spec.numeric))
    nulls = (a.values.where(F.col("window") == "early").groupBy("feature")
              .agg((F.sum(F.when(F.col("vnum").isNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("null_rate")))
    iv = TC.feature_report(a, with_p=False).select("feature", F.col("iv_train").alias("iv"))
    return RD.representatives(groups, nulls, iv)


@register("rd_redundancy_r2")
def q_redun(spark, sf):
    """Backward spline redundancy inside each pinned block of the lines frame."""
    a = prepare(spark, sf, frame="lines")
    blocks = RDR.load_blocks(spark, "lines").select(F.col("block").alias("group"), F.col("column").alias("feature"))
    return RD.redundancy_within_groups(a.fw, blocks, r2=0.9)


@register("rd_scan")
def q_rd_scan(spark, sf):
    """Groups, representatives and redundancy verdicts."""
    a = prepare(spark, sf)
    iv = TC.feature_report(a, with_p=False).select("feature", F.col("iv_train").alias("iv"))
    rep, _, _ = RD.scan(a, iv)
    return rep


# ------------------------------------------------------------ dimensions ---
LINE_BLOCKS_SQL = _blocks_sql("lines")
LN_EARLY = "WITH " + O.FRAME_SQL["lines"].lstrip() + "," + O.windows_sql() + """,
ev AS (SELECT * FROM fw WHERE "window" = 'early')"""


def _block_corr_sql():
    with open(os.path.join(RDR.BLOCKS_DIR, "lines.json")) as fh:
        doc = json.load(fh)
    parts = []
    for b in doc["blocks"]:
        cols = [c for g in b["groups"] for c in g]
        med = ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in cols)
        imp = ", ".join(f"coalesce({c}::DOUBLE, m_{c}) AS {c}" for c in cols)
        keep = [c for c in cols]
        sel = []
        for i, x in enumerate(keep):
            for y in keep[i:]:
                r = "1.0" if x == y else f"corr({x}, {y})"
                sel.append(f"SELECT '{b['block']}' AS block, '{x}' AS a, '{y}' AS b, {r} AS r, count(*) AS n "
                           f"FROM imp_{b['block']} HAVING var_samp({x}) > 0 AND var_samp({y}) > 0")
                if x != y:
                    sel.append(f"SELECT '{b['block']}' AS block, '{y}' AS a, '{x}' AS b, {r} AS r, count(*) AS n "
                               f"FROM imp_{b['block']} HAVING var_samp({x}) > 0 AND var_samp({y}) > 0")
        parts.append((b["block"], f"imp_{b['block']} AS (SELECT {imp} FROM ev, (SELECT {med} FROM ev) md)", sel))
    ctes = ",\n".join(p[1] for p in parts)
    body = "\nUNION ALL ".join(s for p in parts for s in p[2])
    return LN_EARLY + ",\n" + ctes + "\n" + body


@register("dm_block_corr", sql=_block_corr_sql(), floats=("r",))
def q_block_corr(spark, sf):
    """Median-imputed Pearson correlation inside each lines block (early window)."""
    a = prepare(spark, sf, frame="lines")
    return DM.all_block_corr(a.fw.where(F.col("window") == "early"), RDR.load_blocks(spark, "lines"))


@register("dm_parallel_analysis")
def q_pa(spark, sf):
    """Components per block that beat the parallel-analysis noise quantile."""
    a = prepare(spark, sf, frame="lines")
    return DM.scan(a.fw.where(F.col("window") == "early"), RDR.load_blocks(spark, "lines"), n_iter=30) \
             .select("block", "columns", "components")


@register("dm_variance_first")
def q_var_first(spark, sf):
    """Share of variance of the first component per block."""
    a = prepare(spark, sf, frame="lines")
    return DM.scan(a.fw.where(F.col("window") == "early"), RDR.load_blocks(spark, "lines"), n_iter=30) \
             .select("block", "variance_first_component")


BINARY_COLS = ("linestatus_is_O", "orderstatus_is_F", "priority_is_1", "size_over_25")


@register("dm_tetrachoric")
def q_tetra(spark, sf):
    """Latent correlation of binary indicators (mean |off-diagonal| per pair list)."""
    a = prepare(spark, sf, frame="lines")
    rows = a.fw.where(F.col("window") == "early").select(
        (F.col("l_linestatus") == "O").cast("int").alias("linestatus_is_O"),
        (F.col("o_orderstatus") == "F").cast("int").alias("orderstatus_is_F"),
        (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("priority_is_1"),
        (F.col("p_size") > 25).cast("int").alias("size_over_25"))
    return DM.tetrachoric_pairs(rows, BINARY_COLS)


@register("dm_tetrachoric_summary")
def q_tetra_summary(spark, sf):
    """Mean absolute latent correlation among the columns that turn out to be binary."""
    a = prepare(spark, sf, frame="lines")
    rows = a.fw.where(F.col("window") == "early").withColumn("urgent", F.col("o_orderpriority") == "1-URGENT").withColumn(
        "large", (F.col("p_size") > 25).cast("int"))
    return DM.tetrachoric_summary(rows, ["l_linestatus", "o_orderpriority", "l_tax", "urgent", "large", "y"])


@register("dm_scan")
def q_dm_scan(spark, sf):
    """Columns, components, compression and first-component share per block."""
    a = prepare(spark, sf, frame="lines")
    return DM.scan(a.fw.where(F.col("window") == "early"), RDR.load_blocks(spark, "lines"), n_iter=30)
