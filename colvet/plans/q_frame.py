"""Registered queries: sources and sinks (2.1), projections (2.2), hash
sample (2.3), identity join (2.4), frequency maps (2.17)."""

from __future__ import annotations

import json
import math
import os

from pyspark.sql import functions as F

from ..functions.columns import day_of, hour_angle, hour_of, null_count
from ..operators import derive as DV
from ..operators import entity as E
from ..operators.categorical import kept_levels
from ..operators.shift import hashed_sample
from ..sources import readers as RD
from ..sources.frames import lines_frame, load_frame, read_table
from . import oracle_sql as O
from .pipeline import prepare
from .registry import register

EV = "WITH " + O.FRAME_SQL["events"].lstrip()
LN = "WITH " + O.FRAME_SQL["lines"].lstrip()

# --- fixed values: declared one-hot levels --------------------------------
SEGMENT_LEVELS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
PRIORITY_LEVELS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
LINESTATUS_LEVELS = ("O", "F")
# ---------------------------------------------------------------------------
FREQ_COLUMNS = ("p_type", "o_custkey", "l_partkey")

LINE_SPECS = (
    [DV.Derivation("order_day", "days_since_to_start_day", ("days_since_order",))]
    + [DV.Derivation(f"priority_is_{lv[0]}", "one_hot", ("o_orderpriority",), {"level": lv})
       for lv in PRIORITY_LEVELS]
    + [DV.Derivation(f"linestatus_is_{lv}", "one_hot", ("l_linestatus",), {"level": lv})
       for lv in LINESTATUS_LEVELS]
    + [DV.Derivation(f"{c}_freq", "frequency_encode", (c,)) for c in FREQ_COLUMNS]
)


def _maps_sql():
    parts = [f"SELECT '{c}' AS \"column\", {c}::VARCHAR AS level, count(*) AS n FROM train "
             f"WHERE {c} IS NOT NULL GROUP BY ALL" for c in FREQ_COLUMNS]
    return """,
bnd AS (SELECT quantile_cont(t, 0.75) AS boundary FROM frame),
train AS (SELECT f.* FROM frame f, bnd WHERE f.t <= bnd.boundary),
cnt AS (""" + "\n  UNION ALL ".join(parts) + """),
maps AS (SELECT * FROM cnt WHERE n >= 2)"""


@register("fq_fit", sql=LN + _maps_sql() + '\nSELECT "column", level, n FROM maps')
def q_fq_fit(spark, sf):
    """Level counts on the training split (time <= type-7 q75), min count 2."""
    fr, spec = load_frame(spark, sf, "lines")
    maps, _ = DV.fit_frequency_maps(fr, FREQ_COLUMNS)
    return maps


@register("fq_summary", sql=LN + _maps_sql() + """
SELECT c."column", count(*) AS levels_seen, count(CASE WHEN c.n >= 2 THEN 1 END) AS levels_kept,
       round(sum(CASE WHEN c.n >= 2 THEN c.n ELSE 0 END)::DOUBLE / (SELECT count(*) FROM train), 4) AS coverage,
       (SELECT count(*) FROM train) AS train_rows, max(b.boundary) AS boundary
FROM cnt c, bnd b GROUP BY c."column\"""", floats=("coverage", "boundary"))
def q_fq_summary(spark, sf):
    """Levels seen and kept, coverage and the fitted boundary per map."""
    fr, spec = load_frame(spark, sf, "lines")
    _, summ = DV.fit_frequency_maps(fr, FREQ_COLUMNS)
    return summ


@register("prj_start_day", sql=LN + """
SELECT l_orderkey, l_partkey, floor(t / 86400) - days_since_order AS order_day FROM frame""",
          floats=("order_day",))
def q_start_day(spark, sf):
    """Spell start day: floor(t/86400) - days since (here: the order day)."""
    fr, _ = load_frame(spark, sf, "lines")
    return fr.select("l_orderkey", "l_partkey",
                     DV.start_day(["days_since_order"], {}, "t").alias("order_day"))


@register("prj_one_hot", sql=EV + "\nSELECT row_id, " + ", ".join(
    f"CASE WHEN c_mktsegment IS NULL THEN NULL WHEN c_mktsegment = '{lv}' THEN 1 ELSE 0 END AS seg_is_{lv.lower()}"
    for lv in SEGMENT_LEVELS) + " FROM frame")
def q_one_hot(spark, sf):
    """One indicator per declared segment level; null stays null."""
    fr, _ = load_frame(spark, sf)
    return fr.select("row_id", *[DV.one_hot(["c_mktsegment"], {"level": lv}).alias(f"seg_is_{lv.lower()}")
                                 for lv in SEGMENT_LEVELS])


@register("prj_freq_encode", sql=LN + _maps_sql() + """
SELECT f.l_orderkey, f.l_partkey, f.p_type, m.n AS p_type_freq
FROM frame f LEFT JOIN (SELECT level, n FROM maps WHERE "column" = 'p_type') m ON f.p_type::VARCHAR = m.level""")
def q_freq_encode(spark, sf):
    """Replace p_type by its fitted training count (unseen -> null)."""
    fr, _ = load_frame(spark, sf, "lines")
    maps, _ = DV.fit_frequency_maps(fr, FREQ_COLUMNS)
    fr = lines_frame(spark, sf, DV.lookups(maps, ("p_type",)))
    spec = [DV.Derivation("p_type_freq", "frequency_encode", ("p_type",))]
    return DV.apply_derivations(fr, spec, maps).select("l_orderkey", "l_partkey", "p_type", "p_type_freq")


def _apply_sql():
    cols = ["f.l_orderkey", "f.l_partkey", "floor(f.t / 86400) - f.days_since_order AS order_day"]
    for lv in PRIORITY_LEVELS:
        cols.append(f"CASE WHEN f.o_orderpriority IS NULL THEN NULL WHEN f.o_orderpriority = '{lv}' THEN 1 ELSE 0 END "
                    f"AS priority_is_{lv[0]}")
    for lv in LINESTATUS_LEVELS:
        cols.append(f"CASE WHEN f.l_linestatus IS NULL THEN NULL WHEN f.l_linestatus = '{lv}' THEN 1 ELSE 0 END "
                    f"AS linestatus_is_{lv}")
    joins = []
    for i, c in enumerate(FREQ_COLUMNS):
        cols.append(f"m{i}.n AS {c}_freq")
        joins.append(f"LEFT JOIN (SELECT level, n FROM maps WHERE \"column\" = '{c}') m{i} ON f.{c}::VARCHAR = m{i}.level")
    return LN + _maps_sql() + "\nSELECT " + ", ".join(cols) + "\nFROM frame f " + "\n".join(joins)


@register("prj_apply_derivations", sql=_apply_sql(), floats=("order_day",))
def q_apply(spark, sf):
    """The declared list: start day, one-hot indicators, frequency encodings."""
    fr, _ = load_frame(spark, sf, "lines")
    encoded = DV.frequency_encoded_columns(LINE_SPECS)
    maps, _ = DV.fit_frequency_maps(fr, encoded)
    fr = lines_frame(spark, sf, DV.lookups(maps, encoded))
    out = DV.apply_derivations(fr, LINE_SPECS, maps)
    return out.select("l_orderkey", "l_partkey", *[s.name for s in LINE_SPECS])


BLOCK_COLS = ("s_acctbal", "s_nationkey", "c_acctbal", "c_nationkey", "c_mktsegment", "c_nation")


@register("prj_null_count", sql=EV + "\nSELECT row_id, " + " + ".join(
    f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in BLOCK_COLS) + " AS null_count FROM frame")
def q_null_count(spark, sf):
    """Per-row null count over the joined side-table block."""
    fr, _ = load_frame(spark, sf)
    return fr.select("row_id", null_count(BLOCK_COLS).alias("null_count"))


@register("prj_missing_flag", sql=EV + "\nSELECT row_id, (s_acctbal IS NULL)::INTEGER AS s_acctbal_missing FROM frame")
def q_missing_flag(spark, sf):
    """Presence indicator of the supplier balance per row."""
    fr, _ = load_frame(spark, sf)
    return fr.select("row_id", F.col("s_acctbal").isNull().cast("int").alias("s_acctbal_missing"))


@register("prj_entity_uid", sql=LN + """
SELECT l_orderkey, l_partkey,
       CASE WHEN o_custkey IS NULL THEN NULL
            ELSE o_custkey::VARCHAR || '|' || coalesce((floor(t / 86400) - days_since_order)::BIGINT::VARCHAR, 'NA') END AS uid
FROM frame""")
def q_entity_uid(spark, sf):
    """Customer key plus spell start day (anchor: days since the order)."""
    fr, _ = load_frame(spark, sf, "lines")
    return fr.select("l_orderkey", "l_partkey", E.entity_uid(["o_custkey"], "days_since_order", "t").alias("uid"))


@register("prj_lump_levels", sql="WITH " + O.FRAME_SQL["events"].lstrip() + "," + O.windows_sql() + """,
kept AS (SELECT c_nation FROM (
           SELECT c_nation, row_number() OVER (ORDER BY count(*) DESC, c_nation) AS rn
           FROM fw WHERE "window" = 'early' AND c_nation IS NOT NULL GROUP BY c_nation) x WHERE rn <= 10)
SELECT f."window", CASE WHEN f.c_nation IS NULL THEN '__null__' WHEN k.c_nation IS NOT NULL THEN f.c_nation
                        ELSE '__other__' END AS c_nation_lumped, count(*) AS n
FROM fw f LEFT JOIN kept k ON f.c_nation = k.c_nation GROUP BY ALL""")
def q_lump(spark, sf):
    """Top 10 early-window nations kept, others __other__, null __null__."""
    a = prepare(spark, sf)
    kept = kept_levels(a.values, ["c_nation"], 10).select("kept")
    j = DV.lump_levels(a.fw, "c_nation", kept)
    return j.groupBy("window", "c_nation_lumped").agg(F.count(F.lit(1)).alias("n"))


@register("prj_time_parts", sql=EV + f"""
SELECT row_id, floor(t / 86400)::BIGINT AS day, ((t / 3600.0) % 24.0 + 24.0) % 24.0 AS hour,
       (((t / 3600.0) % 24.0 + 24.0) % 24.0) * {2 * math.pi / 24!r}::DOUBLE AS angle FROM frame""",
          floats=("hour", "angle"))
def q_time_parts(spark, sf):
    """Day number, hour on the 24 h clock and its angle, per row."""
    fr, _ = load_frame(spark, sf)
    return fr.select("row_id", day_of("t").cast("long").alias("day"), hour_of("t").alias("hour"),
                     hour_angle("t").alias("angle"))


@register("flt_hash_sample")
def q_hash_sample(spark, sf):
    """500 rows with the smallest seeded hash of the id: order-independent sample."""
    fr, _ = load_frame(spark, sf)
    return hashed_sample(fr, "row_id", 500, seed=42).select("row_id", "t", "y")


@register("join_left_identity", sql="""
SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def q_left_identity(spark, sf):
    """Every document survives the join to the sparse label table."""
    d = read_table(spark, sf, "documents").select("doc_id", "lang")
    lb = read_table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    return d.join(lb, "doc_id", "left")


# ---------------------------------------------------------------- sources ---
CSV_FIELDS = [{"name": "row_id", "type": "INTEGER"}, {"name": "t", "type": "INTEGER"},
              {"name": "value", "type": "FLOAT"}, {"name": "s_acctbal", "type": "FLOAT"},
              {"name": "c_mktsegment", "type": "STRING"}, {"name": "is_error", "type": "BOOLEAN"}]


@register("src_pinned_csv", sql=EV + """
SELECT row_id, t, value, s_acctbal, c_mktsegment, y = 1 AS is_error FROM frame""",
          floats=("value", "s_acctbal"))
def q_pinned_csv(spark, sf):
    """Events frame written as CSV (nulls as NA, booleans as T/F) and read back
    under the pinned schema."""
    fr, _ = load_frame(spark, sf)
    path = RD.scratch_path(spark, "pinned-csv")
    (fr.select("row_id", "t", "value", "s_acctbal", "c_mktsegment",
               F.when(F.col("y") == 1, F.lit("T")).otherwise(F.lit("F")).alias("is_error"))
       .write.option("header", True).option("nullValue", "NA").csv(path))
    return RD.read_pinned_csv(spark, path, CSV_FIELDS)


@register("src_parquet_window", sql="""
WITH rk AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS r, count(*) OVER () AS n FROM events),
e AS (SELECT max(CASE WHEN r = round_even(0.0 * (n - 1), 0) THEN ts END) AS e0,
             max(CASE WHEN r = round_even(0.17 * (n - 1), 0) THEN ts END) AS e1,
             max(CASE WHEN r = round_even(0.83 * (n - 1), 0) THEN ts END) AS e2,
             max(CASE WHEN r = round_even(1.0 * (n - 1), 0) THEN ts END) AS e3 FROM rk)
SELECT user_id, value, props, event_type, epoch_us(ts) AS ts_us,
       CASE WHEN ts >= e0 AND ts < e1 THEN 'early' ELSE 'late' END AS "window"
FROM events, e WHERE (ts >= e0 AND ts < e1) OR (ts >= e2 AND ts <= e3)""", floats=("value",))
def q_parquet_window(spark, sf):
    """Only non-excluded columns and only the rows of the two windows."""
    df, win, feats = RD.load_windows(spark, f"{sf}/events.parquet", label="event_type", time="ts",
                                     excluded=("event_id",))
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    return df.select(*feats, "event_type", us.alias("ts_us"), "window")


def _blocks_values(name="events"):
    with open(os.path.join(RD.BLOCKS_DIR, f"{name}.json")) as fh:
        doc = json.load(fh)
    rows = []
    for b in doc["blocks"]:
        for gi, g in enumerate(b["groups"]):
            for c in g:
                rows.append(f"('{b['block']}', {gi}, '{c}')")
    return ", ".join(rows)


@register("src_blocks", sql=EV + f""",
blocks(block, group_idx, "column") AS (VALUES {_blocks_values()}),
ns AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS null_share FROM frame"
    for c in ("s_acctbal", "s_nationkey", "c_acctbal", "c_nationkey", "c_nation", "c_mktsegment", "value", "k"))
          + """)
SELECT b.block, b.group_idx::INTEGER AS group_idx, b."column", ns.null_share FROM blocks b JOIN ns USING ("column")""",
          floats=("null_share",))
def q_blocks(spark, sf):
    """Pinned blocks, flattened, with each member's null share on the events frame."""
    fr, spec = load_frame(spark, sf)
    blocks = RD.load_blocks(spark, "events")
    cols = [r["column"] for r in blocks.select("column").distinct().collect()]  # schema-sized list
    ns = fr.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"),
                                               F.col(c).isNull().cast("double").alias("isnull")) for c in cols])))
    ns = ns.groupBy("column").agg(F.avg("isnull").alias("null_share"))
    return blocks.select("block", F.col("group_idx").cast("int"), "column").join(ns, "column")
