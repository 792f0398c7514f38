"""Registered queries: the audit frame on disk and its declaration (2.1), and the audits of a
table whose parts are read off its schema, true / false columns included."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import categorical as C
from ..operators import contract as CT
from ..operators import derive as DV
from ..operators import tc as TC
from ..operators.windows import time_windows, with_window
from ..sources import audit_store as ST
from ..sources import readers as RD
from ..sources.frames import audit_frame, lines_frame, load_frame
from . import oracle_sql as O
from .pipeline import prepare
from .q_catms import contingency_sql
from .q_contract import _declared_cte
from .q_frame import BLOCK_COLS, EV, FREQ_COLUMNS, LINE_SPECS, _apply_sql
from .q_tc import TC_FLOATS, scan_sql
from .registry import register

LINE_BLOCKS = tuple(c for b in RD.block_file("lines") for g in b["groups"] for c in g)
#: Where each column of the lines frame comes from at scoring time; the others are derived.
LINE_SOURCES = {"l_quantity": "request", "l_extendedprice": "request", "l_discount": "request", "l_tax": "request",
                "l_linenumber": "request", "l_linestatus": "request", "o_totalprice": "retrieved", "o_orderstatus": "retrieved",
                "o_orderpriority": "retrieved", "p_size": "retrieved", "p_retailprice": "retrieved", "p_brand": "retrieved",
                "p_type": "retrieved", "c_acctbal": "retrieved", "c_nationkey": "retrieved", "c_mktsegment": "retrieved"}
KEYS = ("l_orderkey", "l_partkey", "o_custkey")


def built_lines(spark, sf) -> ST.Built:
    """The lines frame with its block null count and every declared column."""
    def frame(lookups=None):
        return lines_frame(spark, sf, lookups).drop("l_shipdate")

    return ST.build(frame(), LINE_SPECS, LINE_BLOCKS, again=frame)


_BASE = ("t", "y", "l_orderkey", "l_partkey", "o_custkey", "days_since_order", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
         "l_linenumber", "o_totalprice", "p_size", "p_retailprice", "c_acctbal", "c_nationkey", "l_linestatus", "o_orderstatus",
         "o_orderpriority", "p_brand", "p_type", "c_mktsegment")
_COUNT = " + ".join(f"CASE WHEN f.{c} IS NULL THEN 1 ELSE 0 END" for c in LINE_BLOCKS)
#: CTE ``built``: the whole frame that ``built_lines`` writes, but for its row id.
BUILT_SQL = _apply_sql().replace(
    "\nSELECT f.l_orderkey, f.l_partkey,",
    ",\nbuilt AS (SELECT " + ", ".join(f"f.{c}" for c in _BASE) + f", {_COUNT} AS null_count,") + ")"
_NAMES = (*_BASE, "null_count", *[s.name for s in LINE_SPECS])


@register("sink_frame", sql=BUILT_SQL + "\nSELECT " + ", ".join(_NAMES) + " FROM built",
          floats=("days_since_order", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "o_totalprice", "p_retailprice",
                  "c_acctbal", "order_day"))
def q_sink_frame(spark, sf):
    """The lines frame with its block null count and all derived columns, maps fitted on the
    frame itself, written in time order with maps and manifest; read back."""
    path = ST.write(built_lines(spark, sf), RD.scratch_path(spark, "audit-frame"))
    return spark.read.parquet(f"{path}/data").select(*_NAMES)


@register("sink_manifest", sql=BUILT_SQL + "\n" + "\nUNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*)::BIGINT AS rows, count(*) FILTER (WHERE {c} IS NULL)::BIGINT AS nulls FROM built" for c in _NAMES))
def q_sink_manifest(spark, sf):
    """Rows and nulls of every column as the manifest of the written frame tells them."""
    path = ST.write(built_lines(spark, sf), RD.scratch_path(spark, "audit-manifest"))
    return ST.column_nulls(spark, path).where(F.col("column") != "row_id")


@register("src_manifest_window", sql=EV + "," + O.windows_sql() + "\nSELECT row_id, t, y, value, s_acctbal, c_mktsegment, " + " + ".join(
    f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in BLOCK_COLS) + " AS null_count, \"window\" FROM fw", floats=("value", "s_acctbal"))
def q_manifest_window(spark, sf):
    """Both windows of the written events frame, from the files that reach into them."""
    fr, _ = load_frame(spark, sf)
    path = ST.write(ST.build(fr, (), BLOCK_COLS), RD.scratch_path(spark, "audit-windows"))
    rows, _, _ = ST.read_window(spark, path, columns=("row_id", "t", "y", "value", "s_acctbal", "c_mktsegment", "null_count"))
    return rows


_DECLARED = [c for c in _NAMES if c not in (*KEYS, "t", "y")]
_TEXTS = ("l_linestatus", "o_orderstatus", "o_orderpriority", "p_brand", "p_type", "c_mktsegment")


def _declaration_sql() -> str:
    whole = " UNION ALL ".join(
        f"SELECT '{c}' AS name, 'str' AS dtype" if c in _TEXTS else
        f"SELECT '{c}', CASE WHEN coalesce(bool_and({c} = floor({c})), TRUE) THEN 'int' ELSE 'float' END FROM early" for c in _DECLARED)
    src = ", ".join(f"('{c}', '{LINE_SOURCES.get(c, 'derived')}')" for c in _DECLARED)
    specs = ", ".join(f"('{s.name}', '{s.tool}', '{','.join(s.inputs)}')" for s in LINE_SPECS)
    return BUILT_SQL + "," + O.edges_sql((0.0, 0.17), "built") + f""",
early AS (SELECT built.* FROM built, edges WHERE t >= e0 AND t < e1),
dt(name, dtype) AS ({whole}),
src(name, source) AS (VALUES {src}),
specs(name, tool, inputs) AS (VALUES {specs}),
dig AS (SELECT "column", count(*)::BIGINT AS levels, sum(n)::BIGINT AS rows,
               sum(('0x' || substr(md5(level || chr(9) || n::VARCHAR), 1, 15))::BIGINT)::VARCHAR AS digest FROM maps GROUP BY ALL)
SELECT '1' AS version, dt.name, source, dtype, tool, inputs, levels AS map_levels, rows AS map_rows, digest AS map_digest
FROM dt JOIN src USING (name) LEFT JOIN specs USING (name)
LEFT JOIN dig ON tool = 'frequency_encode' AND dig."column" = inputs"""


@register("sink_declaration", sql=_declaration_sql())
def q_sink_declaration(spark, sf):
    """Declaration of the built lines frame as JSON, read back: every column's source and
    dtype, a derived one's tool and inputs, a fitted one's levels, rows and digest."""
    built = built_lines(spark, sf)
    frame, spec = audit_frame(built.frame, "y", "t", exclude=KEYS, id="row_id", name="lines-built")
    rows = with_window(frame, spec.time, time_windows(frame, spec.time), spec.raw_time)
    fitted = {r["column"]: {"levels": r["levels"], "rows": r["rows"], "digest": r["digest"]}
              for r in ST.map_digests(built.maps).collect()}  # one row per fitted column
    path = RD.write_declaration(CT.declare_rows(rows, spec, LINE_SOURCES), RD.scratch_path(spark, "declaration"),
                                DV.declarations(built.specs), {"path": sf, "frame": spec.name}, fitted)
    d = spark.read.json(path)
    tools = F.from_json("derivations", "array<struct<name string, tool string, inputs array<string>>>")
    learned = F.from_json("fitted_parameters", "map<string, struct<levels bigint, rows bigint, digest string>>")
    each = d.select("version", tools.alias("tools"), learned.alias("learned"), F.explode("columns").alias("c"))
    own = F.get(F.filter("tools", lambda x: x["name"] == F.col("c.name")), 0)
    each = each.select("version", "c.name", "c.source", "c.dtype", own["tool"].alias("tool"),
                       F.array_join(own["inputs"], ",").alias("inputs"), "learned")
    m = F.when(F.col("tool") == "frequency_encode", F.try_element_at("learned", F.col("inputs")))
    return each.select("version", "name", "source", "dtype", "tool", "inputs", m["levels"].alias("map_levels"),
                       m["rows"].alias("map_rows"), m["digest"].alias("map_digest"))


# ------------------------------------------------------ a table of one's own ---
@register("tbl_declare", sql="WITH " + O.FRAME_SQL["orders"].lstrip() + "," + O.windows_sql()
          + _declared_cte("orders").replace("dsrc(name, source) AS (VALUES", "dsrc(name, source) AS (VALUES ('o_totalprice', 'request'),")
          + "\nSELECT * FROM decl")
def q_tbl_declare(spark, sf):
    """Source and dtype (bool, int, float, str) of the orders table's features."""
    a = prepare(spark, sf, frame="orders")
    sources = {"o_totalprice": "request", "c_nationkey": "retrieved", "c_acctbal": "retrieved", "c_mktsegment": "retrieved"}
    return CT.declare(a.values, a.spec, sources)


@register("tbl_tc_scan", sql=scan_sql("orders") + "\nSELECT * FROM tc", floats=(*TC_FLOATS, "p_delong", "p_delong_bh"))
def q_tbl_tc_scan(spark, sf):
    """Time-consistency scan of the orders table, true / false columns ranked as 1 / 0."""
    return TC.scan(prepare(spark, sf, frame="orders"))


@register("tbl_contingency", sql=contingency_sql("orders") + "\nSELECT feature, target, a, b, n FROM cont")
def q_tbl_contingency(spark, sf):
    """Level tables of the orders table's text and true / false columns."""
    a = prepare(spark, sf, frame="orders")
    return C.contingency(a.values, a.spec.categorical)
