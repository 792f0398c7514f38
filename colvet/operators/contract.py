"""Fragments and the contract.

A fragment is one audit's policy, qualification counts and rejections; the
contract merges fragments by precedence into one row per declared column.
Rejections are a DataFrame (column, check, value, unit) -- block expansion,
first-rejection-wins and the funnel are joins and window functions over it.
The fragment's JSON body is assembled from aggregates and the rejection list,
both bounded by the number of columns.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..policy import PRECEDENCE, PSI_GRID, DSPolicy, TCPolicy



def expand_blocks(rejected: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rejected (feature, value) -> (column, value, unit): a rejected member
    rejects its whole block at the block's worst (minimum) value; columns in
    no block are rejected alone (unit ``column``)."""
    bm = blocks.select("block", "column").distinct()
    hits = rejected.join(bm, rejected["feature"] == bm["column"]).groupBy("block").agg(F.min("value").alias("worst"))
    whole = bm.join(hits, "block").select("column", F.col("worst").alias("value"),
                                         F.concat(F.lit("block:"), F.col("block")).alias("unit"))
    loose = rejected.join(bm, rejected["feature"] == bm["column"], "left_anti") \
                    .select(F.col("feature").alias("column"), "value", F.lit("column").alias("unit"))
    return whole.unionByName(loose)


def _rows(df: DataFrame, cols) -> list:
    return [r.asDict() for r in df.select(*cols).collect()]  # rejection lists: bounded by columns


def tc_fragment(report: DataFrame, blocks: DataFrame | None, policy: TCPolicy = TCPolicy()):
    rejected = report.where(F.col("verdict") == "inverted").select("feature", F.col("delta").alias("value"))
    rows = expand_blocks(rejected, blocks) if blocks is not None and policy.reject_by_block else \
        rejected.select(F.col("feature").alias("column"), "value", F.lit("column").alias("unit"))
    q = report.agg(F.count(F.lit(1)).alias("features_scanned"),
                   F.count(F.when(F.col("verdict") == "degenerate", 1)).alias("degenerate"),
                   F.count(F.when(F.col("verdict") == "weak", 1)).alias("weak"),
                   F.count(F.when(F.col("verdict") == "inverted", 1)).alias("inverted_columns"),
                   F.percentile(F.when(F.col("verdict") == "inverted", F.col("woe_flip_mass")), 0.5)
                    .alias("median_flip_mass_inverted")).first().asDict()
    q["rejections_by_block"] = rows.where(F.col("unit") != "column").count()
    return _fragment("time_consistency", "time_consistency_scan", policy.__dict__, q, rows)


def ds_fragment(report: DataFrame, policy: DSPolicy = DSPolicy()):
    rej = report.where(F.col("psi").isNotNull() & (F.col("psi") > policy.psi_threshold)
                       & F.col("p_perm_bh").isNotNull() & (F.col("p_perm_bh") < policy.alpha))
    rows = rej.select("column", F.col("psi").alias("value"), F.lit("column").alias("unit"))
    q = report.agg(F.count(F.lit(1)).alias("columns_scanned"),
                   F.count(F.when(F.col("psi").isNull(), 1)).alias("degenerate"),
                   F.count(F.when(F.col("p_perm_bh") < policy.alpha, 1)).alias("significant_only"),
                   F.count(F.when(F.col("psi") > policy.psi_threshold, 1)).alias("material_only"),
                   F.percentile("psi_null_q99", 0.5).alias("median_null_q99"),
                   F.max("psi").alias("max_psi")).first().asDict()
    q["rejected"] = rows.count()
    return _fragment("distribution_shift", "distribution_shift_scan", policy.__dict__, q, rows)


def rd_fragment(report: DataFrame, params: dict):
    rej = report.where(~F.col("is_representative") & F.coalesce(F.col("predictable"), F.lit(False)))
    rows = rej.select("column", F.col("redun_r2").alias("value"), F.concat(F.lit("group:"), F.col("group")).alias("unit"))
    q = report.agg(F.count(F.lit(1)).alias("columns_clustered"), F.countDistinct("group").alias("groups"),
                   F.count(F.when(F.col("size") == 1, 1)).alias("singletons"), F.max("size").alias("largest_group"),
                   F.count(F.when(~F.col("is_representative"), 1)).alias("non_representatives")).first().asDict()
    q["also_predictable"] = rows.count()
    q["correlated_not_predictable"] = q["non_representatives"] - q["also_predictable"]
    return _fragment("redundancy", "redundancy_scan", params, q, rows)


def sq_fragment(report: DataFrame, reject: bool = False):
    flagged = report.where(F.col("segment_artefact") == F.lit(True))
    rows = flagged.select("column", F.col("gap_dominant").alias("value"), F.lit("column").alias("unit"))
    q = report.agg(F.count(F.lit(1)).alias("columns_scanned"),
                   F.count(F.when(F.col("heterogeneous"), 1)).alias("heterogeneous"),
                   F.count(F.when(~F.col("measurable_in_dominant") & (F.col("pooled_auc") > 0.55), 1))
                    .alias("unmeasurable_in_dominant"),
                   F.count(F.when(F.col("cmh_p").isNull(), 1)).alias("untestable"),
                   F.percentile("gap_dominant", 0.5).alias("median_gap_dominant")).first().asDict()
    q["segment_artefacts"] = flagged.count()
    if not reject:
        rows = rows.where(F.lit(False))
    return _fragment("segment_qualification", "segment_qualification_scan", {"reject": reject}, q, rows)


def _fragment(check, tool, params, qual, rows: DataFrame):
    rej = rows.withColumn("check", F.lit(check))
    listed = _rows(rej, ["column", "check", "value", "unit"])
    body = {"check": check, "tool": f"colvet::{tool}",
            "params": {k: (list(v) if isinstance(v, tuple) else v) for k, v in params.items()},
            "qualification": qual, "rejections": listed}
    return body, rej.select("column", "check", "value", "unit")


def declare(values: DataFrame, spec, sources: dict) -> DataFrame:
    """(name, source, dtype) per feature: source from the table map, dtype
    bool / int / float / str; a double whose values are all whole is ``int``."""
    spark = values.sparkSession
    kinds = spark.createDataFrame([(f, "bool" if f in spec.logical else spec.kind_of(f), sources.get(f, "derived"))
                                   for f in spec.features], "name string, kind string, source string")
    whole = (values.where(F.col("window") == "early").where(F.col("vnum").isNotNull())
                   .groupBy("feature").agg(F.bool_and(F.col("vnum") == F.floor("vnum")).alias("whole")))
    j = kinds.join(whole, kinds["name"] == whole["feature"], "left")
    return j.select("name", "source", _dtype().alias("dtype"))


def _dtype():
    return (F.when(F.col("kind") == "text", F.lit("str")).when(F.col("kind") == "bool", F.lit("bool"))
             .when(F.coalesce(F.col("whole"), F.lit(True)), F.lit("int")).otherwise(F.lit("float")))


def declare_rows(rows: DataFrame, spec, sources: dict) -> DataFrame:
    """``declare`` from the rows of the early window instead of VALUES: one aggregate row,
    nothing but a flag per column is shuffled."""
    def whole(f):
        return F.bool_and(F.col(f) == F.floor(f)) if f in spec.measured else F.lit(None).cast("boolean")

    kind = {f: "bool" if f in spec.logical else spec.kind_of(f) for f in spec.features}
    one = rows.where(F.col("window") == "early").agg(F.count(F.lit(1)).alias("rows"), *[whole(f).alias(f"w_{i}") for i, f in enumerate(kind)])
    each = one.select(F.inline(F.array(*[F.struct(
        F.lit(f).alias("name"), F.lit(sources.get(f, "derived")).alias("source"), F.lit(k).alias("kind"),
        F.col(f"w_{i}").alias("whole")) for i, (f, k) in enumerate(kind.items())])))
    return each.select("name", "source", _dtype().alias("dtype"))


def first_rejection(rejections: DataFrame, precedence=PRECEDENCE) -> DataFrame:
    """One rejection per column: the check earliest in ``precedence`` wins."""
    spark = rejections.sparkSession
    pr = spark.createDataFrame([(c, i) for i, c in enumerate(precedence)], "check string, precedence int")
    r = rejections.join(F.broadcast(pr), "check")
    w = Window.partitionBy("column").orderBy("precedence", "value")
    return (r.withColumn("rk", F.row_number().over(w)).where(F.col("rk") == 1)
             .select(F.col("column").alias("name"), F.col("check").alias("rejected_by"),
                     F.col("value").alias("rejected_value"), F.col("unit").alias("rejected_unit")))


def merge(declared: DataFrame, rejections: DataFrame, precedence=PRECEDENCE) -> DataFrame:
    first = first_rejection(rejections, precedence)
    cols = declared.join(first, "name", "left")
    return cols.select("name", "source", "dtype", F.col("rejected_by").isNull().alias("admitted"),
                       F.coalesce(F.col("rejected_by"), F.lit("")).alias("rejected_by"), "rejected_value",
                       F.coalesce(F.col("rejected_unit"), F.lit("")).alias("rejected_unit"))


def summary(columns: DataFrame) -> DataFrame:
    return columns.agg(F.count(F.lit(1)).alias("declared"),
                       F.count(F.when(F.col("admitted"), 1)).alias("admitted"),
                       F.count(F.when(~F.col("admitted"), 1)).alias("rejected"),
                       F.count(F.when(F.col("admitted") & (F.col("source") == "request"), 1)).alias("request_fields"),
                       F.count(F.when(F.col("admitted") & (F.col("source") == "retrieved"), 1)).alias("retrieved_fields"),
                       F.count(F.when(F.col("admitted") & (F.col("source") == "derived"), 1)).alias("derived_fields"))


def funnel(columns: DataFrame, precedence=PRECEDENCE) -> DataFrame:
    """Declared, removed per check in precedence order (0 where a check removed
    nothing), admitted; and admitted share by source."""
    row = columns.agg(F.count(F.lit(1)).alias("declared"),
                      *[F.count(F.when(F.col("rejected_by") == c, 1)).alias(c) for c in precedence],
                      F.count(F.when(F.col("admitted"), 1)).alias("admitted"))
    step = row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("stage"), F.col(c).alias("columns"))
                                         for c in ("declared", *precedence, "admitted")])))
    by_src = columns.groupBy("source").agg(F.count(F.lit(1)).alias("declared"),
                                           F.avg(F.col("admitted").cast("double")).alias("admitted_share"))
    return step.select("stage", "columns", F.lit(None).cast("double").alias("admitted_share")) \
               .unionByName(by_src.select(F.concat(F.lit("source:"), F.col("source")).alias("stage"),
                                          F.col("declared").alias("columns"), "admitted_share"))


def body(columns: DataFrame, fragments: list, policy: dict, data=None, derivations=None, fitted=None,
         created_at: str | None = None) -> dict:
    """The whole contract as one JSON-ready value: version, time, data, policy,
    derivations, fitted parameters, summary, one entry per fragment and per
    column. Everything in it is bounded by the number of columns and checks."""
    listed = sorted(_rows(columns, columns.columns), key=lambda c: c["name"])
    counts = summary(columns).first().asDict()
    return {"version": "1", "created_at": created_at or datetime.now(timezone.utc).isoformat(timespec="seconds"),
            "data": data or {}, "policy": policy, "derivations": derivations or [], "fitted_parameters": fitted or {},
            "summary": counts | {"precedence": [f["check"] for f in fragments]},
            "fragments": [{k: f[k] for k in ("check", "tool", "params", "qualification")} | {"rejected": len(f["rejections"])}
                          for f in fragments],
            "columns": listed}


def random_sets(iv: DataFrame, columns: DataFrame, draws: int = 2000, seed: int = 0) -> DataFrame:
    """Total IV of the admitted set against ``draws`` random sets of the same
    size from the declared columns with an IV. (draw, column) rows are
    generated per column -- draws x columns, both fixed sizes -- and the
    top-k per draw is a window group limit.)"""
    ivd = columns.join(iv, columns["name"] == iv["feature"]).where(F.col("iv").isNotNull())
    k = ivd.where(F.col("admitted")).count()
    admitted_total = ivd.where(F.col("admitted")).agg(F.sum("iv")).first()[0] or 0.0
    gen = ivd.select("name", "iv", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    gen = gen.withColumn("u", F.xxhash64(F.col("name"), F.col("draw"), F.lit(seed)))
    w = Window.partitionBy("draw").orderBy("u", "name")
    picked = gen.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)
    tot = picked.groupBy("draw").agg(F.sum("iv").alias("total"))
    return tot.agg(F.lit(k).cast("long").alias("set_size"), F.lit(float(admitted_total)).alias("admitted_iv"),
                   F.avg("total").alias("random_mean"), F.percentile("total", 0.95).alias("random_q95"),
                   F.avg((F.col("total") >= F.lit(float(admitted_total))).cast("double")).alias("share_at_least"),
                   (F.lit(100.0) * F.avg((F.col("total") < F.lit(float(admitted_total))).cast("double"))).alias("percentile"),
                   ((F.count(F.when(F.col("total") >= F.lit(float(admitted_total)), 1)) + 1)
                    / (F.count(F.lit(1)) + 1)).alias("p_value"))


def threshold_jaccard(tc_report: DataFrame, ds_report: DataFrame, declared: DataFrame, grid=PSI_GRID,
                      policy_threshold: float = 0.25, alpha: float = 0.05) -> DataFrame:
    """Admitted count and Jaccard overlap with the policy set when only the
    inverted and drifted columns (no block expansion, no redundancy) are
    removed, for each PSI threshold."""
    inv = tc_report.where(F.col("verdict") == "inverted").select(F.col("feature").alias("name"), F.lit(True).alias("inv"))
    d = declared.select("name").join(inv, "name", "left").join(
        ds_report.select(F.col("column").alias("name"), "psi", "p_perm_bh"), "name", "left")
    sig = F.coalesce(F.col("p_perm_bh") < alpha, F.lit(False))
    keep_pol = F.col("inv").isNull() & ~(sig & F.coalesce(F.col("psi") > policy_threshold, F.lit(False)))
    g = d.select("name", keep_pol.alias("in_policy"),
                 *[(F.col("inv").isNull() & ~(sig & F.coalesce(F.col("psi") > t, F.lit(False)))).alias(f"t{i}")
                   for i, t in enumerate(grid)])
    aggs = []
    for i, t in enumerate(grid):
        a, b = F.col(f"t{i}"), F.col("in_policy")
        aggs.append(F.struct(F.lit(float(t)).alias("psi_threshold"),
                             F.count(F.when(a, 1)).alias("admitted"),
                             (F.count(F.when(a & b, 1)) / F.count(F.when(a | b, 1))).alias("jaccard")).alias(f"s{i}"))
    row = g.agg(*aggs)
    return row.select(F.inline(F.array(*[F.col(f"s{i}") for i in range(len(grid))])))
