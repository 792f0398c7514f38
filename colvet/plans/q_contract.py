"""Registered queries: fragments and the contract (2.18), the remaining joins
(2.4) and the fragment / declaration sources and sinks (2.1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contract as CT
from ..operators import redundancy as RD
from ..operators import segment as SQ
from ..operators import shift as SH
from ..operators import tc as TC
from ..policy import PRECEDENCE, DSPolicy, RDPolicy, SQPolicy, TCPolicy
from ..session import cut_lineage
from ..sources import readers as RDR
from . import oracle_sql as O
from .pipeline import _data_signature, prepare
from .q_rddm import representatives_sql
from .q_segment import segment_scan_sql
from .q_shift import BC_SQL, contrib_sql
from .q_tc import scan_sql
from .registry import register

# Where each events-frame column comes from at scoring time.
SOURCES = {"value": "request", "s_acctbal": "retrieved", "s_nationkey": "retrieved",
           "c_acctbal": "retrieved", "c_nationkey": "retrieved", "c_mktsegment": "retrieved",
           "c_nation": "retrieved", "k": "derived"}

#: The contract runs on the planted frame: on the events frame no column is rejected.
FRAME = "planted"

_RUNS: dict = {}


class ContractRun:
    """All four audits on one frame, their fragments, and the merged contract.

    Built once per (session, data folder): the scans are the expensive part
    and every contract query reads the same results.
    """

    def __init__(self, spark, sf):
        a = prepare(spark, sf, frame=FRAME, store=True)  # four audits read its rows
        self.audit = a
        self.blocks = RDR.load_blocks(spark, FRAME)
        self.tc = cut_lineage(TC.scan(a))
        self.ds = cut_lineage(SH.scan(a))
        self.iv = self.tc.select("feature", F.col("iv_train").alias("iv"))
        rd, _, _ = RD.scan(a, self.iv)
        self.rd = cut_lineage(rd)
        self.sq = cut_lineage(SQ.scan(a))
        self.fragments = [CT.tc_fragment(self.tc, self.blocks), CT.ds_fragment(self.ds),
                          CT.rd_fragment(self.rd, RDPolicy().__dict__), CT.sq_fragment(self.sq)]
        rej = None
        for _, r in self.fragments:
            rej = r if rej is None else rej.unionByName(r)
        self.rejections = cut_lineage(rej)
        self.declared = cut_lineage(CT.declare(a.values, a.spec, SOURCES))
        self.columns = cut_lineage(CT.merge(self.declared, self.rejections))

    def fragment(self, check):
        return next(f for f in self.fragments if f[0]["check"] == check)


def run_for(spark, sf) -> ContractRun:
    key = (spark.sparkContext.applicationId, sf, _data_signature(spark, sf))
    if key not in _RUNS:
        _RUNS[key] = ContractRun(spark, sf)
    return _RUNS[key]


def _declared_cte(frame: str) -> str:
    """CTE ``decl`` (name, source, dtype) after the frame's windows (CTE ``fw``)."""
    spec = O.SPECS[frame]
    src = ", ".join(f"('{f}', '{s}')" for f, s in SOURCES.items())
    kinds = ", ".join(f"('{f}', '{'bool' if f in spec.logical else spec.kind_of(f)}')" for f in spec.features)
    whole = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, bool_and({f}::DOUBLE = floor({f}::DOUBLE)) AS whole FROM fw "
        f"WHERE \"window\" = 'early' AND {f} IS NOT NULL" for f in spec.numeric)
    return f""",
dsrc(name, source) AS (VALUES {src}),
dkinds(name, kind) AS (VALUES {kinds}),
dwh AS ({whole}),
decl AS (SELECT k.name, coalesce(s.source, 'derived') AS source,
                CASE WHEN k.kind = 'text' THEN 'str' WHEN k.kind = 'bool' THEN 'bool' WHEN coalesce(w.whole, TRUE) THEN 'int' ELSE 'float' END AS dtype
         FROM dkinds k LEFT JOIN dsrc s USING (name) LEFT JOIN dwh w ON w.feature = k.name)"""


def _contract_sql() -> str:
    """Scan, block expansion, drift, first rejection and merge of the planted frame. A PSI above the
    threshold lies beyond every shuffle, so its p is the least possible one; redundancy and
    segments reject nothing here."""
    blocks = ", ".join(f"('{b['block']}', '{c}')" for b in RDR.block_file(FRAME) for g in b["groups"] for c in g)
    order = ", ".join(f"('{c}', {i})" for i, c in enumerate(PRECEDENCE))
    return scan_sql(FRAME) + _declared_cte(FRAME) + BC_SQL + contrib_sql("bcn", "ctb") + f""",
bm(block, "column") AS (VALUES {blocks}),
prec("check", precedence) AS (VALUES {order}),
inv AS (SELECT feature, delta AS value FROM tc WHERE verdict = 'inverted'),
hitb AS (SELECT block, min(value) AS worst FROM inv JOIN bm ON bm."column" = inv.feature GROUP BY block),
expanded AS (SELECT bm."column", worst AS value, 'block:' || block AS unit FROM bm JOIN hitb USING (block)
             UNION ALL SELECT feature, value, 'column' FROM inv WHERE feature NOT IN (SELECT "column" FROM bm)),
psis AS (SELECT feature, sum(contrib) AS psi FROM ctb GROUP BY feature),
rej AS (SELECT "column", 'time_consistency' AS "check", value, unit FROM expanded
        UNION ALL SELECT feature, 'distribution_shift', psi, 'column' FROM psis WHERE psi > 0.25),
first_rej AS (SELECT "column" AS name, "check" AS rejected_by, value AS rejected_value, unit AS rejected_unit FROM (
               SELECT rej.*, row_number() OVER (PARTITION BY "column" ORDER BY precedence, value) AS rk
               FROM rej JOIN prec USING ("check")) q WHERE rk = 1),
merged AS (SELECT d.name, d.source, d.dtype, f.rejected_by IS NULL AS admitted, coalesce(f.rejected_by, '') AS rejected_by,
                  f.rejected_value, coalesce(f.rejected_unit, '') AS rejected_unit
           FROM decl d LEFT JOIN first_rej f USING (name))"""


CONTRACT_SQL = _contract_sql()


def _funnel_sql() -> str:
    steps = [f"SELECT '{c}' AS stage, count(*) FILTER (WHERE rejected_by = '{c}') AS columns FROM merged" for c in PRECEDENCE]
    both = ["SELECT 'declared' AS stage, count(*) AS columns FROM merged", *steps,
            "SELECT 'admitted' AS stage, count(*) FILTER (WHERE admitted) AS columns FROM merged"]
    return (CONTRACT_SQL + ",\nsteps AS (" + " UNION ALL ".join(both) + """)
SELECT stage, columns::BIGINT AS columns, NULL::DOUBLE AS admitted_share FROM steps
UNION ALL SELECT 'source:' || source, count(*)::BIGINT, avg(CASE WHEN admitted THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)
FROM merged GROUP BY source""")


def _tc_fragment_sql() -> str:
    counts = {"features_scanned": "count(*)", "degenerate": "count(*) FILTER (WHERE verdict = 'degenerate')",
              "weak": "count(*) FILTER (WHERE verdict = 'weak')", "inverted_columns": "count(*) FILTER (WHERE verdict = 'inverted')",
              "median_flip_mass_inverted": "quantile_cont(woe_flip_mass, 0.5) FILTER (WHERE verdict = 'inverted')",
              "rejections_by_block": "any_value((SELECT count(*) FROM expanded WHERE unit <> 'column'))",
              "rejections": "any_value((SELECT count(*) FROM expanded))"}
    return CONTRACT_SQL + "\n" + "\nUNION ALL ".join(
        f"SELECT 'time_consistency' AS \"check\", '{k}' AS metric, ({x})::DOUBLE AS value FROM tc" for k, x in counts.items())


def _qual_frame(spark, body):
    """The fragment's qualification counts as (check, metric, value) rows."""
    q = dict(body["qualification"])
    q["rejections"] = len(body["rejections"])
    rows = [(body["check"], k, None if v is None else float(v)) for k, v in q.items()]
    return spark.createDataFrame(rows, "check string, metric string, value double")


@register("ct_expand_blocks", sql=CONTRACT_SQL + "\nSELECT * FROM expanded", floats=("value",))
def q_expand(spark, sf):
    """Inverted columns expanded to their whole block at the worst delta."""
    r = run_for(spark, sf)
    rejected = r.tc.where(F.col("verdict") == "inverted").select("feature", F.col("delta").alias("value"))
    return CT.expand_blocks(rejected, r.blocks)


@register("ct_tc_fragment", sql=_tc_fragment_sql(), floats=("value",))
def q_tc_frag(spark, sf):
    """Time-consistency fragment: qualification counts and rejections."""
    return _qual_frame(spark, run_for(spark, sf).fragment("time_consistency")[0])


@register("ct_ds_fragment")
def q_ds_frag(spark, sf):
    """Distribution-shift fragment: qualification counts and rejections."""
    return _qual_frame(spark, run_for(spark, sf).fragment("distribution_shift")[0])


@register("ct_rd_fragment")
def q_rd_frag(spark, sf):
    """Redundancy fragment: qualification counts and rejections."""
    return _qual_frame(spark, run_for(spark, sf).fragment("redundancy")[0])


SQ_COUNTS = {"columns_scanned": "count(*)", "heterogeneous": "count(*) FILTER (WHERE heterogeneous)",
             "unmeasurable_in_dominant": "count(*) FILTER (WHERE NOT measurable_in_dominant AND pooled_auc > 0.55)",
             "untestable": "count(*) FILTER (WHERE cmh_p IS NULL)", "median_gap_dominant": "quantile_cont(gap_dominant, 0.5)",
             "segment_artefacts": "count(*) FILTER (WHERE segment_artefact)"}


@register("ct_sq_fragment", sql=segment_scan_sql(FRAME) + "\n" + "\nUNION ALL ".join(
    f"SELECT 'segment_qualification' AS \"check\", '{k}' AS metric, ({x})::DOUBLE AS value FROM sq"
    for k, x in SQ_COUNTS.items())
    + "\nUNION ALL SELECT 'segment_qualification', 'rejections', 0.0::DOUBLE", floats=("value",))
def q_sq_frag(spark, sf):
    """Segment-qualification fragment: qualification counts (report only)."""
    return _qual_frame(spark, run_for(spark, sf).fragment("segment_qualification")[0])


@register("ct_declare", sql="WITH " + O.FRAME_SQL["events"].lstrip() + "," + O.windows_sql() + _declared_cte("events") + "\nSELECT * FROM decl")
def q_declare(spark, sf):
    """Source (request / retrieved / derived) and dtype of every feature."""
    a = prepare(spark, sf)
    return CT.declare(a.values, a.spec, SOURCES)


@register("ct_merge", sql=CONTRACT_SQL + "\nSELECT * FROM merged", floats=("rejected_value",))
def q_merge(spark, sf):
    """One row per declared column: admitted, or the first rejection by precedence."""
    return run_for(spark, sf).columns


@register("ct_body")
def q_body(spark, sf):
    """The whole contract written as JSON and read back: version, its summary counts,
    the number of fragments, and of columns listed."""
    r = run_for(spark, sf)
    policy = {c: p().__dict__ for c, p in (("time_consistency", TCPolicy), ("distribution_shift", DSPolicy),
                                           ("redundancy", RDPolicy), ("segment_qualification", SQPolicy))}
    body = CT.body(r.columns, [f for f, _ in r.fragments], policy, data={"path": sf, "frame": r.audit.spec.name})
    path = RDR.write_contract(spark, body, RDR.scratch_path(spark, "contract"))
    d = spark.read.json(path)
    return d.select("version", *[F.col(f"summary.{c}").alias(c) for c in (
        "declared", "admitted", "rejected", "request_fields", "retrieved_fields", "derived_fields")],
        F.size("fragments").alias("fragments"), F.size("columns").alias("columns"))


@register("ct_funnel", sql=_funnel_sql(), floats=("admitted_share",))
def q_funnel(spark, sf):
    """Declared, removed by each check, admitted; admitted share by source."""
    return CT.funnel(run_for(spark, sf).columns)


@register("ct_random_sets")
def q_random_sets(spark, sf):
    """Total IV of the admitted set against 2,000 random sets of the same size:
    its percentile among them and the one-sided p."""
    r = run_for(spark, sf)
    return CT.random_sets(r.iv, r.columns, draws=2000)


@register("ct_threshold_jaccard")
def q_jaccard(spark, sf):
    """Admitted count and Jaccard overlap with the policy set for each PSI threshold."""
    r = run_for(spark, sf)
    return CT.threshold_jaccard(r.tc, r.ds, r.declared)


@register("join_first_rejection", sql=CONTRACT_SQL + "\nSELECT * FROM first_rej", floats=("rejected_value",))
def q_first_rej(spark, sf):
    """One rejection per column: the earliest check in precedence wins."""
    return CT.first_rejection(run_for(spark, sf).rejections)


@register("join_report_merge", sql=representatives_sql(FRAME) + """
SELECT "column", "group", size, representative, is_representative, null_rate, iv,
       -- no two columns of this frame cluster, and a column alone cannot be redundant
       CASE WHEN size = 1 THEN FALSE END AS predictable, NULL::DOUBLE AS redun_r2, CASE WHEN size = 1 THEN 'singleton' END AS redun_note
FROM reps""", floats=("null_rate", "iv", "redun_r2"))
def q_report_merge(spark, sf):
    """Representatives LEFT JOIN redundancy verdicts."""
    return run_for(spark, sf).rd


@register("join_semi_admitted", sql=CONTRACT_SQL + """
SELECT feature, iv_train AS iv FROM tc WHERE feature IN (SELECT name FROM merged WHERE admitted)""",
          floats=("iv",))
def q_semi(spark, sf):
    """Information values of admitted columns only."""
    r = run_for(spark, sf)
    adm = r.columns.where(F.col("admitted")).select(F.col("name").alias("feature"))
    return r.iv.join(adm, "feature", "left_semi")


@register("join_anti_unclaimed", sql=CONTRACT_SQL + """
SELECT "column", "check", value, unit FROM rej WHERE "column" NOT IN (SELECT "column" FROM bm)""", floats=("value",))
def q_anti(spark, sf):
    """Rejected columns that belong to no pinned block."""
    r = run_for(spark, sf)
    return r.rejections.join(r.blocks.select("column"), "column", "left_anti")


@register("sink_fragment")
def q_sink_fragment(spark, sf):
    """Write every fragment (JSON) and report (CSV); read the TC report back."""
    r = run_for(spark, sf)
    folder = RDR.scratch_path(spark, "fragments")
    reports = {"time_consistency": r.tc, "distribution_shift": r.ds, "redundancy": r.rd,
               "segment_qualification": r.sq}
    for body, _ in r.fragments:
        RDR.write_fragment(spark, body, reports[body["check"]], folder)
    r.fragment_folder = folder
    return spark.read.option("header", True).csv(f"{folder}/tables/time_consistency")


@register("src_fragments")
def q_src_fragments(spark, sf):
    """Fragments read back in precedence order; a missing check raises."""
    r = run_for(spark, sf)
    if not getattr(r, "fragment_folder", None):
        q_sink_fragment(spark, sf)
    fr = RDR.read_fragments(spark, r.fragment_folder, PRECEDENCE)
    return fr.select("check", "tool", "precedence", F.size("rejections").alias("rejections"))
