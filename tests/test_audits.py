import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from colvet.operators import contract as CT
from colvet.operators import derive as DV
from colvet.operators import entity as E
from colvet.operators import missingness as M
from colvet.operators import segment as SQ
from colvet.operators import tc as TC

from conftest import make_audit


def _logit(z):
    return 1 / (1 + np.exp(-z))


def test_inverted_column(spark):
    rng = np.random.default_rng(0)
    n = 20000
    x = rng.random(2 * n)
    t = np.arange(2 * n)
    early = t < n
    p = np.where(early, _logit(-3 + 3 * x), _logit(-3 - 3 * x + 3))
    y = (rng.random(2 * n) < p).astype(int)
    pdf = pd.DataFrame({"row_id": t, "t": t, "y": y, "x": x})
    a = make_audit(spark, pdf, numeric=["x"])
    r = TC.scan(a).first()
    assert r["verdict"] == "inverted"


def test_flat_column_is_degenerate(spark):
    # equal rates in both bins: all scores equal, AUC not estimable
    rows = []
    for w in range(2):
        for xv, pos in ((0, 100), (1, 100)):
            rows += [(xv, 1)] * pos + [(xv, 0)] * 900
    x = np.array([r[0] for r in rows], float)
    y = np.array([r[1] for r in rows])
    t = np.arange(len(rows))
    a = make_audit(spark, pd.DataFrame({"row_id": t, "t": t, "y": y, "x": x}), numeric=["x"])
    r = TC.scan(a).first()
    assert r["verdict"] == "degenerate" and r["note"] == "AUC not estimable on the scored window"


def test_simpson_segment_artefact(spark):
    rng = np.random.default_rng(2)
    n = 8000
    seg = rng.choice(["A", "B"], n)
    x = (seg == "B").astype(float) + rng.normal(0, 0.01, n)
    y = (rng.random(n) < np.where(seg == "B", 0.30, 0.02)).astype(int)
    t = np.arange(n)
    pdf = pd.DataFrame({"row_id": t, "t": t, "y": y, "x": x, "seg": seg})
    a = make_audit(spark, pdf, numeric=["x"], text=["seg"], segment="seg", train=(0.0, 0.99), holdout=(0.99, 1.0))
    r = SQ.scan(a).where(F.col("column") == "x").first()
    assert r["pooled_auc"] > 0.7
    assert r["cmh_p"] is None or r["cmh_p"] > 0.05


def test_missingness_families(spark):
    t = np.arange(200)
    a_ = np.where(t < 2, np.nan, t * 1.0)
    b_ = np.where(t < 2, np.nan, t * 2.0)
    c_ = np.where(t < 1, np.nan, t * 3.0)
    d_ = t * 4.0
    pdf = pd.DataFrame({"row_id": t, "t": t, "y": t % 2, "a": a_, "b": b_, "c": c_, "d": d_})
    aud = make_audit(spark, pdf, numeric=["a", "b", "c", "d"], train=(0.0, 0.99), holdout=(0.99, 1.0))
    fams = M.families(aud.values.where(F.col("window") == "early"), ["a", "b", "c", "d"]).collect()
    assert sorted(r["feature"] for r in fams) == ["a", "b"]


def test_little_mcar_detects_dependent_absence(spark):
    rng = np.random.default_rng(4)
    n = 4000
    ref = rng.normal(size=n)
    other = rng.normal(size=n)
    target = ref * 0.5 + rng.normal(size=n)

    def p_of(miss):
        tt = np.where(miss, np.nan, target)
        df = spark.createDataFrame(pd.DataFrame({"target": tt, "ref": ref, "other": other}))
        df = df.withColumn("target", F.when(F.isnan("target"), None).otherwise(F.col("target")))
        st = M.pattern_stats(df, ["target", "ref", "other"]).toPandas()
        d2, dof, _ = M.little_mcar(st, 3)
        from colvet.functions.dist import chi2_sf
        return chi2_sf(d2, dof)

    assert p_of(rng.random(n) < 0.3) > 0.01
    assert p_of(ref > 0.5) < 0.01


def test_purity_null_mean_closed_form(spark):
    rng = np.random.default_rng(5)
    uid = np.repeat(np.arange(500), 4)
    y = (rng.random(2000) < 0.2).astype(int)
    g = spark.createDataFrame(pd.DataFrame({"uid": uid.astype(str), "y": y}))
    gr = E.groups(g, F.col("uid"), "y")
    mean = E.purity_null_mean(gr).first()["null_mean"]
    sims = []
    for _ in range(300):
        yp = rng.permutation(y)
        s = pd.DataFrame({"u": uid, "y": yp}).groupby("u")["y"].agg(["sum", "count"])
        sims.append(((s["sum"] == 0) | (s["sum"] == s["count"])).mean())
    assert abs(mean - np.mean(sims)) < 0.01
    d = E.purity_null(gr, draws=100, seed=1).first()
    assert 0 < d["p_value"] <= 1 and d["null_q99"] >= d["null_mean"] - 0.05


def test_entity_coverage_and_singletons(spark):
    df = spark.createDataFrame(pd.DataFrame({"k": ["a", "a", None, None, "b"], "t": [0, 86400, 0, 0, 0]}))
    c = E.coverage(df, F.col("k"), "t").first()
    assert abs(c["rows_covered"] - 0.6) < 1e-12 and c["entities"] == 2
    s = spark.createDataFrame(pd.DataFrame({"k": [str(i) for i in range(100)], "y": [0] * 100}))
    summ = E.group_summary(E.groups(s, F.col("k"), "y")).first()
    assert summ["singleton_share"] == 1.0 and summ["multi_groups"] == 0


def test_verify_key_partition_and_missing_column(spark):
    df = spark.createDataFrame(pd.DataFrame({"c": ["x", "x", "y", None], "u": ["1", "1", "2", None]}))
    r = E.verify_key(df, E.entity_uid(["c"]), "u").first()
    assert r["agreement"] == 1.0
    split = spark.createDataFrame(pd.DataFrame({"c": ["x", "x", "y"], "u": ["1", "2", "3"]}))
    assert E.verify_key(split, E.entity_uid(["c"]), "u").first()["agreement"] < 1
    with pytest.raises(ValueError):
        E.verify_key(df, E.entity_uid(["c"]), "client_uid")


def test_block_expansion_and_merge(spark):
    rejected = spark.createDataFrame([("a", -0.07), ("b", -0.03), ("d", -0.05)], "feature string, value double")
    blocks = spark.createDataFrame([("B1", "a"), ("B1", "b"), ("B1", "c")], "block string, column string")
    got = {r["column"]: (r["value"], r["unit"]) for r in CT.expand_blocks(rejected, blocks).collect()}
    assert got == {"a": (-0.07, "block:B1"), "b": (-0.07, "block:B1"), "c": (-0.07, "block:B1"),
                   "d": (-0.05, "column")}
    rej = spark.createDataFrame([("a", "redundancy", 0.95, "group:1"), ("a", "time_consistency", -0.07, "column")],
                                "column string, check string, value double, unit string")
    declared = spark.createDataFrame([("a", "request", "float"), ("z", "derived", "int")],
                                     "name string, source string, dtype string")
    cols = {r["name"]: r for r in CT.merge(declared, rej).collect()}
    assert cols["a"]["rejected_by"] == "time_consistency" and cols["z"]["admitted"]
    merged = CT.merge(declared, rej)
    s = CT.summary(merged).first()
    assert s["declared"] == s["admitted"] + s["rejected"]
    stages = {r["stage"]: r["columns"] for r in CT.funnel(merged).collect()}
    assert stages == {"declared": 2, "time_consistency": 1, "distribution_shift": 0, "redundancy": 0,
                      "segment_qualification": 0, "admitted": 1, "source:request": 1, "source:derived": 1}
    frag = {"check": "time_consistency", "tool": "x", "params": {}, "qualification": {}, "rejections": [{}]}
    body = CT.body(merged, [frag], {})
    assert body["summary"]["rejected"] == 1 and body["summary"]["precedence"] == ["time_consistency"]
    assert [c["name"] for c in body["columns"]] == ["a", "z"] and body["fragments"][0]["rejected"] == 1


def test_derivations(spark):
    df = spark.createDataFrame(pd.DataFrame({"t": [0, 86400, 864500, 86400], "D1": [0.0, 1.0, 3.0, None],
                                             "P": ["W", "C", None, "W"], "addr": ["315", "204", "999", None]}))
    maps = spark.createDataFrame([("addr", "315", 120), ("addr", "204", 7)], "column string, level string, n long")
    specs = [DV.Derivation("D1n", "days_since_to_start_day", ("D1",)),
             DV.Derivation("P_is_W", "one_hot", ("P",), {"level": "W"}),
             DV.Derivation("addr_freq", "frequency_encode", ("addr",))]
    out = DV.apply_derivations(df, specs, maps).orderBy("t", "D1").toPandas()
    rows = {(r.t, None if pd.isna(r.D1) else r.D1): r for r in out.itertuples()}
    assert rows[(864500, 3.0)].D1n == 7 and pd.isna(rows[(86400, None)].D1n)
    assert list(DV.apply_derivations(df, specs[1:2]).orderBy("t", "D1").toPandas()["P_is_W"].astype("float")
                .fillna(-1)) in ([1, 0, 1, -1], [1, 1, 0, -1], [1, 0, -1, 1], [1, 1, -1, 0], [1.0, 1.0, 0.0, -1.0])
    with pytest.raises(ValueError):
        DV.apply_derivations(df, [DV.Derivation("x", "nope", ("D1",))])
    with pytest.raises(ValueError):
        DV.apply_derivations(df, [DV.Derivation("x", "one_hot", ("absent",), {"level": "a"})])
    with pytest.raises(ValueError):
        DV.apply_derivations(df, [DV.Derivation("x", "frequency_encode", ("P",))], maps)


def test_mcar_drops_constant_columns():
    st = pd.DataFrame({"pattern": ["111", "011"], "n": [10, 5],
                       "s_0": [10.0, None], "s_1": [20.0, 10.0], "s_2": [30.0, 15.0],
                       "x_0_0": [10.0, None], "x_0_1": [20.0, None], "x_0_2": [30.0, None],
                       "x_1_1": [40.0, 20.0], "x_1_2": [60.0, 30.0], "x_2_2": [95.0, 46.0]})
    out, k = M.drop_constant(st, 3)
    assert k == 1 and set(out["pattern"]) == {"1"} and int(out["n"].sum()) == 15


def test_hashed_sample_ignores_row_order(spark):
    from colvet.operators.shift import hashed_sample
    rng = np.random.default_rng(8)
    ids = np.arange(5000)
    a = spark.createDataFrame(pd.DataFrame({"row_id": ids}))
    b = spark.createDataFrame(pd.DataFrame({"row_id": rng.permutation(ids)})).repartition(7)
    sa = {r["row_id"] for r in hashed_sample(a, "row_id", 300, seed=42).collect()}
    sb = {r["row_id"] for r in hashed_sample(b, "row_id", 300, seed=42).collect()}
    assert sa == sb and len(sa) == 300


def test_random_sets_and_threshold_grid(spark):
    columns = spark.createDataFrame([(f"c{i}", "request", "float", i < 4, "", None, "") for i in range(10)],
                                    "name string, source string, dtype string, admitted boolean, rejected_by string,"
                                    " rejected_value double, rejected_unit string")
    iv = spark.createDataFrame([(f"c{i}", float(10 - i)) for i in range(10)], "feature string, iv double")
    r = CT.random_sets(iv, columns, draws=500).first()
    assert r["set_size"] == 4 and r["admitted_iv"] == 34.0
    assert 0 <= r["share_at_least"] <= 1 and r["random_mean"] < r["admitted_iv"]
    assert abs(r["p_value"] - (1 + 500 * r["share_at_least"]) / 501) < 1e-12
    assert abs(r["percentile"] - 100 * (1 - r["share_at_least"])) < 1e-9
    tc = spark.createDataFrame([("c0", "inverted"), ("c1", "pass")], "feature string, verdict string")
    ds = spark.createDataFrame([("c2", 0.3, 0.01), ("c3", 0.12, 0.01)], "column string, psi double, p_perm_bh double")
    declared = columns.select("name")
    grid = {round(g["psi_threshold"], 2): g for g in CT.threshold_jaccard(tc, ds, declared).collect()}
    assert grid[0.25]["jaccard"] == 1.0 and grid[0.25]["admitted"] == 8
    assert grid[0.1]["admitted"] == 7 and grid[0.5]["admitted"] == 9


def test_unseen_late_level_scores_as_empty_early_bin(spark):
    from colvet.operators import woe as W
    t = np.arange(400)
    early = t < 200
    x = np.where(early, np.where(t % 2 == 0, "a", "b"), np.where(t % 4 == 0, "c", "a"))
    y = ((t % 5) == 0).astype(int)
    aud = make_audit(spark, pd.DataFrame({"row_id": t, "t": t, "y": y, "x": x}), text=["x"],
                     train=(0.0, 0.5), holdout=(0.5, 1.0))
    w = {r["bin_idx"]: r for r in aud.woe_of("early").collect()}
    levels = aud.binning.first()["levels"]
    other = len(levels)  # __other__ follows the kept levels; c was never seen early
    sp = sum(r["pos"] + (0.5 if r["pos"] == 0 or r["neg"] == 0 else 0) for r in w.values())
    sn = sum(r["neg"] + (0.5 if r["pos"] == 0 or r["neg"] == 0 else 0) for r in w.values())
    assert abs(w[other]["woe"] - math.log(sn / sp)) < 1e-12
    scored = W.score_cells(aud.cells.where(F.col("window") == "late"), aud.woe_of("early"))
    assert {r["score"] for r in scored.where(F.col("bin_idx") == other).collect()} == {w[other]["woe"]}
