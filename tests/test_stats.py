import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from colvet.functions import dist as D
from colvet.operators import rank as R
from colvet.operators import shift as SH
from colvet.operators import woe as W
from colvet.operators.categorical import _v_from_table


def test_tails_known_values():
    assert abs(D.chi2_sf(3.841458820694124, 1) - 0.05) < 1e-10
    assert abs(D.chi2_sf(18.307038053275146, 10) - 0.05) < 1e-10
    assert abs(D.t_two_sided(2.0, 10) - 0.07338803477074882) < 1e-10
    assert abs(D.t_two_sided(1.959963984540054, 1e9) - 0.05) < 1e-6
    assert abs(D.norm_ppf(0.975) - 1.959963984540054) < 1e-12
    assert abs(D.norm_ppf(0.1) + 1.2815515655446004) < 1e-9


def _pairwise_auc(score, y):
    pos = score[y == 1]
    neg = score[y == 0]
    m, n = len(pos), len(neg)
    psi = (pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :])
    auc = psi.mean()
    v10 = psi.mean(axis=1)
    v01 = psi.mean(axis=0)
    var = ((v10 - auc) ** 2).sum() / ((m - 1) * m) + ((v01 - auc) ** 2).sum() / ((n - 1) * n)
    return auc, var


def _groups(spark, score, y):
    pdf = pd.DataFrame({"score": score, "y": y})
    g = pdf.groupby("score").agg(pos=("y", "sum"), neg=("y", lambda s: (1 - s).sum())).reset_index()
    g["k"] = "f"
    return spark.createDataFrame(g)


def test_grouped_delong_equals_pairwise(spark):
    rng = np.random.default_rng(0)
    score = rng.integers(0, 8, 200).astype(float)
    y = (rng.random(200) < 0.3 + 0.05 * score).astype(int)
    auc, var = _pairwise_auc(score, y)
    for bounded in (True, False):
        r = R.auc_delong(_groups(spark, score, y), ["k"], bounded=bounded).first()
        assert abs(r["auc"] - auc) < 1e-12 and abs(r["var"] - var) < 1e-12


def test_somers_is_2c_minus_1(spark):
    rng = np.random.default_rng(1)
    x = rng.random(5000)
    y = (rng.random(5000) < 1 / (1 + np.exp(-(-3 + 3 * x)))).astype(int)
    v = spark.createDataFrame(pd.DataFrame({"feature": "x", "vnum": x, "vtxt": None, "y": y, "n": 1}),
                              "feature string, vnum double, vtxt string, y int, n long")
    r = R.somers_d(v).first()
    assert abs(r["dxy"] - (2 * r["c_index"] - 1)) < 1e-12 and r["c_index"] > 0.5


def test_bh(spark):
    def adj(ps):
        df = spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "i int, p double")
        return [r["q"] for r in R.bh_adjust(df, "p", "q").orderBy("i").collect()]
    assert abs(adj([0.03])[0] - 0.03) < 1e-12
    assert adj([0.03] + [0.5] * 99)[0] > 0.05
    assert all(abs(q - 0.03) < 1e-12 for q in adj([0.03] * 100))
    assert adj([0.01, None, 0.04])[1] is None


def test_woe_empty_bin_is_finite_and_not_zero(spark):
    cells = spark.createDataFrame([("f", "early", 0, 10, 0, 10), ("f", "early", 1, 10, 10, 0),
                                   ("f", "early", 2, 0, 0, 0)],
                                  "feature string, window string, bin_idx int, n long, pos long, neg long")
    w = {r["bin_idx"]: r for r in W.woe_table(cells).collect()}
    assert all(math.isfinite(r["woe"]) and math.isfinite(r["iv_part"]) for r in w.values())
    # both cells of the empty bin get 0.5: WoE = ln((0.5/SP)/(0.5/SN)) = ln(SN/SP), here 0
    assert abs(w[2]["woe"] - math.log(11.0 / 11.0)) < 1e-12


def test_woe_agreement_reversal(spark):
    rows = []
    early = [(45, 15), (30, 30), (15, 45), (0, 0)]
    late = [(15, 45), (30, 30), (45, 15), (0, 0)]
    for win, tab in (("early", early), ("late", late)):
        for i, (p, n) in enumerate(tab):
            rows.append(("f", win, i, p + n, p, n))
    cells = spark.createDataFrame(rows, "feature string, window string, bin_idx int, n long, pos long, neg long")
    w = W.woe_table(cells)
    a = W.woe_agreement(w.where("window = 'early'"), w.where("window = 'late'")).first()
    assert abs(a["rho"] + 1) < 1e-12


def test_woe_agreement_two_bins(spark):
    rows = [("f", "early", 0, 50, 40, 10), ("f", "early", 1, 50, 10, 40),
            ("f", "late", 0, 50, 10, 40), ("f", "late", 1, 50, 40, 10)]
    cells = spark.createDataFrame(rows, "feature string, window string, bin_idx int, n long, pos long, neg long")
    w = W.woe_table(cells)
    a = W.woe_agreement(w.where("window = 'early'"), w.where("window = 'late'")).first()
    assert a["rho"] is None and abs(a["flip_mass"] - 1.0) < 1e-12


def test_psi_identities():
    a = np.array([[100, 200, 300, 400]], dtype=float)
    assert SH._psi_np(a, a, 1e-6)[0] == 0
    x, y = np.array([[0, 100]], float), np.array([[5, 95]], float)
    assert math.isfinite(SH._psi_np(x, y, 1e-6)[0])
    assert abs(SH._psi_np(x, y, 1e-6)[0] - SH._psi_np(y, x, 1e-6)[0]) < 1e-12


def test_psi_null_matches_brute_force():
    rng = np.random.default_rng(5)
    ref = np.repeat(np.arange(4), [900, 800, 700, 600])
    cur = np.repeat(np.arange(4), [500, 500, 500, 500])
    pooled_rows = np.r_[ref, cur]
    brute = []
    for _ in range(2000):
        p = rng.permutation(pooled_rows)
        brute.append(SH._psi_np(np.bincount(p[:len(ref)], minlength=4)[None].astype(float),
                                np.bincount(p[len(ref):], minlength=4)[None].astype(float), 1e-6)[0])
    pooled = np.bincount(pooled_rows, minlength=4)
    dr = SH.draw_split(pooled, len(ref), 4000, np.random.default_rng(6))
    fast = SH._psi_np(dr.astype(float), (pooled[None] - dr).astype(float), 1e-6)
    for q in (0.5, 0.99):
        assert abs(np.quantile(fast, q) / np.quantile(brute, q) - 1) < 0.25


def test_cramers_v_reference_values():
    assert abs(_v_from_table(np.array([[250., 250.], [250., 250.]]), 2, 2)) < 1e-12
    assert _v_from_table(np.diag([500., 500., 500.]), 3, 3) > 0.99
    sparse = np.array([[20., 2, 1], [3, 15, 2], [1, 2, 4]])
    n = sparse.sum()
    e = np.outer(sparse.sum(1), sparse.sum(0)) / n
    raw = math.sqrt(((sparse - e) ** 2 / e).sum() / n / 2)
    assert _v_from_table(sparse, 3, 3) < raw


def test_correlations_are_pairwise_complete(spark):
    from colvet.functions import columns as C
    rng = np.random.default_rng(9)
    base = rng.normal(size=500)
    pdf = pd.DataFrame({"a": base + 1e6, "b": base + rng.normal(size=500) * 0.1, "c": rng.normal(size=500),
                        "k": np.ones(500)})
    pdf.loc[pdf.index % 7 == 0, "b"] = np.nan
    pdf.loc[pdf.index % 5 == 0, "c"] = np.nan
    df = spark.createDataFrame(pdf).select(*[C.F.when(~C.F.isnan(c), C.F.col(c)).alias(c) for c in pdf.columns])
    got = {(r["a"], r["b"]): r["r"] for r in C.corr_long(df, ["a", "b", "c", "k"]).collect()}
    want = pdf.corr()
    assert set(got) == {("a", "b"), ("a", "c"), ("a", "k"), ("b", "c"), ("b", "k"), ("c", "k")}
    for (x, y), r in got.items():
        if "k" in (x, y):
            assert r is None
        else:
            assert abs(r - want.loc[x, y]) < 1e-9
    one = df.agg(C.safe_corr("a", "b").alias("r")).first()["r"]
    assert abs(one - want.loc["a", "b"]) < 1e-6


def test_hypergeometric_moments_at_any_size():
    from colvet.functions.sampling import hypergeometric, multivariate_hypergeometric
    rng = np.random.default_rng(3)
    for good, bad, n, draws in ((3, 5, 4, 4000), (40, 960, 100, 3000), (1_200_000_000, 800_000_000, 700_000_000, 400)):
        x = hypergeometric(np.full(draws, good), bad, n, rng).astype(float)
        total, p = good + bad, good / (good + bad)
        var = n * p * (1 - p) * (total - n) / (total - 1)
        assert abs(x.mean() - n * p) < 4.5 * math.sqrt(var / draws)
        assert abs(x.var() / var - 1) < 6 / math.sqrt(draws)
    m = multivariate_hypergeometric([10**9, 5 * 10**8, 0, 5 * 10**8], 10**9, 5, rng)
    assert (m.sum(1) == 10**9).all() and (m[:, 2] == 0).all()
    assert hypergeometric(0, 5, 3, rng) == 0 and hypergeometric(5, 0, 3, rng) == 3


def test_pure_probability_keeps_its_precision():
    from colvet.operators.entity import _none_of, _pure_in_leaf
    total, marked = 10**12, 36_500_000_000
    p = 1 - marked / total
    assert abs(_none_of(2, marked, total) + _none_of(2, total - marked, total) - (p * p + (1 - p) ** 2)) < 1e-9
    assert _none_of(5, 8, 10) == 0.0 and _none_of(10**7, 10**9, 10**12) < 1e-300
    rng = np.random.default_rng(1)
    share = _pure_in_leaf(2, 8192, np.full(40, 8192), rng).mean() / 8192
    assert abs(share - 0.5) < 0.01 and _pure_in_leaf(2, 8192, np.zeros(3, int), rng).tolist() == [8192] * 3
    assert _pure_in_leaf(10**9, 1, np.array([0, 5, 10**9]), rng).tolist() == [1, 0, 1]


def test_full_data_ecdf_stats_match_numpy(spark):
    from colvet.operators.shift import _ecdf_stats, ecdf_stats_all
    rng = np.random.default_rng(21)
    a = np.round(rng.normal(size=700), 1)
    b = np.round(rng.normal(0.2, 1, size=500), 1)
    rows = [("x", "early", 0, float(v), 1) for v in a] + [("x", "late", 0, float(v), 1) for v in b]
    vals = spark.createDataFrame(rows, "feature string, window string, y int, vnum double, n long") \
                .withColumn("vtxt", F.lit(None).cast("string"))
    got = ecdf_stats_all(vals, ["x"]).first()
    ad, cvm = _ecdf_stats(a, b)
    assert abs(got["ad_stat_all"] - ad) < 1e-9 * max(1, ad) and abs(got["cvm_stat_all"] - cvm) < 1e-9 * max(1, cvm)
