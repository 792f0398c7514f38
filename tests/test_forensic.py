import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from colvet.functions.columns import wilson
from colvet.operators import forensic as X
from colvet.operators import windows as Wn
from colvet.sources.frames import FrameSpec

SPEC = FrameSpec(name="f", numeric=("value",), text=(), label="y")


def test_bai_perron_finds_planted_breaks():
    rng = np.random.default_rng(0)
    y = np.r_[rng.normal(0.02, 0.003, 60), rng.normal(0.05, 0.003, 60), rng.normal(0.03, 0.003, 60)]
    breaks, m = X.bai_perron_mean(y, 0.1)
    assert m == 2 and abs(breaks[0] - 60) <= 2 and abs(breaks[1] - 120) <= 2
    flat, m0 = X.bai_perron_mean(rng.normal(0.03, 0.003, 180), 0.1)
    assert m0 == 0 and flat == []


def test_bai_perron_has_no_cap_of_its_own():
    rng = np.random.default_rng(4)
    y = np.concatenate([rng.normal(v, 0.002, 30) for v in (0.02, 0.06, 0.03, 0.07, 0.02, 0.05, 0.01, 0.06)])
    breaks, m = X.bai_perron_mean(y, 0.1)
    assert m == 7 and max(abs(b - 30 * (k + 1)) for k, b in enumerate(breaks)) <= 2


def test_rayleigh_uniform_and_concentrated(spark):
    rng = np.random.default_rng(1)
    n = 4000
    uniform_t = rng.integers(0, 86400 * 30, n)
    peaked_t = (rng.integers(0, 30, n) * 86400 + (rng.normal(3, 1, n) % 24) * 3600).astype(int)
    for t, expect_small in ((uniform_t, False), (peaked_t, True)):
        df = spark.createDataFrame(pd.DataFrame({"t": t, "y": 1}))
        r = X.rayleigh(df, FrameSpec(name="r", numeric=(), text=(), label="y")).first()
        assert (r["p_value"] < 0.01) == expect_small
    r = X.rayleigh(spark.createDataFrame(pd.DataFrame({"t": peaked_t, "y": 1})),
                   FrameSpec(name="r", numeric=(), text=(), label="y")).first()
    assert abs(r["peak_hour"] - 3) < 0.3


def test_benford_conforming_amounts(spark):
    rng = np.random.default_rng(2)
    x = 10 ** rng.uniform(0, 5, 20000)  # log-uniform: Benford by construction
    df = spark.createDataFrame(pd.DataFrame({"value": x, "y": 1}))
    rows = {r["digit"]: r for r in X.benford(df, SPEC, "value").collect()}
    assert len(rows) == 9 and rows[1]["mad"] < 0.006
    assert abs(sum(r["observed"] for r in rows.values()) - 1) < 1e-12
    for d, r in rows.items():
        assert abs(r["expected"] - math.log10(1 + 1 / d)) < 1e-15


def test_wilson_closed_form(spark):
    df = spark.createDataFrame([(5, 200), (0, 50), (50, 50)], "k long, n long")
    lo, hi = wilson("k", "n")
    got = [(r["lo"], r["hi"]) for r in df.select(lo.alias("lo"), hi.alias("hi")).collect()]
    z = 1.959963984540054
    for (k, n), (gl, gh) in zip([(5, 200), (0, 50), (50, 50)], got):
        p = k / n
        c = (p + z * z / (2 * n)) / (1 + z * z / n)
        h = z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
        assert abs(gl - max(0, c - h)) < 1e-12 and abs(gh - min(1, c + h)) < 1e-12


def test_split_table_counts_add_up(spark):
    t = np.arange(1, 1001)
    df = spark.createDataFrame(pd.DataFrame({"t": t, "y": t % 3 == 0}).astype({"y": int}))
    rows = {r["segment"]: r for r in Wn.split_table(df, "t", "y").collect()}
    assert sum(r["rows"] for r in rows.values()) == 1000
    # nearest-rank cuts at round(p * 999): 749, 849, 899 (zero-based) -> values 750, 850, 900
    assert rows["train"]["rows"] == 750 and rows["gap"]["rows"] == 100
    assert rows["validation"]["rows"] == 50 and rows["test"]["rows"] == 100


def _direct_power_law(x, xmax):
    v, c = np.unique(x, return_counts=True)
    best = None
    for i in range(len(v) - 1):
        if v[i] > xmax:
            break
        t, k = v[i:], c[i:]
        n, logs = k.sum(), (k * np.log(t / v[i])).sum()
        alpha, upto = 1 + n / logs, np.cumsum(k)
        fit = 1 - (t / v[i]) ** (1 - alpha)
        d = max(np.abs(upto / n - fit).max(), np.abs((upto - k + 1) / n - fit).max())
        if best is None or d < best[3]:
            best = (v[i], alpha, n, d)
    return best


@pytest.mark.parametrize("buckets,at_once", [(4096, 50_000), (7, 3), (1, 20)])
def test_power_law_search_is_exact_whatever_the_buckets(spark, monkeypatch, buckets, at_once):
    monkeypatch.setattr(X, "BUCKETS", buckets)
    monkeypatch.setattr(X, "CANDIDATES_AT_ONCE", at_once)
    spec = FrameSpec(name="p", numeric=("value",), text=(), label="y")
    rng = np.random.default_rng(buckets)
    x = np.round(np.r_[rng.gamma(2, 8, 300), (rng.pareto(1.6, 400) + 1) * 30], 1)
    df = spark.createDataFrame(pd.DataFrame({"y": 1, "value": x})).unionByName(spark.createDataFrame([(0, 1.0), (1, -5.0), (1, 0.0)], "y long, value double"))
    got, want = X.power_law(df, spec, "value", xmax=200.0).first(), _direct_power_law(x[x > 0], 200.0)
    assert (got["xmin"], got["n_tail"]) == (want[0], want[2])
    assert abs(got["alpha"] - want[1]) < 1e-9 and abs(got["ks"] - want[3]) < 1e-12
    distinct = np.unique(x[x > 0])
    assert (got["candidates"], got["above_xmax"]) == ((distinct <= 200).sum(), (distinct > 200).sum())
    assert X.power_law(df.where("y = 0"), spec, "value").collect() == []
    assert X.power_law(df.where("value = 1.0"), spec, "value").collect() == []
