import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from colvet.operators import binning as B
from colvet.operators import windows as Wn
from colvet.plans import suffstats as S
from colvet.sources.frames import FrameSpec

from conftest import make_audit


def test_nearest_rank_is_half_even():
    assert Wn.nearest_rank(0.5, 4) == 2      # 1.5 -> 2
    assert Wn.nearest_rank(0.5, 6) == 2      # 2.5 -> 2
    assert Wn.nearest_rank(0.17, 100) == 17


def test_windows_disjoint_and_holdout_closed(spark):
    df = spark.createDataFrame(pd.DataFrame({"t": np.arange(1, 101)}))
    win = Wn.time_windows(df, "t", (0.0, 0.2), (0.8, 1.0))
    fw = Wn.with_window(df, "t", win)
    counts = {r["window"]: r["count"] for r in fw.groupBy("window").count().collect()}
    assert counts["late"] == 21 and counts["early"] == 21 - 1 + 0  # [1, 21) and [80, 100]
    assert fw.where(F.col("t") == 100).count() == 1


def test_overlapping_windows_raise():
    with pytest.raises(ValueError):
        Wn.check_windows((0.0, 0.6), (0.5, 1.0))
    Wn.check_windows((0.0, 0.5), (0.5, 1.0))  # touching is allowed


def test_quantile_nearest_matches_sorted_index(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 50, 1000)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    probs = [0.0, 0.17, 0.5, 0.83, 1.0]
    got = Wn.quantile_nearest(df, "x", probs)
    xs = np.sort(x)
    assert got == [int(xs[int(round(p * (len(xs) - 1)))]) for p in probs]


def _fit(spark, values_pdf, kind="numeric", bins=10, max_levels=20):
    spec = FrameSpec(name="f", numeric=("x",) if kind == "numeric" else (), text=("x",) if kind == "text" else ())
    pdf = values_pdf.assign(y=0, window="early")
    df = spark.createDataFrame(pdf)
    vals = S.values_table(df, spec, ["x"])
    return B.fit(vals, spec, ["x"], bins, max_levels).first(), vals, spec


def test_mass_on_one_value_is_discrete(spark):
    x = np.r_[np.zeros(9600), np.tile(np.arange(1, 13), 34)[:400]].astype(float)
    b, _, _ = _fit(spark, pd.DataFrame({"x": x}))
    assert b["degenerate"] is None and b["kind"] == "discrete"


def test_collapsed_grid_keeps_frequent_values(spark):
    x = np.r_[np.zeros(100), np.full(50, 1e5), np.full(50, 1e-5)] + 0.0
    # 3 distinct values <= bins: one bin per value, no null bin populated
    b, vals, spec = _fit(spark, pd.DataFrame({"x": x}))
    assert b["kind"] == "discrete" and len(b["vals"]) == 3


def test_quantile_grid_matches_type7(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=2000)
    b, _, _ = _fit(spark, pd.DataFrame({"x": x}))
    q = np.quantile(x, [j / 10 for j in range(11)])  # numpy linear == type 7
    assert b["kind"] == "numeric"
    np.testing.assert_allclose(b["edges"][1:-1], q[1:-1], rtol=0, atol=1e-12)
    assert b["edges"][0] == float("-inf") and b["edges"][-1] == float("inf")


def test_levels_other_and_null(spark):
    pdf = pd.DataFrame({"x": ["a"] * 10 + ["b"] * 5 + ["c"] * 2})
    b, vals, spec = _fit(spark, pdf, kind="text", max_levels=2)
    assert b["levels"] == ["a", "b"]
    test = spark.createDataFrame(pd.DataFrame({"x": ["a", "zzz", None], "y": [0, 0, 0], "window": ["late"] * 3}))
    tv = S.values_table(test, spec, ["x"])
    cells = {r["bin_idx"]: r["n"] for r in S.cells_table(tv, B.fit(vals, spec, ["x"], 10, 2)).collect()}
    assert cells == {0: 1, 2: 1, 3: 1}  # a, __other__, __null__


def test_nulls_go_to_last_bin(spark):
    x = np.r_[np.arange(1, 101).astype(float), [np.nan] * 50]
    pdf = pd.DataFrame({"x": x}).assign(y=0, window="early")
    spec = FrameSpec(name="f", numeric=("x",), text=())
    df = spark.createDataFrame(pdf).withColumn("x", F.when(F.isnan("x"), None).otherwise(F.col("x")))
    vals = S.values_table(df, spec, ["x"])
    b = B.fit(vals, spec, ["x"])
    cells = {r["bin_idx"]: r["n"] for r in S.cells_table(vals, b).collect()}
    n_core = b.first()["n_core"]
    assert cells[n_core] == 50 and sum(cells.values()) == 150


def test_binning_independent_of_row_order(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=2000)
    a, _, _ = _fit(spark, pd.DataFrame({"x": x}))
    b, _, _ = _fit(spark, pd.DataFrame({"x": rng.permutation(x)}))
    assert a["edges"] == b["edges"]


def test_collapsed_grid_falls_back_to_top_values(spark):
    # 21 distinct values but every decile is 0: the grid collapses to < 3 edges
    x = np.r_[np.zeros(10000), np.arange(1, 21).astype(float)]
    b, _, _ = _fit(spark, pd.DataFrame({"x": x}), max_levels=20)
    assert b["kind"] == "discrete"
    # 0 (most frequent) then the singles by value: 1..19 kept, 20 goes to __other__
    assert b["vals"] == [0.0] + [float(i) for i in range(1, 20)]
