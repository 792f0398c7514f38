"""Cases that once gave wrong answers: text members, dead members, large means."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def _frame(spark, pdf):
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), schema=", ".join(
        f"{c} {'string' if t == object else 'double'}" for c, t in pdf.dtypes.items()))


def test_mcar_family_with_a_text_member(spark):
    from colvet.operators import missingness as M
    rng = np.random.default_rng(2)
    n = 400
    pdf = pd.DataFrame({"x": rng.normal(size=n), "t": ["a"] * n, "u": ["b"] * n, "r": rng.normal(size=n)})
    gone = rng.random(n) < 0.3
    pdf.loc[gone, ["x", "t", "u"]] = np.nan
    fams = spark.createDataFrame([(int(gone.sum()), 0, "t"), (int(gone.sum()), 1, "x"), (7, 2, "u")],
                                 "null_count long, position int, feature string")
    got = {r["null_count"]: r for r in M.mcar_test(_frame(spark, pdf), fams, ["r"]).collect()}
    assert got[7]["note"] == "no numeric columns in the family" and got[7]["mcar_p"] is None
    assert got[int(gone.sum())]["note"] == "" and 0 <= got[int(gone.sum())]["mcar_p"] <= 1


def test_redundancy_ignores_dead_members_and_large_means(spark):
    from colvet.operators.redundancy import redundancy_within_groups
    rng = np.random.default_rng(5)
    n = 1500
    a = rng.normal(size=n)
    pdf = pd.DataFrame({"window": ["early"] * n, "a": a + 1.7e9, "b": a + rng.normal(size=n) * 0.05, "dead": np.nan, "flat": 3.0})
    wide = {f"w{i:02d}": a * (i + 1) + rng.normal(size=n) * 2 for i in range(40)}
    pdf = pd.concat([pdf, pd.DataFrame(wide)], axis=1)
    groups = spark.createDataFrame([("g", c) for c in ("a", "b", "dead", "flat")] + [("h", c) for c in wide], "`group` string, feature string")
    got = {r["column"]: r for r in redundancy_within_groups(_frame(spark, pdf), groups, 0.9).collect()}
    assert got["dead"]["note"] == got["flat"]["note"] == "not enough usable columns"
    assert got["a"]["predictable"] or got["b"]["predictable"]
    assert all(r["r2"] is None or r["r2"] <= 1.0 + 1e-9 for r in got.values())
    assert sum(c.startswith("w") and r["predictable"] is not None for c, r in got.items()) == 40


def test_no_cartesian_product_in_the_frequency_maps(spark):
    import __spark_entry__ as E
    for key in ("fq_fit", "fq_summary", "prj_freq_encode"):
        plan = E.queries()[key](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan, key
