import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from colvet.operators import categorical as C
from colvet.operators import dimensions as DM
from colvet.operators import redundancy as RD
from colvet.operators import shift as SH

from conftest import make_audit


def _frame(spark, cols: dict, n: int):
    t = np.arange(n)
    pdf = pd.DataFrame({"row_id": t, "t": t, "y": t % 2, **cols})
    return make_audit(spark, pdf, numeric=list(cols), train=(0.0, 0.99), holdout=(0.99, 1.0))


def test_spearman_and_clusters(spark):
    rng = np.random.default_rng(0)
    n = 3000
    a = rng.normal(size=n)
    aud = _frame(spark, {"a": a, "copy": -2 * a + 1, "b": a + rng.normal(size=n) * 0.1,
                         "far": rng.normal(size=n)}, n)
    ranks = RD.rank_columns(aud.values, aud.spec.numeric)
    rho = RD.spearman_long(aud.fw, "row_id", ranks)
    m = {(r["a"], r["b"]): r["rho"] for r in rho.collect()}
    assert all(abs(m[(x, x)] - 1) < 1e-12 for x in ("a", "copy", "b", "far"))
    assert abs(m[("a", "b")] - m[("b", "a")]) < 1e-12 and m[("a", "b")] > 0.9
    assert abs(m[("a", "copy")] + 1) < 1e-9
    members, merges = RD.variable_clusters(rho, 0.2)
    g = {r["feature"]: r["cid"] for r in members.collect()}
    assert g["a"] == g["copy"] == g["b"] and g["far"] != g["a"]
    grid = RD.threshold_grid(list(g), merges)
    assert all(row[1] >= 1 for row in grid)


def test_representative_prefers_complete_column(spark):
    groups = spark.createDataFrame([("thin", "1", 2), ("full", "1", 2)], "feature string, group string, size long")
    nulls = spark.createDataFrame([("thin", 0.8), ("full", 0.0)], "feature string, null_rate double")
    iv = spark.createDataFrame([("thin", 0.9), ("full", 0.1)], "feature string, iv double")
    r = RD.representatives(groups, nulls, iv).where("is_representative").first()
    assert r["column"] == "full"
    tie = spark.createDataFrame([("b", 0.0), ("a", 0.0)], "feature string, null_rate double")
    g2 = spark.createDataFrame([("b", "1", 2), ("a", "1", 2)], "feature string, group string, size long")
    assert RD.representatives(g2, tie, None).where("is_representative").first()["column"] == "a"


def test_sum_is_predictable(spark):
    rng = np.random.default_rng(1)
    n = 4000
    x, y = rng.normal(size=n), rng.normal(size=n)
    aud = _frame(spark, {"x": x, "y": y, "s": x + y}, n)
    groups = spark.createDataFrame([("x", "g"), ("y", "g"), ("s", "g")], "feature string, group string")
    r = {row["column"]: row for row in RD.redundancy_within_groups(aud.fw, groups, r2=0.9).collect()}
    flagged = [c for c, row in r.items() if row["predictable"]]
    assert 1 <= len(flagged) < 3


def test_parallel_analysis_counts_factors(spark):
    rng = np.random.default_rng(2)
    n = 3000
    f1, f2 = rng.normal(size=n), rng.normal(size=n)
    one = {f"a{i}": f1 + rng.normal(size=n) * 0.5 for i in range(6)}
    two = {**{f"b{i}": f1 + rng.normal(size=n) * 0.5 for i in range(3)},
           **{f"c{i}": f2 + rng.normal(size=n) * 0.5 for i in range(3)}}
    df = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(n), **one, **two}))
    blocks = spark.createDataFrame([("one", c) for c in one] + [("two", c) for c in two],
                                   "block string, column string")
    r = {row["block"]: row for row in DM.scan(df, blocks, n_iter=30).collect()}
    assert r["one"]["components"] == 1 and r["one"]["variance_first_component"] > 0.7
    assert r["two"]["components"] == 2
    again = {row["block"]: row for row in DM.scan(df.orderBy(F.rand(1)).repartition(7), blocks, n_iter=30).collect()}
    assert {b: x["components"] for b, x in r.items()} == {b: x["components"] for b, x in again.items()}


def test_noise_eigenvalues_follow_column_resampling(spark, monkeypatch):
    monkeypatch.setattr(DM, "BATCH_ROWS", 300)
    rng = np.random.default_rng(6)
    n = 1500
    x = np.exp(rng.normal(size=(n, 1)) + 0.4 * rng.normal(size=(n, 5)))  # skewed and strongly related
    x[:, 4] = (x[:, 4] > 1).astype(float)
    names = [f"x{i}" for i in range(5)]
    df = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(n), **dict(zip(names, x.T))}))
    blocks = spark.createDataFrame([("b", c) for c in names], "block string, column string")
    plan = DM._block_plan(df, blocks)
    got = np.array([r["ev"] for r in DM.noise_eigenvalues(DM.resampled_products(df, plan, "row_id", 150), plan).collect()])
    want = np.array([np.sort(np.linalg.eigvalsh(np.corrcoef(
        np.column_stack([c[rng.integers(0, n, n)] for c in x.T]).T)))[::-1] for _ in range(150)])
    assert got.shape == want.shape
    assert np.allclose(got.mean(0), want.mean(0), atol=0.01) and np.allclose(np.quantile(got, 0.95, 0), np.quantile(want, 0.95, 0), atol=0.02)
    assert np.corrcoef(x.T)[0, 1] > 0.5 and got[:, 0].max() < 1.3


def test_binary_columns_are_found_in_any_type(spark):
    rows = [(i % 2, "yes" if i % 3 else "no", i % 2 == 0, i, 1.0, None if i % 5 == 0 else float(i % 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "a int, b string, c boolean, d int, e double, f double")
    two = DM.binary_columns(df, ["a", "b", "c", "d", "e", "f", "absent"])
    assert two.columns == ["a", "b", "c", "f"]
    assert [tuple(r) for r in two.limit(2).collect()] == [(0, 0, 1, None), (1, 1, 0, 1)]
    s = DM.tetrachoric_summary(df, ["a", "b", "c", "d", "e"]).first()
    pairs = DM.tetrachoric_pairs(two.select("a", "b", "c"), ["a", "b", "c"]).toPandas()
    assert s["columns"] == 3 and abs(s["mean_off_diagonal"] - pairs["tetrachoric"].abs().mean()) < 1e-12
    assert DM.tetrachoric_summary(df, ["d", "e", "a"]).first()["note"] == "fewer than two binary columns"


def test_tetrachoric_exceeds_pearson(spark):
    rng = np.random.default_rng(3)
    z = rng.multivariate_normal([0, 0], [[1, 0.6], [0.6, 1]], 5000)
    df = spark.createDataFrame(pd.DataFrame({"u": (z[:, 0] > 0.3).astype(int), "v": (z[:, 1] > -0.5).astype(int)}))
    r = DM.tetrachoric_pairs(df, ["u", "v"]).first()
    assert r["tetrachoric"] > r["pearson"] and abs(r["tetrachoric"] - 0.6) < 0.06


def test_energy_test_null_and_shift(spark):
    rng = np.random.default_rng(4)

    def run(shift):
        n = 3000
        a = rng.normal(size=(2 * n, 2))
        a[n:] += shift
        t = np.arange(2 * n)
        aud = _frame(spark, {"p": a[:, 0], "q": a[:, 1]}, 2 * n)
        aud = make_audit(spark, pd.DataFrame({"row_id": t, "t": t, "y": t % 2, "p": a[:, 0], "q": a[:, 1]}),
                         numeric=["p", "q"], train=(0.0, 0.5), holdout=(0.5, 1.0))
        return SH.energy_test(aud.fw, ["p", "q"], "row_id", perms=99).first()["p_value"]

    assert run(0.0) > 0.05
    assert run(0.3) < 0.05


def test_period_marker_knows_period_better(spark):
    rng = np.random.default_rng(5)
    n = 4000
    t = np.arange(n)
    late = t >= n // 2
    marker = np.where(late, "new", "old")
    signal = np.where(rng.random(n) < 0.5, "s1", "s2")
    y = ((signal == "s1") & (rng.random(n) < 0.6) | (rng.random(n) < 0.05)).astype(int)
    pdf = pd.DataFrame({"row_id": t, "t": t, "y": y, "marker": marker, "signal": signal})
    aud = make_audit(spark, pdf, text=["marker", "signal"], train=(0.0, 0.5), holdout=(0.5, 1.0))
    r = {row["column"]: row for row in C.scan(aud).collect()}
    assert r["marker"]["knows_period_better"] and not r["signal"]["knows_period_better"]
