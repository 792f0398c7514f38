"""Frames of any table, true / false columns, and the audit frame on disk."""
import datetime as dt
import decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from colvet.operators import categorical as C
from colvet.operators import contract as CT
from colvet.operators import derive as DV
from colvet.operators import missingness as M
from colvet.operators import tc as TC
from colvet.plans.pipeline import prepare_table
from colvet.sources import audit_store as ST
from colvet.sources.frames import ORDERS_SPEC, audit_frame, orders_table

SMOKE = "/root/testdata/sf0.001"


def test_the_orders_spec_is_what_the_schema_gives(spark):
    _, spec = audit_frame(orders_table(spark, SMOKE), "o_orderstatus", "o_orderdate", exclude=("c_custkey", "c_name", "not there"),
                          positive="F", id="o_orderkey", segment="c_mktsegment", entity="o_custkey", name="orders")
    assert spec == ORDERS_SPEC


def _table(spark, n=4000):
    rng = np.random.default_rng(5)
    day = np.arange(n) // 40
    flag = rng.random(n) < 0.5
    bad = rng.random(n) < np.where(flag, 0.6, 0.2)
    pdf = pd.DataFrame({"when": [dt.date(2024, 1, 1) + dt.timedelta(int(d)) for d in day], "bad": bad, "flag": flag,
                        "t": rng.random(n), "kind": rng.choice(["a", "b"], n), "whole": rng.integers(0, 9, n)})
    df = spark.createDataFrame(pdf)
    return df.withColumn("flag", F.when(F.col("t") < 0.9, F.col("flag"))).withColumn("tags", F.array("kind"))


def test_parts_come_from_the_schema(spark):
    frame, spec = audit_frame(_table(spark), "bad", "when")
    assert spec.numeric == ("flag", "t", "whole") and spec.logical == ("flag",) and spec.text == ("kind",)
    assert spec.time == "_t" and spec.raw_time == "when" and spec.measured == ("t", "whole")
    assert frame.select(F.min("_t")).first()[0] == 1704067200


def test_dates_filter_the_scan(spark, tmp_path):
    _table(spark).write.parquet(str(tmp_path / "x"))
    a = prepare_table(spark.read.parquet(str(tmp_path / "x")), "bad", "when", train=(0.0, 0.5), holdout=(0.5, 1.0))
    plan = a.fw._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters"):]
    assert "GreaterThanOrEqual(when,2024-01-01),LessThan(when," in pushed  # the text is cut before the late window
    got = {r["window"]: r["n"] for r in a.fw.groupBy("window").agg(F.count("*").alias("n")).collect()}
    # the edge is the date of rank round(0.5 * 3999) = 2000, day 50: 2,000 rows lie before it
    assert got == {"early": 2000, "late": 2000}


def test_true_false_columns_through_the_audits(spark):
    a = prepare_table(_table(spark), "bad", "when", train=(0.0, 0.5), holdout=(0.5, 1.0))
    early = a.fw.where("window = 'early'").toPandas()
    seen = early[early.flag.notna()]
    hit = seen.flag.astype(bool)
    p, q = seen.y[hit].to_numpy(), seen.y[~hit].to_numpy()
    # Somers' D of a 0 / 1 column is the difference of its rates over label pairs: 2 AUC - 1
    tp, fp = hit[seen.y == 1].mean(), hit[seen.y == 0].mean()
    r = TC.scan(a).where("feature = 'flag'").first()
    assert r["verdict"] == "pass" and abs(r["dxy_train"] - (tp - fp)) < 1e-4
    cont = {(x["a"], x["b"]): x["n"] for x in C.contingency(a.values, a.spec.categorical).where("feature = 'flag' and target = 'label'").collect()}
    assert cont == {("TRUE", "1"): p.sum(), ("TRUE", "0"): (1 - p).sum(), ("FALSE", "1"): q.sum(), ("FALSE", "0"): (1 - q).sum(),
                    ("__null__", "1"): early.y[early.flag.isna()].sum(), ("__null__", "0"): (1 - early.y[early.flag.isna()]).sum()}
    scanned = {x["column"] for x in C.scan(a).collect()}
    assert scanned == {"kind", "flag"}
    want = {"flag": "bool", "t": "float", "whole": "int", "kind": "str"}
    for declared in (CT.declare(a.values, a.spec, {}), CT.declare_rows(a.fw, a.spec, {})):
        assert {x["name"]: x["dtype"] for x in declared.collect()} == want
    # numbers are reference columns of the missingness test, true / false columns are not
    refs = {x["feature"] for x in M.reference_columns(a.values, a.spec.measured).collect()}
    assert "flag" not in refs and "t" in refs


def test_defined_results_of_odd_tables(spark):
    rows = [(1, 1.0, None, 2.0), (None, 2.0, "x", None), (0, float("nan"), "y", 3.0), (0, 4.0, None, float("nan"))]
    df = spark.createDataFrame(rows, "y int, at double, s string, v double")
    frame, spec = audit_frame(df, "y", "at")
    got = [tuple(r) for r in frame.select(spec.label, spec.time, "s", "v").orderBy(spec.time).collect()]
    assert got == [(1, 1.0, None, 2.0), (0, 4.0, None, None)]  # no label, no time: left out; NaN is null
    assert audit_frame(df.limit(0), "y", "at")[0].count() == 0
    with pytest.raises(ValueError):
        audit_frame(df, "s", "at")
    with pytest.raises(ValueError):
        audit_frame(df, "y", "gone")
    with pytest.raises(ValueError):
        audit_frame(df.withColumnRenamed("v", "window"), "y", "at")
    with pytest.raises(Exception, match="besides 0 and 1"):
        audit_frame(df.withColumn("y", F.lit(7)), "y", "at")[0].collect()
    assert audit_frame(df, "s", "at", positive="x")[1].text == ()
    wide = df.select("y", "at", F.col("v").cast("decimal(9,2)").alias("d"))
    assert audit_frame(wide.where("at = 1"), "y", "at")[0].first()["d"] == decimal.Decimal("2.00")


def _stored(spark, tmp_path, n=5000, files=7):
    rng = np.random.default_rng(8)
    t = np.where(rng.random(n) < 0.34, 500, rng.integers(0, 1000, n))  # one time holds a third of the rows
    pdf = pd.DataFrame({"row_id": np.arange(n), "t": t, "lv": rng.choice(list("abcdef"), n), "x": rng.random(n)})
    df = spark.createDataFrame(pdf).withColumn("x", F.when(F.col("x") > 0.3, F.col("x")))
    df = df.withColumn("t", F.when(F.col("row_id") % 50 > 0, F.col("t")))
    built = ST.build(df, [DV.Derivation("lv_freq", "frequency_encode", ("lv",)), DV.Derivation("lv_is_a", "one_hot", ("lv",), {"level": "a"})], ("x", "lv"))
    return built, ST.write(built, str(tmp_path / "frame"), rows_per_file=400)


def test_manifest_tells_what_the_files_hold(spark, tmp_path):
    built, path = _stored(spark, tmp_path)
    whole = built.frame.toPandas()
    back = spark.read.parquet(f"{path}/data").toPandas()
    key = ["row_id", "t", "lv", "x", "null_count", "lv_freq", "lv_is_a"]
    pd.testing.assert_frame_equal(back[key].sort_values("row_id", ignore_index=True), whole[key].sort_values("row_id", ignore_index=True))
    m = [r for r in ST.read_manifest(spark, path).orderBy("first", "last").collect() if r["timed_rows"]]
    assert len(m) > 10 and max(r["rows"] for r in m) <= 400
    assert all(a["last"] <= b["first"] for a, b in zip(m, m[1:]))  # consecutive times, ends may be shared
    nulls = {r["column"]: (r["rows"], r["nulls"]) for r in ST.column_nulls(spark, path).collect()}
    assert nulls == {c: (len(whole), int(whole[c].isna().sum())) for c in whole.columns}


@pytest.mark.parametrize("train, holdout", [((0.0, 0.17), (0.83, 1.0)), ((0.1, 0.5), (0.5, 0.6)), ((0.0, 0.5), (0.5, 1.0))])
def test_window_reader_prunes_files_and_loses_no_row(spark, tmp_path, train, holdout):
    from colvet.operators.windows import time_windows, with_window
    built, path = _stored(spark, tmp_path)
    rows, win, used = ST.read_window(spark, path, train=train, holdout=holdout)
    want = time_windows(built.frame, "t", train, holdout)
    assert win.edges == want.edges
    plain = with_window(built.frame, "t", want)
    cols = ["row_id", "window", "null_count", "lv_freq"]
    assert sorted(map(tuple, rows.select(cols).collect()), key=str) == sorted(map(tuple, plain.select(cols).collect()), key=str)
    files = ST.read_manifest(spark, path).count()
    everything = train[0] == 0.0 and train[1] == holdout[0] and holdout[1] == 1.0
    assert len(used) == files if everything else len(used) < files


def test_digest_follows_the_map_and_not_its_order(spark):
    a = spark.createDataFrame([("c", "x", 3), ("c", "y", 2)], "column string, level string, n long")
    b = spark.createDataFrame([("c", "y", 2), ("c", "x", 3)], "column string, level string, n long")
    other = spark.createDataFrame([("c", "x", 2), ("c", "y", 3)], "column string, level string, n long")
    d = [ST.map_digests(m).first() for m in (a, b, other)]
    assert d[0] == d[1] and d[0]["digest"] != d[2]["digest"] and d[0]["levels"] == 2 and d[0]["rows"] == 5
