import os
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMOKE = "/root/testdata/sf0.001"


def test_entry_runs_and_oracles_are_registered(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert set(df.columns) >= {"feature", "window", "bin_idx", "woe", "iv_part"}
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("key", ["ds_psi", "qd_base_rate", "en_groups", "cat_cramers_v", "sq_cmh"])
def test_query_matches_oracle_on_smoke_data(spark, key):
    import duckdb
    import __spark_entry__ as E
    con = duckdb.connect()
    for t in ("nation", "customer", "supplier", "events", "lineitem", "orders", "part", "documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    got = E.queries()[key](spark, SMOKE).toPandas()
    want = con.execute(E.oracle_sql()[key]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)

    def norm(df):
        rows = [tuple(None if (v is None or (isinstance(v, float) and np.isnan(v)) or v is pd.NA) else
                      (round(float(v), 6) if isinstance(v, (float, np.floating)) else v) for v in r)
                for r in df[cols].itertuples(index=False)]
        return sorted(rows, key=lambda r: tuple(str(x) for x in r))
    assert norm(got) == norm(want)


def test_power_law_matches_direct_search(spark):
    from colvet.operators.forensic import power_law
    from colvet.sources.frames import FrameSpec
    rng = np.random.default_rng(3)
    x = np.round((rng.pareto(2.5, 600) + 1) * 10, 2)
    df = spark.createDataFrame(pd.DataFrame({"y": 1, "value": x}))
    spec = FrameSpec(name="p", numeric=("value",), text=(), label="y")
    got = power_law(df, spec, "value").first()
    v, c = np.unique(x, return_counts=True)
    best = None
    for i in range(len(v) - 1):
        tail = np.repeat(v[i:], c[i:])
        n = len(tail)
        alpha = 1 + n / np.log(tail / v[i]).sum()
        ecdf = np.arange(1, n + 1) / n
        fit = 1 - (tail / v[i]) ** (1 - alpha)
        d = np.max(np.abs(ecdf - fit))
        # ties: the empirical step at a repeated value is evaluated at both ends
        if best is None or d < best[0] - 1e-12:
            best = (d, v[i], alpha, n)
    assert got["xmin"] == best[1] and abs(got["alpha"] - best[2]) < 1e-9 and got["n_tail"] == best[3]


def test_results_do_not_depend_on_session_time_zone(spark):
    import __spark_entry__ as E
    keys = ("flt_quantile_nearest", "fx_hour_profile", "src_parquet_window")

    def run():
        return {k: sorted(map(tuple, E.queries()[k](spark, SMOKE).collect()), key=str) for k in keys}

    before = run()
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        after = run()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert before == after


def test_workers_import_the_package_from_any_folder(spark, tmp_path, monkeypatch):
    import __spark_entry__ as E
    monkeypatch.chdir(tmp_path)
    assert E.queries()["ds_psi_null"](spark, SMOKE).count() > 0
