import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from colvet.operators import binning as B
from colvet.operators import rank as R
from colvet.plans.cumulative import cumulative, order_statistics


def _with_small_buckets(spark, fn):
    spark.conf.set("colvet.cumulative.target_rows", "50")
    spark.conf.set("colvet.cumulative.grid", "64")
    try:
        return fn()
    finally:
        spark.conf.unset("colvet.cumulative.target_rows")
        spark.conf.unset("colvet.cumulative.grid")


def test_bucketed_cumulative_is_exact(spark):
    rng = np.random.default_rng(11)
    rows = []
    for key, n in (("a", 3000), ("b", 40), ("c", 1200)):
        v = np.unique(np.round(rng.normal(size=n) * 100, 2))
        rows += [(key, float(x), int(rng.integers(1, 5))) for x in v]
    pdf = pd.DataFrame(rows, columns=["k", "v", "w"])
    df = spark.createDataFrame(pdf)
    got = _with_small_buckets(spark, lambda: cumulative(df, ["k"], "v", ["w"]).toPandas())
    pdf = pdf.sort_values(["k", "v"])
    pdf["want"] = pdf.groupby("k")["w"].cumsum() - pdf["w"]
    m = got.merge(pdf, on=["k", "v", "w"])
    assert len(m) == len(pdf)
    assert (m["w_below"] == m["want"]).all()
    assert (m["w_total"] == m.groupby("k")["w"].transform("sum")).all()


def test_bucketed_order_statistics_and_auc(spark):
    rng = np.random.default_rng(12)
    x = np.round(rng.normal(size=4000), 3)
    y = (rng.random(4000) < 1 / (1 + np.exp(-x))).astype(int)
    counts = pd.Series(x).value_counts().rename_axis("vnum").reset_index(name="c")
    cdf = spark.createDataFrame(counts.assign(key="f", nonnull=len(x)))

    def run():
        q = B.type7_quantiles(cdf, ["key"], [0.1, 0.5, 0.9]).orderBy("j").toPandas()["q"].tolist()
        g = spark.createDataFrame(pd.DataFrame({"score": x, "y": y}).groupby("score")["y"]
                                  .agg(pos="sum", neg=lambda s: (1 - s).sum()).reset_index().assign(k="f"))
        a = R.auc_delong(g, ["k"], bounded=False).first()["auc"]
        return q, a

    q, a = _with_small_buckets(spark, run)
    np.testing.assert_allclose(q, np.quantile(x, [0.1, 0.5, 0.9]), atol=1e-12)
    pos, neg = x[y == 1], x[y == 0]
    brute = ((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :])).mean()
    assert abs(a - brute) < 1e-12
