"""Permutation tests over whole tables against plain permutations of small ones."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from colvet.functions.permutation import position
from colvet.functions.sampling import hypergeometric, log_hypergeometric
from colvet.operators import entity as E
from colvet.operators import shift as SH
from colvet.plans import dealing


@pytest.mark.parametrize("good,bad,n", [(5, 7, 4), (30, 50, 40), (1, 9, 3), (400, 3, 200)])
def test_probabilities_and_draws_are_exact(good, bad, n):
    k = np.arange(max(0, n - bad), min(good, n) + 1)
    exact = np.array([math.comb(good, int(x)) * math.comb(bad, n - int(x)) / math.comb(good + bad, n) for x in k])
    assert np.allclose(np.exp(log_hypergeometric(k, good, bad, n)), exact, rtol=1e-12)
    assert np.isneginf(log_hypergeometric(k[-1] + 1, good, bad, n))
    many = 200_000
    seen = np.bincount(hypergeometric(np.full(many, good), bad, n, np.random.default_rng(7)), minlength=k[-1] + 1)[k]
    big = exact * many > 5
    chi2 = ((seen - exact * many) ** 2 / (exact * many))[big].sum()
    assert chi2 < big.sum() + 5 * math.sqrt(2 * big.sum())


def test_draws_keep_their_shape_at_1e15():
    total = 10**15
    x = hypergeometric(np.full(4000, 3 * total // 10), 7 * total // 10, 4 * total // 10, np.random.default_rng(2)).astype(float)
    mean, sd = 0.12 * total, math.sqrt(0.4 * total * 0.3 * 0.7 * 0.6)
    assert abs(x.mean() - mean) < 5 * sd / math.sqrt(4000) and abs(x.std() / sd - 1) < 0.06


@pytest.mark.parametrize("n", [1, 2, 3, 64, 1000, 4097])
def test_keyed_positions_permute(n):
    rows = np.arange(n)
    a, b = position(rows, n, 11), position(rows, n, 12)
    assert sorted(a) == sorted(b) == list(rows)
    assert n < 100 or (a != b).mean() > 0.9
    hits = np.mean([position(rows[:1], n, key)[0] for key in range(2000)])
    assert abs(hits - (n - 1) / 2) < 5 * max(n, 1) / math.sqrt(12 * 2000)


def test_dealt_rows_add_up_and_are_hypergeometric(spark, monkeypatch):
    monkeypatch.setattr(dealing, "FAN_BITS", 2)
    sizes = {"a": [5, 0, 7, 100, 1, 1, 30, 8, 8, 40], "b": [10], "c": [3, 3]}
    marked = {"a": 60, "b": 4, "c": 0}
    leaves = spark.createDataFrame([(k, 3 * i, r) for k, v in sizes.items() for i, r in enumerate(v)], "feature string, leaf long, rows long")
    got = dealing.deal(leaves, spark.createDataFrame(list(marked.items()), "feature string, marked long"), 3000, 5).toPandas()
    for k, v in sizes.items():
        g = got[got["feature"] == k].sort_values("leaf")
        assert g["leaf"].tolist() == [3 * i for i in range(len(v))]
        x, before = np.array(g["got"].tolist()), np.array(g["before"].tolist())
        assert (x.sum(0) == marked[k]).all() and (before == np.cumsum(x, 0) - x).all()
        assert (x >= 0).all() and (x <= np.array(v)[:, None]).all()
        want = np.array(v) * marked[k] / sum(v)
        sd = np.sqrt(want * (1 - marked[k] / sum(v)) + 1e-9)
        assert (np.abs(x.mean(1) - want) < 5 * sd / math.sqrt(3000) + 1e-9).all()
    assert dealing.deal(leaves.limit(0), spark.createDataFrame([], "feature string, marked long"), 5).count() == 0


def _values(spark, early, late):
    rows = [(f, w, float(x) if x == x else None, None, 0, 1) for f in early for w, xs in (("early", early[f]), ("late", late[f])) for x in xs]
    return (spark.createDataFrame(rows, "feature string, window string, vnum double, vtxt string, y int, one int")
                 .groupBy("feature", "window", "y", "vnum", "vtxt").agg(F.count(F.lit(1)).alias("n")))


def test_marginal_tests_equal_plain_permutations(spark, monkeypatch):
    monkeypatch.setattr(SH, "LEAF_ROWS", 16)
    monkeypatch.setattr(dealing, "FAN_BITS", 2)
    rng = np.random.default_rng(9)
    early = {"same": rng.normal(size=120), "moved": rng.normal(size=120), "heavy": rng.integers(0, 4, 120), "few": rng.normal(size=20),
             "two": rng.integers(0, 2, 120), "gaps": np.where(rng.random(120) < 0.3, np.nan, rng.normal(size=120))}
    late = {"same": rng.normal(size=80), "moved": rng.normal(size=80) + 0.35, "heavy": rng.integers(0, 4, 80), "few": rng.normal(size=80),
            "two": rng.integers(0, 2, 80), "gaps": rng.normal(size=80) + 0.2}
    got = {r["column"]: r for r in SH.marginal_tests(_values(spark, early, late), list(early), nboot=1500).collect()}
    assert got["few"]["ad_p"] is None and got["two"]["cvm_p"] is None and got["few"]["ad_stat"] is None
    for f in ("same", "moved", "heavy", "gaps"):
        a, b = (np.asarray(x[f], float) for x in (early, late))
        a, b = a[~np.isnan(a)], b[~np.isnan(b)]
        ad, cvm = SH._ecdf_stats(a, b)
        pool = np.r_[a, b]
        null = np.array([SH._ecdf_stats(p[:len(a)], p[len(a):]) for p in (rng.permutation(pool) for _ in range(1500))])
        r = got[f]
        assert (r["n_ref"], r["n_cur"]) == (len(a), len(b))
        assert abs(r["ad_stat"] - ad) < 1e-9 and abs(r["cvm_stat"] - cvm) < 1e-9
        for name, stat, x in (("ad_p", ad, null[:, 0]), ("cvm_p", cvm, null[:, 1])):
            p = (x >= stat * (1 - 1e-12)).mean()
            assert abs(r[name] - p) < 5 * math.sqrt(2 * max(p * (1 - p), 0.005) / 1500)
        wins = (b[:, None] > a[None, :]).sum() + 0.5 * (b[:, None] == a[None, :]).sum()
        assert abs(r["cliffs_delta"] - (2 * wins / (len(a) * len(b)) - 1)) < 1e-9


def _pairs(a, b):
    d = lambda x, y: np.sqrt(((x[:, None] - y[None, :]) ** 2).sum(-1)).mean()
    n, m = len(a), len(b)
    return n * m / (n + m) * (2 * d(a, b) - d(a, a) - d(b, b))


def _frame(spark, early, late):
    rows = [(i, "early" if i < len(early) else "late", *map(float, v)) for i, v in enumerate(np.vstack([early, late]))]
    names = ", ".join(f"c{k} double" for k in range(early.shape[1]))
    return spark.createDataFrame(rows, f"row_id long, window string, {names}")


def test_energy_in_one_dimension_is_the_pair_form(spark, monkeypatch):
    monkeypatch.setattr(SH, "RUN_ROWS", 17)
    rng = np.random.default_rng(1)
    a, b = np.round(rng.normal(size=(90, 1)), 1), np.round(rng.normal(size=(70, 1)) + 0.2, 1)
    scale = a.std(ddof=1)
    r = SH.energy_test(_frame(spark, a, b), ["c0"], "row_id", perms=400).first()
    assert abs(r["statistic"] - _pairs(a / scale, b / scale)) < 1e-9
    pool = np.vstack([a, b]) / scale
    null = [_pairs(p[:90], p[90:]) for p in (rng.permutation(pool) for _ in range(400))]
    p = np.mean(np.array(null) >= r["statistic"])
    assert abs(r["p_value"] - p) < 5 * math.sqrt(2 * max(p * (1 - p), 0.01) / 400)


def test_sliced_energy_estimates_the_pair_form_and_ignores_row_order(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(150, 3)), rng.normal(size=(120, 3)) + 0.4
    df = _frame(spark, a, b)
    r = SH.energy_test(df, ["c0", "c1", "c2"], "row_id", many=400, perms=19).first()
    scale = a.std(axis=0, ddof=1)
    assert abs(r["statistic"] / _pairs(a / scale, b / scale) - 1) < 0.1 and r["p_value"] == 0.05
    again = SH.energy_test(df.orderBy(F.rand(3)).repartition(5), ["c0", "c1", "c2"], "row_id", many=400, perms=19).first()
    assert abs(again["statistic"] - r["statistic"]) < 1e-9 and again["p_value"] == r["p_value"]


def test_purity_of_every_key_at_once(spark, monkeypatch):
    monkeypatch.setattr(E, "LEAF_ROWS", 12)
    rng = np.random.default_rng(4)
    keys = {"pure": np.repeat(np.arange(40), 3), "mixed": rng.integers(0, 25, 120), "alone": np.arange(120), "one": np.zeros(120, int)}
    y = np.repeat(rng.random(40) < 0.3, 3).astype(int)
    per = pd.concat([pd.DataFrame({"u": u, "y": y}).groupby("u")["y"].agg(n="size", pos="sum").assign(candidate=c) for c, u in keys.items()])
    g = spark.createDataFrame(per[["candidate", "n", "pos"]].astype({"n": int, "pos": int}))
    draws = E.purity_null_draws(g, 800, 3).toPandas()
    for c in ("pure", "mixed", "one"):
        null = []
        for _ in range(800):
            s = pd.DataFrame({"u": keys[c], "y": rng.permutation(y)}).groupby("u")["y"].agg(["size", "sum"])
            s = s[s["size"] > 1]
            null.append(((s["sum"] == 0) | (s["sum"] == s["size"])).mean())
        mine = draws[draws["candidate"] == c]["share"]
        assert len(mine) == 800
        assert abs(mine.mean() - np.mean(null)) < 5 * np.std(null) / math.sqrt(400) + 1e-9
        assert abs(mine.std() - np.std(null)) < 0.2 * np.std(null) + 1e-9
    p = {r["candidate"]: r for r in E.purity_p_values(g, 200, 3).collect()}
    assert p["pure"]["p_value"] < 0.01 and p["mixed"]["p_value"] > 0.01 and "alone" not in p
