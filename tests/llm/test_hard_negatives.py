"""Hard-negative mining against all scores in exact integers."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from colvet.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, block string, tile string, score string, anchor string"


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x", "y", "z", "w") for i, v, lab in rows], SCHEMA)


def brute(rows, step):
    kept = set()
    for i, v, lab in rows:
        if i is None or lab is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = tuple(math.floor(256 * Fraction(x)) for x in v)
        if len(q) * max(map(abs, q), default=0) ** 2 <= 2**62:
            kept.add((i, lab, q))
    out = []
    for i, lab, q in kept:
        if i % step:
            continue
        near = sorted((-sum(a * b for a, b in zip(q, w)), j, k) for j, k, w in kept if j != i and len(w) == len(q))
        for s, j, _ in [x for x in near if x[2] == lab][:5]:
            fits = [(-t, n) for t, n, k in near if k != lab and 80 * -s <= 100 * -t <= 100 * -s]
            out += [(i, j, r + 1, n, -s, t) for r, (t, n) in enumerate(fits[:5])]
    return sorted(out)


def collected(df):
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in df.collect())


def planted(rng, n=400, dim=6):
    rows = []
    centres = rng.normal(size=(6, dim))
    for i in range(n):
        c = int(rng.integers(0, 6))
        rows.append((i, [float(x) for x in centres[c] + rng.normal(size=dim) * 0.3], c // 2 if rng.random() < 0.9 else 7))
    rows += [(1000 + i, [float(x) for x in np.round(rng.normal(size=3))], int(rng.integers(0, 2))) for i in range(80)]  # many ties
    rows += [(2000, [], 0), (2010, [], 0), (2020, [], 1), (2030, None, 1), (2040, [1.0, None, 0.0], 1), (2050, [float("nan"), 1.0, 1.0], 0),
             (2060, [float("inf"), 1.0, 1.0], 0), (2070, [1e308, 1.0, 1.0], 0), (None, [1.0, 1.0, 1.0], 0), (2080, [1.0, 1.0, 1.0], None),
             (2090, [1e6, 1e6, 2e6], 0), (2100, [3e6, 1.0, 2e6], 0), (2110, [2e6, 1e6, 1e6], 1), (2120, [0.0] * 3, 0), (2130, [0.0] * 3, 1)]
    rows += [rows[20]] * 3 + [(30, [0.5] * dim, 1), (30, [0.25] * dim, 2)]
    return rows


@pytest.mark.parametrize("block,tile,span,page", [(512, 4096, 64, 2048), (7, 9, 2, 3)])
def test_mining_equals_all_scores(spark, monkeypatch, block, tile, span, page):
    for name, value in (("BLOCK", block), ("TILE", tile), ("SPAN", span), ("PAGE", page)):
        monkeypatch.setattr(hn, name, value)
    rows = planted(np.random.default_rng(block))
    want = brute(rows, 10)
    assert len(want) > 300
    assert collected(hn.mine(frame(spark, rows), F.col("vec_id") % 10 == 0)) == want


def test_few_rows_one_label_and_empty_table(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (2, [0.8, 0.0], 2), (3, [-1.0, 0.0], 2)]
    by_id = F.col("vec_id") % 100 == 0
    assert collected(hn.mine(frame(spark, rows), by_id)) == brute(rows, 100) != []
    assert hn.mine(frame(spark, rows[:2]), by_id).collect() == []
    assert hn.mine(frame(spark, rows).limit(0), by_id).collect() == []


def test_relabelling(spark):
    rows = [(7, [1.0], 9), (8, [1.0], 9), (14, [1.0], 0), (None, [1.0], 3), (21, [1.0], None)]
    got = {(r["vec_id"], r["label"]) for r in hn.relabelled(frame(spark, rows)).collect()}
    assert got == {(7, 0), (8, 9), (14, 1), (None, 3), (21, None)}


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (5, 2)])
def test_the_curve_visits_neighbours_in_turn(dims, bits):
    cells = np.stack([g.ravel() for g in np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij")], 1)
    key = hn.hilbert(cells, bits)
    assert sorted(key) == list(range(len(cells)))
    path = cells[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_bounds_hold_and_skip_blocks():
    rng = np.random.default_rng(1)
    for scale in (200, 10**8):
        a, x = rng.integers(-scale, scale, (20, 9)), rng.integers(-scale, scale, (60, 9))
        least, most = hn.bounds(a, x.min(0)[None], x.max(0)[None])
        s = hn.products(a, x)
        assert (s == np.array([[sum(int(p) * int(q) for p, q in zip(u, v)) for v in x] for u in a])).all()
        assert (least <= s.min(1)[:, None]).all() and (most >= s.max(1)[:, None]).all()


def test_clustered_rows_need_few_blocks(spark, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK", 20)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 8)) * 3
    rows = [(i, [float(v) for v in centres[i % 20] + rng.normal(size=8) * 0.05], (i % 20) // 4) for i in range(2000)]
    read = []
    scan = hn._scan
    monkeypatch.setattr(hn, "_scan", lambda tiles, blocks, needs, k, same: read.append((needs.count(), blocks.count())) or scan(
        tiles, blocks, needs, k, same))
    monkeypatch.setattr(hn, "TILE", 1)
    got = collected(hn.mine(frame(spark, rows), F.col("vec_id") % 400 == 0))
    assert got == brute(rows, 400)
    needed, all_blocks = read[1]
    assert needed < 5 * all_blocks / 3
