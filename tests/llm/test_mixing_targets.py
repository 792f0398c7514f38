"""Sources of few documents come near their targets, whatever their longest document."""

import numpy as np
import pytest

from colvet.llm import mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string"


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("share", [1e-3, 0.1])
def test_fifty_documents_a_source_one_of_them_a_quarter(spark, monkeypatch, share):
    monkeypatch.setattr(mixing, "HEAVY", share)
    rng = np.random.default_rng(3)
    rows, size = [], {}
    for k in range(12):
        n = rng.integers(5, 60, 50)
        n[0] = n[1:].sum() // 3
        for i, w in enumerate(n):
            rows.append((1000 * k + i, "w " * int(w), None, f"s{k:02}", None, "x"))
        size[f"s{k:02}"] = int(n.sum())
    got = mixing.shares(mixing.allocate(spark.createDataFrame(rows, DOCS))).collect()
    goal = mixing.targets(list(size.items()))
    for s in size:
        own = [r for r in got if r["source"] == s]
        assert len(own) == 50
        miss = abs(sum(r["taken"] for r in own) - goal[s])
        assert miss <= (5 + min(r["size"] for r in own) if share < 0.01 else 60)
    assert all(r["taken"] <= 3 * r["size"] for r in got)


def test_heavy_documents_keep_sums_expectations_and_the_cap():
    rng = np.random.default_rng(4)
    n = rng.integers(1, 4, 25)
    size = np.sort(rng.integers(1, 300, 25))[::-1].astype(float)
    for f, more in ((0.37, 500.0), (2.9, 0.0), (0.02, 10.0), (3.0, 50.0), (1.0, 0.0)):
        total, mean, rests = float((n * size).sum()) + more, np.zeros(25), 0.0
        for _ in range(3000):
            copies, rest = mixing.heavy(n, size, rng.random(25), f, total)
            assert (copies <= 3 * n).all() and (copies == np.round(copies)).all() and 0 <= rest <= 3
            # nothing left to trade: the document in hand is drawn; else the last one is
            spare = size[0] if rest < 1e-9 or rest > 3 - 1e-9 else size[-1] if more == 0 else 1e-6
            assert abs((copies * size).sum() + rest * more - f * total) <= spare + 1e-6
            mean += copies / 3000
            rests += rest / 3000
        assert np.abs(mean - f * n).max() < 0.06 and (more == 0 or abs(rests - f) < 0.12)
