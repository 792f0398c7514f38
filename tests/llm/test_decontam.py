"""Benchmark decontamination against comparing every window with every text."""

import hashlib
import re

import numpy as np
import pytest

from colvet.llm import decontam

DOCS = "doc_id long, text string, item_id string, token string, n_hit string"
ITEMS = "item_id long, text string, row string, size string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, size=10):
    windows = {}
    for i, t in items:
        w = words_of(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[k:k + size]), set()).add("" if i is None else str(i))
    out = []
    for i, t in docs:
        w, hit, found = words_of(t), set(), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                if tuple(w[p:p + n]) in windows:
                    hit |= set(range(p, p + n))
                    found |= windows[tuple(w[p:p + n])]
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((str(i), len(w), len(hit), len(found), sha, bool(hit)))
    return sorted(out)


def rows(df):
    return sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in df.collect())


def tables(spark, docs, items):
    return (spark.createDataFrame([(i, t, "x", "y", "z") for i, t in docs], DOCS),
            spark.createDataFrame([(i, t, "x", "y") for i, t in items], ITEMS))


def planted(rng):
    vocab = [f"w{k}" for k in range(40)] + ["Été", "日本", "A1"]
    text = lambda n: " ".join(rng.choice(vocab, n))
    shared = text(14)
    items = [(k, text(int(rng.integers(11, 40)))) for k in range(12)]
    items += [(20 + k, text(5) + " " + shared) for k in range(4)]
    items += [(30, "only four words here"), (31, "two. words!"), (32, "unique"), (33, ""), (34, None), (35, "..."),
              (None, text(12)), (36, shared), (36, shared), (37, text(10)), (37, text(11)), (38, items[0][1])]
    docs = [(0, None), (1, ""), (2, " ... "), (3, "unique"), (4, "two words"), (5, "Only FOUR-words here! only four words here"),
            (6, "x" * 30_000), (7, "unique " * 4_000), (8, shared + ", " + shared)]
    for k in range(60):
        parts = [text(int(rng.integers(0, 60)))]
        for _ in range(int(rng.integers(0, 3))):
            i = words_of(items[int(rng.integers(0, len(items)))][1])
            a = int(rng.integers(0, max(1, len(i) - 8)))
            parts += [", ".join(i[a:a + int(rng.integers(8, 25))]).upper(), text(int(rng.integers(0, 20)))]
        docs.append((100 + k, " ".join(parts)))
    docs += [(None, docs[-1][1]), (100, docs[-2][1]), (100, docs[-2][1])]
    return docs, items


@pytest.mark.parametrize("filter_bits", [28, 16])
def test_report_equals_brute_force(spark, monkeypatch, filter_bits):
    monkeypatch.setattr(decontam, "FILTER_BITS", filter_bits)
    docs, items = planted(np.random.default_rng(5))
    want = brute(docs, items)
    assert rows(decontam.report(*tables(spark, docs, items))) == want
    assert sum(r[-1] for r in want) > 25 and sum(not r[-1] for r in want) > 5


def test_a_filter_too_small_for_the_tokens_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(decontam, "FILTER_BITS", 15)
    monkeypatch.setattr(decontam, "_held", lambda bits, token: np.ones(len(token), bool))
    docs, items = planted(np.random.default_rng(6))
    docs = [d for d in docs if len(d[1] or "") < 5_000]
    assert rows(decontam.report(*tables(spark, docs, items))) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = [(1, "a b c"), (2, None)], [(1, "b")]
    d, i = tables(spark, docs, items)
    assert rows(decontam.report(d, i.limit(0))) == brute(docs, [])
    assert decontam.report(d.limit(0), i).collect() == []


def test_clean_keeps_what_no_window_touches(spark):
    docs, items = planted(np.random.default_rng(7))
    d, i = tables(spark, docs, items)
    kept = decontam.clean(d, i)
    bad = {t for (k, t), r in zip(docs, (brute([x], items)[0] for x in docs)) if r[-1]}
    assert kept.columns == d.columns
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in kept.collect()))) == sorted(
        str((k, t)) for k, t in docs if t not in bad)
