"""The pipeline's stages, one after the other, against plain Python."""

import hashlib

import pytest

SMOKE = "/root/testdata/sf0.001"


def test_stages_take_effect_and_chain(spark):
    P = pytest.importorskip("public_tokenizers")
    import corpus_pipeline as C
    from colvet.llm import pii
    from colvet.llm.common import materialize
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    seen = [docs.toPandas()]
    for name, stage in C.STAGES:
        docs = materialize(stage(spark, docs, SMOKE), f"test-{name}")
        seen.append(docs.toPandas())
    start, known, single, clean, mixed, ids = seen
    assert all(list(x.columns) == list(C.COLUMNS) for x in seen[:-1])
    assert len(known) >= 0.99 * len(start) and set(known.doc_id) <= set(start.doc_id)
    # near-duplicates at 5 words by brute force
    sets = {}
    for i, t in zip(known.doc_id, known.text):
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    assert sorted(single.doc_id) == sorted({root(i) for i in sets})
    text = dict(zip(single.doc_id, single.text))
    for i, t, n in zip(clean.doc_id, clean.text, clean.n_chars):
        assert n == len(t) and not pii.base_spans(t) and (t == text[i] or pii.base_spans(text[i]))
    copies = mixed.doc_id.value_counts()
    assert set(copies.index) <= set(clean.doc_id) and copies.max() <= 3
    assert len(ids) == len(mixed)
    want = sorted(hashlib.sha256(t.encode()).hexdigest() for t in mixed.text)
    assert sorted(ids.decoded_sha256) == want


def test_one_of_each_tells_rows_apart_by_id_and_text(spark):
    import corpus_pipeline as C
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    words = [[f"{a}{i}" for i in range(60)] for a in "abcd"]
    text = [" ".join(w) for w in words]
    near = " ".join(words[0][:59] + ["other"])
    rows = [(5, text[0]), (5, text[1]), (6, near), (6, text[1]), (None, text[0]), (None, text[2]), (None, text[2]),
            (7, text[3]), (7, text[3]), (8, None), (9, ""), (8, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in C.one_of_each(spark, docs, "").collect()]
    want = [(5, text[0]), (5, text[1]), (None, text[2]), (7, text[3]), (8, None), (9, "")]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert C.one_of_each(spark, docs.limit(0), "").count() == 0
