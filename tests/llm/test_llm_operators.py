"""Training-data operators against brute force on small planted tables."""

import hashlib
import itertools
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from colvet.llm import ann, bpe, chat_format, common, embed_dedup, langid, minhash_dedup, mixing, pii, secret_scan, sharding
from colvet.llm.common import shingle_sets, utf8

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, size string, spans string"
SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def docs(spark, values, langs=None, sources=None):
    """Rows of documents with extra columns whose names clash with results."""
    rows = [(i, t, (langs or [None] * len(values))[k], (sources or ["s"] * len(values))[k], None, "x", "y", "z")
            for k, (i, t) in enumerate(values)]
    return spark.createDataFrame(rows, DOCS)


def rng_words(rng, n, letters="abcdefghij"):
    return ["".join(rng.choice(list(letters), rng.integers(2, 7))) for _ in range(n)]


ODD = [None, "", "  \n ", "one", "a b c", "İstanbul ſecret K", "😀 é  x\x1c\x1fy", "a " * 3000, "x" * 20000, "A B C", "a b c"]


# ------------------------------------------------------------ near-duplicates
def _brute(values, words, percent):
    sets = {}
    for i, t in values:
        w = [x for x in re.split(rb"[ \t-\r]+", (t or "").encode()) if x]
        w = [x.lower() for x in w]
        sets[i] = frozenset(tuple(w[k:k + words]) for k in range(len(w) - words + 1)) if len(w) >= words else (
            frozenset([tuple(w)]) if w else frozenset())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= percent * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_minhash_groups_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "TILE", 300)
    rng = np.random.default_rng(1)
    values = [(100 + k, t) for k, t in enumerate(ODD)]
    for g in range(4):
        base = rng_words(rng, 90)
        for c in range(25):
            w = list(base)
            for _ in range(rng.integers(0, 7)):
                w[rng.integers(0, len(w))] = "q" + str(rng.integers(0, 10**6))
            values.append((1000 * (g + 1) + 7 * c, " ".join(w)))
    values += [(5, values[-1][1]), (99999, values[-1][1].upper())]
    got = minhash_dedup.near_duplicates(docs(spark, values), 4, 80).collect()
    want = _brute(values, 4, 80)
    assert len(got) == len(values)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert len({c for _, c in want.values()}) < len(want) - 20


def test_minhash_repeated_rows_null_ids_and_empty_table(spark):
    values = [(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e"), (None, "a b c d e"), (3, None), (3, "z z")]
    got = sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in minhash_dedup.near_duplicates(docs(spark, values), 4).collect())
    assert got == sorted([("1", "1", True), ("1", "1", True), ("2", "1", False), ("None", "None", True), ("3", "3", True), ("3", "3", True)])
    assert minhash_dedup.near_duplicates(docs(spark, []), 4).count() == 0


def test_pairs_within_the_radius_share_a_key():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**16, (300, minhash_dedup.K), dtype=np.uint16)
    b = a.copy()
    for row in b:
        row[rng.choice(minhash_dedup.K, minhash_dedup.RADIUS, replace=False)] ^= 1
    ka, kb = minhash_dedup.chunk_keys(a), minhash_dedup.chunk_keys(b)
    assert all(set(x) & set(y) for x, y in zip(ka.tolist(), kb.tolist()))


def test_shingles_follow_the_word_rule():
    keys, n = shingle_sets(utf8(["A b\tc\x0bd", "a B c d", "a b", "", None, "a b c d a b c d", "a b"]), 3)
    first = [set(k.tolist()) for k in np.split(keys, np.cumsum(n)[:-1])]
    assert first[0] == first[1] and n.tolist() == [2, 2, 1, 0, 0, 4, 1]


# ------------------------------------------------------------ embeddings
def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, n_links string")


def _planted(rng, dim=12):
    rows = [(0, None), (1, []), (2, [0.0] * dim), (3, [float("nan")] + [1.0] * (dim - 1)), (4, [None] + [1.0] * (dim - 1)),
            (5, [float("inf")] + [1.0] * (dim - 1)), (6, [1.0, 2.0]), (7, [2.0, 4.0])]
    k = 10
    for _ in range(12):
        c = rng.normal(size=dim)
        for _ in range(int(rng.integers(1, 30))):
            rows.append((k, [float(np.float32(x)) for x in (c + rng.normal(size=dim) * 0.25) * rng.uniform(0.1, 9)]))
            k += 1
    return rows + [(k + j, rows[-1][1]) for j in range(5)]


def _good(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def test_epsilon_grid_join_equals_brute_force(spark, monkeypatch):
    for name, v in (("INTERVAL", 32), ("LEAF", 8), ("FAN", 2)):
        monkeypatch.setattr(embed_dedup, name, v)
    rows = _planted(np.random.default_rng(3))
    good = [(i, np.array(v, float)) for i, v in rows if _good(v)]
    link = {i: set() for i, _ in rows}
    for (i, a), (j, b) in itertools.combinations(good, 2):
        if len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.9:
            link[i].add(j)
            link[j].add(i)
    comp = {i: i for i in link}
    while True:
        new = {i: min([comp[i], *(comp[j] for j in link[i])]) for i in link}
        if new == comp:
            break
        comp = new
    got = embed_dedup.near_duplicates(_vectors(spark, rows), 0.9).collect()
    assert sorted(r["vec_id"] for r in got) == sorted(link)
    for r in got:
        assert (r["n_links"], r["component_id"], r["kept"]) == (len(link[r["vec_id"]]), comp[r["vec_id"]], comp[r["vec_id"]] == r["vec_id"])
    assert embed_dedup.near_duplicates(_vectors(spark, []), 0.9).count() == 0


def test_multiprobe_search_recall_and_completeness(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 64)
    rows = _planted(np.random.default_rng(4))
    good = {i: np.array(v, float) for i, v in rows if _good(v)}
    got: dict = {}
    for r in ann.search(_vectors(spark, rows), F.col("vec_id") % 6 == 0, 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {i for i in good if i % 6 == 0 and sum(len(v) == len(good[i]) for v in good.values()) > 1}
    hit = total = 0
    for q, found in got.items():
        others = {j: float((good[q] * v).sum()) for j, v in good.items() if j != q and len(v) == len(good[q])}
        best = sorted(others, key=lambda j: (-others[j], j))[:5]
        found.sort()
        assert [r for r, *_ in found] == list(range(1, len(best) + 1))
        assert all(abs(others[v] - s) < 1e-9 for _, v, s in found)
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        hit, total = hit + len(set(best) & {v for _, v, _ in found}), total + len(best)
    assert hit / total >= 0.9
    assert ann.search(_vectors(spark, []), F.col("vec_id") % 6 == 0).count() == 0


@pytest.mark.parametrize("copies", ["rows", "vectors"])
def test_search_counts_a_repeated_id_once(spark, copies, monkeypatch):
    monkeypatch.setattr(ann, "directions", lambda rows: 0)  # the exact step: one bucket of all rows
    rng = np.random.default_rng(9)
    near = rng.normal(size=8)
    rows = [(i, rng.normal(size=8)) for i in range(1, 41)]
    # id 50 lies nearest to every query: 25 equal rows, or 25 vectors of its own
    rows += [(50, 1.2 * near + (0.1 * rng.normal(size=8) if copies == "vectors" else 0.0)) for _ in range(25)]
    rows += [(i, near + 0.1 * rng.normal(size=8)) for i in (60, 66)]
    got: dict = {}
    table = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    for r in ann.search(table, F.col("vec_id").isin(60, 66), 20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q, found in got.items():
        own = next(v for i, v in rows if i == q)
        others: dict = {}
        for i, v in rows:
            if i != q:
                others[i] = max(others.get(i, -np.inf), float(own @ v))
        found.sort()
        best = sorted(others, key=lambda j: (-others[j], j))[:20]
        assert [(r, v) for r, v, _ in found] == list(enumerate(best, 1))
        assert all(abs(others[v] - s) < 1e-9 for _, v, s in found)
    assert set(got) == {60, 66}


def test_merged_candidates_keep_the_best_score():
    q, v, s = ann.best(np.zeros(4, np.int64), np.array([7, 8, 7, 9]), np.array([9.0, 7.0, 5.0, 1.0]), 3)
    assert v.tolist() == [7, 8, 9] and s.tolist() == [9.0, 7.0, 1.0]


# ------------------------------------------------------------ text operators
def test_secrets_equal_brute_force(spark):
    values = list(enumerate([*ODD, "PassWord = 'abcdef12' api-key: x apikey:abcdefg token=ab", "AKIA" + "A1" * 9 + " AKIAX", "0123456789abcdef" * 2,
                             "é secret: abcdefg " + "Zx9Qw3Er7Ty5Ui1Op2As8Df4" + " end", "f81d4fae-7dec-11d0-a765-00a0c91e6bf6"]))
    got = {r["doc_id"]: r for r in secret_scan.find_secrets(docs(spark, values)).collect()}
    word = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    assign = re.compile(rf"""({word})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for i, t in values:
        t = t or ""
        s = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        s += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        s += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        text = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(s))
        assert got[i]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest(), t
        assert set(filter(None, text.split(","))) <= set(got[i]["spans"].split(","))
    assert got[len(ODD) + 3]["n_entropy"] == 1 and got[len(ODD) + 4]["n_entropy"] == 0
    assert secret_scan.find_secrets(docs(spark, [])).count() == 0


def test_allow_list_judges_windows_not_whole_runs():
    secret = "Zx9Qw3Er7Ty5Ui1Op2As8Df4"

    def found(text):
        return [text[s:e] for k, s, e in secret_scan.scan(text) if k == 3]

    for text in (f"services/{secret}", f"{secret}/xxxx", f"f81d4fae-7dec-11d0-a765-00a0c91e6bf6/{secret}", f"see example/path/{secret} there"):
        assert any(secret in x for x in found(text)), text
    for text in ("src/Components/HeaderSection2/indexPage2024/MainView", "Zx9Qw3ExampleTy5Ui1Op2", "Zx9Qw3Er7xxxxTy5Ui1Op2",
                 "f81d4fae-7dec-11d0-a765-00a0c91e6bf6", "Very-Long-Hyphenated-Name-12-34", "/" * 500 + "+"):
        assert found(text) == [], text
    # windows one by one: met placeholder or nothing but plain words
    run = "conf/Zx9Qw3Er7Ty5Ui1Op2As8/lorem/Name2024-Other"
    quiet = secret_scan.quiet_windows(run)
    for i in range(len(run) - secret_scan.WINDOW + 1):
        known = any(i < m.end() and m.start() < i + secret_scan.WINDOW for m in secret_scan.ALLOWED.finditer(run))
        touched = [m.group() for m in secret_scan.PIECE.finditer(run) if i < m.end() and m.start() < i + secret_scan.WINDOW]
        assert quiet[i] == (known or all(secret_scan.WORD.fullmatch(w) for w in touched))


def test_secret_scan_takes_linear_time():
    import time
    for unit in ("/" * 999 + "+", "Zx9Qw3Er7Ty5Ui1Op2As8Df4 ", "token=abcdefg9 Zx9Qw3Er7Ty5Ui1Op2As8Df4 "):
        took = []
        for n in (200_000, 800_000):
            text = (unit * (n // len(unit) + 1))[:n]
            t = time.process_time()
            secret_scan.scan(text)
            took.append(time.process_time() - t)
        assert took[1] < 10 * took[0] + 0.5, (unit[:20], took)


def test_wider_candidates_that_meet_a_base_span_are_dropped_in_linear_time():
    import time
    unit = "a.b@c.de call (212) 555-0147 or +1 (212) 555-0147; 4111 1111 1111 1111; x at y dot com 123-45-6789 "
    base = pii.base_spans(unit * 3)
    want = {w for w in pii._wider(unit * 3) if not any(w[1] < e and s < w[2] for _, s, e in base)}
    got = {c[:3] for c in pii.candidates(unit * 3) if not c[3]}
    assert got == want and got and len(pii._wider(unit * 3)) > len(want)
    took = []
    for n in (400, 1600):
        t = time.process_time()
        pii.candidates(unit * n)
        took.append(time.process_time() - t)
    assert took[1] < 10 * took[0] + 0.5, took


def test_letters_reach_the_last_code_point():
    letters = ["\U00031360", "\U00032000", "\U0002ebf0", "z"]
    *_, n = langid.words([*letters, "\U0010ffff", "1", None])
    assert n.tolist() == [1, 1, 1, 1, 0, 0, 0]


def test_sliding_entropy_equals_direct_counts():
    import math
    rng = np.random.default_rng(6)
    run = "".join(rng.choice(list("abcdefABCDEF0123456789+/"), 200))
    hot = set()
    for i in range(len(run) - secret_scan.WINDOW + 1):
        w = run[i:i + secret_scan.WINDOW]
        e = -sum(w.count(c) / 20 * math.log2(w.count(c) / 20) for c in set(w))
        low, up, dig = (sum(f(c) for c in w) for f in (str.islower, str.isupper, str.isdigit))
        kind = ("hex" if dig and low else None) if all(c in "0123456789abcdef" for c in w) else (
            "alnum" if dig >= 2 and low + up else None) if low + up + dig == 20 else ("base64" if dig >= 2 and low and up else None)
        if kind and e >= secret_scan.THRESHOLDS[kind] - 1e-12:
            hot |= set(range(i, i + 20))
    assert {p for s, e in secret_scan.hot_spans(run) for p in range(s, e)} == hot and hot


def test_pii_equals_brute_force_and_redacts(spark):
    texts = [*ODD, "mail a@b.c_d@e.f or x@y. and ..%@-.-", "ip 1.2.3.4.5.6.7.8 256.1.1.1 0001.002.3.255", "card 4111 1111 1111 1111 and 4111111111111112",
             "+1 (961) 555-6946, +12 34, ++49 30 1234567-8 call (555) 123-4567", "é ssn 123-45-6789 Dr. Anna Smith", "+" * 50 + "1" * 30]
    values = list(enumerate(texts))
    d = docs(spark, values)
    weights = pii.fit(d)
    got = {r["doc_id"]: r for r in pii.find(d, weights).collect()}
    dg = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda s: sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(s))) % 10 == 0
    for i, t in values:
        t = t or ""
        found = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        found += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
        found += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(dg(m[0])) <= 19 and luhn(dg(m[0]))]
        found += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(dg(m[0])) <= 15]
        text = ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in found)
        assert got[i]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest(), t
    clean = {r["doc_id"]: r for r in pii.redact(d, weights).collect()}
    assert clean[0]["text"] is None and clean[3]["text"] == "one" and clean[3]["spans"] == "z"
    assert "4111 1111" not in clean[len(ODD) + 2]["text"] and "[CARD]" in clean[len(ODD) + 2]["text"]
    assert pii.fit(docs(spark, [])).shape == weights.shape and pii.find(docs(spark, []), weights).count() == 0


def test_reliabilities_rank_the_labelers():
    rng = np.random.default_rng(7)
    y = rng.random(4000) < 0.5
    votes = np.stack([np.where(rng.random(4000) < a, y, ~y) * 2 for a in (0.95, 0.8, 0.6, 0.9)], 1)
    code, n = np.unique((votes * 3 ** np.arange(4)).sum(1), return_counts=True)
    p, given = pii.reliabilities(np.zeros(len(code), int), code, n.astype(float))
    right = [(given[1, j, 2] + given[0, j, 0]) / 2 for j in range(4)]
    assert right[0] > right[3] > right[1] > right[2]
    agree = (p[np.searchsorted(code, (votes * 3 ** np.arange(4)).sum(1))] > 0.5) == y
    assert agree.mean() > 0.93


def test_bpe_equals_the_library_and_decodes(spark):
    P = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path = P.path("byte_bpe_50k.tiktoken")
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    rng = np.random.default_rng(8)
    signs = [" ", "  ", "\n", "\t", "\x1c", "\x85", " ", "'s", "'ll", "a", "Z", "é", "1", "中", "😀", "!", "%%%", "\r\n", "aaaa", "----", "the", " of", "<|endoftext|>"]
    texts = [*ODD[:7], *("".join(rng.choice(signs, rng.integers(1, 30))) for _ in range(400))]
    values = list(enumerate(texts))
    for r in bpe.tokenize(docs(spark, values), path, P.PATTERN).collect():
        want = lib.encode_ordinary(texts[r["doc_id"]] or "")
        assert r["ids"] == want and r["n_tokens"] == len(want), texts[r["doc_id"]]
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
    v = bpe.encoder(path, P.PATTERN).vocab
    for _ in range(100):
        s = bytes(rng.choice(list(b"abcdefth eion-="), 40).tolist())
        p = bpe.Prefixes(v)
        for k in range(0, 40, 7):
            p.append(s[k:k + 7])
        assert p.tokens() == bpe.Prefixes(v, s).tokens() and p.tokens(11) == bpe.Prefixes(v, s[:11]).tokens()
        assert b"".join(v.bytes[t] for t in p.tokens()) == s
        assert p.replace(9, 20, b"thing").tokens() == bpe.Prefixes(v, s[:9] + b"thing" + s[20:]).tokens()


def test_language_models_learn_and_reject(spark):
    rng = np.random.default_rng(9)
    values, langs = [], []
    for k in range(160):
        letters, lang = (("aeiorstn", "xa") if k % 2 else ("uywkzqjv", "xb"))
        values.append((k, " ".join(rng_words(rng, 40, letters))))
        langs.append(lang)
    values += [(1000 + k, t) for k, t in enumerate([*ODD, "123 456", "中文字符" * 30])]
    langs += [None] * (len(values) - len(langs))
    d = docs(spark, values, langs)
    model = langid.learn(d)
    assert model.langs == ["xa", "xb"]
    got = {r["doc_id"]: r for r in langid.predict(d, model).collect()}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _ in values)
    assert all(got[i]["lang_pred"] == langs[i] and not got[i]["rejected"] and 0.5 < got[i]["score"] <= 1 for i in range(160))
    for i in (1000, 1001, 1002, 1000 + len(ODD)):
        assert (got[i]["lang_pred"], got[i]["score"], got[i]["rejected"]) == ("und", 0.0, True)
    assert got[1000 + len(ODD) + 1]["rejected"]
    assert langid.learn(docs(spark, [])) is None
    assert {r["lang_pred"] for r in langid.predict(d, None).collect()} == {"und"}
    assert langid.accepted(d, model).count() == sum(not r["rejected"] for r in got.values())


def test_spelt_addresses_do_not_depend_on_other_text():
    text = "write to john.smith at example.com"
    span = (0, text.index("john"), len(text))
    assert span in pii._wider(text) and span in pii._wider(text + " or a dot here")


def test_wrong_labels_do_not_widen_the_rejection_bound(spark):
    rng = np.random.default_rng(13)
    values, langs = [], []
    for k in range(400):
        letters, lang = (("aeiorstn", "xa") if k % 2 else ("uywkzqjv", "xb"))
        values.append((k, " ".join(rng_words(rng, 40, letters))))
        langs.append(lang)
    # in the held-back part: foreign letters, the other language and garble under a wrong label
    held = [i for i in range(1000, 1200) if zlib.crc32(str(i).encode()) % 4 == 3][:3]
    wrong = ["中文字符" * 30, values[0][1], " ".join(rng_words(rng, 40, "bcdfghlmpx"))]
    values += [(i, wrong[k % 3]) for k, i in enumerate(held)]
    langs += ["xa"] * len(held)
    foreign = ["中文字符" * 20, "漢字仮名" * 30, " ".join(rng_words(rng, 40, "bcdfghlmpx")), " ".join(rng_words(rng, 40, "абвгдежз"))]
    values += [(2000 + k, t) for k, t in enumerate(foreign)]
    langs += [None] * len(foreign)
    d = docs(spark, values, langs)
    got = {r["doc_id"]: r for r in langid.predict(d, langid.learn(d)).collect()}
    assert all(got[2000 + k]["rejected"] for k in range(len(foreign)))
    assert all(got[k]["lang_pred"] == langs[k] for k in range(400)) and sum(got[k]["rejected"] for k in range(400)) == 0


def test_a_repeated_id_is_one_document_of_the_sample(spark):
    rng = np.random.default_rng(14)
    values = [(k, " ".join(rng_words(rng, 20, "abcde"))) for k in range(40)]
    once = langid.learn(docs(spark, values, ["x"] * len(values)))
    more = langid.learn(docs(spark, values + values[:20] * 5, ["x"] * (len(values) + 100)))
    assert all(np.array_equal(a, b) for a, b in zip(once.plus, more.plus)) and np.array_equal(once.a, more.a)


def test_kneser_ney_probabilities_sum_to_one(spark):
    rng = np.random.default_rng(10)
    d = docs(spark, [(k, " ".join(rng_words(rng, 30, "abc"))) for k in range(60)], ["x"] * 60)
    model = langid.learn(d)
    total = 0.0
    for n in (1, 2, 3):
        ws = ["".join(w) for w in itertools.product("abc", repeat=n)]
        cp, start, length, _ = langid.words(["\n".join(ws)])
        total += float((2.0 ** -model.bits(cp, start, length)[:, 0]).sum())
    assert 0.1 < total < 1.0  # words of up to three letters: part of all words


# ------------------------------------------------------------ whole-table operators
def test_shuffle_laws_and_reruns(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 20)
    values = [*enumerate(ODD), *((k, f"text {k}") for k in range(100, 200)), (150, "text 150"), (None, "n")]
    d = docs(spark, values)
    got = sharding.assign(d, 8).collect()
    assert sorted((str(r["doc_id"]), str(r["record"]["text"])) for r in got) == sorted((str(i), str(t)) for i, t in values)
    per = {}
    for r in got:
        per.setdefault(r["shard"], []).append(r["slot"])
        t = (r["record"]["text"] or "").encode()
        assert r["size"] == len(t) + 1 and r["crc"] == zlib.crc32(t) and r["record"]["shard"] == "x"
    assert all(sorted(s) == list(range(len(s))) for s in per.values())
    assert max(map(len, per.values())) - min(map(len, per.values())) <= 1 and len(per) == 8
    key = lambda rows: sorted((str(r["doc_id"]), r["crc"], r["shard"], r["slot"]) for r in rows)
    assert key(sharding.assign(d.repartition(3), 8).collect()) == key(got)
    assert sharding.assign(docs(spark, []), 8).count() == 0
    assert sorted(sharding.fisher_yates(50, np.random.default_rng(1)).tolist()) == list(range(50))


def test_records_alike_but_for_other_columns_keep_their_places(spark):
    rows = [(None if i % 2 else 1, "same text", f"s{i}", {"k": i % 3}) for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, tags map<string, int>")
    places = [{r["record"]["source"]: (r["shard"], r["slot"]) for r in sharding.assign(x, 4).collect()}
              for x in (d.coalesce(1), d.repartition(5, "source"), d.orderBy(F.col("source").desc()))]
    assert places[0] == places[1] == places[2] and len(places[0]) == len(set(places[0].values())) == 40


def test_written_shards_hold_every_record(spark, tmp_path):
    d = docs(spark, [(k, f"text {k}") for k in range(60)])
    sharding.write_shards(d, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["record"]["doc_id"] for r in back.collect()) == list(range(60)) and len(os.listdir(tmp_path / "out")) >= 4


def test_mix_targets_copies_and_reruns(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 16)
    monkeypatch.setattr(mixing, "FAN", 2)
    rng = np.random.default_rng(11)
    names = [None, "a", "b", "c", "é"]
    values = [(k, "w " * int(rng.integers(0, 60))) for k in range(600)] + [(7, "w w w")] * 3 + [(601, None)]
    sources = [names[int(rng.integers(0, 5)) if k > 20 else 0] for k in range(len(values))]
    sources[600:603] = ["a"] * 3
    d = docs(spark, values, sources=sources)
    got = mixing.shares(mixing.allocate(d)).collect()
    assert len(got) == len(values)
    size = {}
    for (_, t), s in zip(values, sources):
        size[s] = size.get(s, 0) + len((t or "").split())
    goal = mixing.targets(list(size.items()))
    assert abs(sum(goal.values()) - sum(size.values())) < 1e-6 and all(goal[s] <= 3 * size[s] + 1e-9 for s in size)
    for s in size:
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - goal[s]) <= 60 and {r["target"] for r in own} == {goal[s]}
    assert all(r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"] for r in got)
    key = lambda rows: sorted((str(r["doc_id"]), str(r["source"]), r["taken"]) for r in rows)
    assert key(mixing.shares(mixing.allocate(d.repartition(5))).collect()) == key(got)
    mixed = mixing.mix(d)
    assert mixed.columns == d.columns
    assert sum(len((r["text"] or "").split()) for r in mixed.collect()) == sum(r["taken"] for r in got)
    assert mixing.mix(docs(spark, [])).count() == 0 and mixing.shares(mixing.allocate(docs(spark, []))).count() == 0


def test_pivot_keeps_sums_and_expectations():
    rng = np.random.default_rng(12)
    size, mean = rng.integers(1, 100, 30).astype(float), np.zeros(30)
    p = rng.random(30)
    for _ in range(3000):
        x = mixing.pivot(p, size, rng.random(30))
        assert abs((x * size).sum() - (p * size).sum()) < 1e-6 and ((x > 0) & (x < 1)).sum() <= 1
        mean += x / 3000
    assert np.abs(mean - p).max() < 0.05


def test_chat_rotation_equals_sql(spark):
    import duckdb
    rows = [(1, k, ("user", "assistant", "bob", "system", None)[k % 5], None if k == 3 else f"téxt {k}") for k in range(200)]
    rows += [(2, None, "user", "late"), (2, 5, "user", "a"), (2, 5, "user", "a"), (2, 5, "bob", "a"), (3, 1, "system", "only"), (None, 1, "user", "x")]
    got = chat_format.rotate(spark.createDataFrame([(*r, "e") for r in rows], "conv_id long, turn long, role string, text string, part string"))
    import pandas as pd
    con = duckdb.connect()
    con.register("c", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    con.execute("CREATE TABLE conversations AS SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role, text FROM c")
    cur = con.execute(chat_format.ORACLE)
    names = [x[0] for x in cur.description]
    want = sorted((tuple(str(v) for v in r) for r in cur.fetchall()))
    assert sorted(tuple(str(r[n]) for n in names) for r in got.collect()) == want
    whole = {}
    for r in got.orderBy("part").collect():
        whole[r["conv_id"], r["participant"]] = whole.get((r["conv_id"], r["participant"]), "") + r["rendered"]
    for r in got.collect():
        for s in filter(None, r["mask"].split(",")):
            a, b = map(int, s.split(":"))
            t = whole[r["conv_id"], r["participant"]]
            assert t[a - 10:a].endswith("assistant\n") and t[a:b].endswith(chat_format.CLOSE)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_rotation_bounds_the_rows_of_hot_parts(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "LIMIT", 16 * 1100)
    rng = np.random.default_rng(12)
    roles = ["user", "bob", "system", None]
    # no conversation id and no turn number, one turn number, one turn repeated, and ordinary conversations
    rows = [(None, None, roles[k % 4], f"t{k} " + "x" * int(rng.integers(0, 300))) for k in range(150)]
    rows += [(None, 3, "user", "y" * 200 + str(k % 7)) for k in range(60)] + [(5, 70, "bob", "same")] * 120
    rows += [(5, 1, "user", "hi"), (5, 200, "user", "bye"), *((6, k, roles[k % 3], f"é {k}") for k in range(12)), (7, 1, "system", "s")]
    got = chat_format.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    seen: dict = {}
    for r in sorted(got, key=lambda r: (r["part"], r["char_start"])):
        seen.setdefault((r["conv_id"], r["participant"]), []).append(r)
    named = [(c, t, r or "unknown", x) for c, t, r, x in rows]
    assert set(seen) == {(c, r) for c, _, r, _ in named if r != "system"}
    for (conv, who), parts in seen.items():
        text, spans = "", []
        for _, _, role, x in sorted((r for r in named if r[0] == conv), key=lambda r: (r[1] is None, r[1] or 0, r[2], r[3])):
            text += f"{chat_format.OPEN}{'assistant' if role == who else 'system' if role == 'system' else 'user:' + role}\n"
            spans += [f"{len(text)}:{len(text) + len(x) + len(chat_format.CLOSE)}"] if role == who else []
            text += f"{x}{chat_format.CLOSE}\n"
        assert "".join(r["rendered"] for r in parts) == text
        assert [s for r in parts for s in r["mask"].split(",") if s] == spans
        assert all(text[r["char_start"]:].startswith(r["rendered"]) for r in parts)
        assert sum(r["n_turns"] for r in parts) == sum(r[0] == conv for r in named) and sum(r["n_masked"] for r in parts) == len(spans)
    assert max(r["n_turns"] for r in got) <= 18
    assert all(len(seen[6, w]) == 1 for w in ("user", "bob")) and len(seen[None, "bob"]) > 8 < len(seen[5, "bob"])


def test_text_batches_are_bounded_and_long_rows_whole(spark):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["rows", "bytes"])

    long = common.BATCH_BYTES * 2
    size = F.when(F.col("id") == 77, long).otherwise(100_000).cast("int")
    rows = spark.range(0, 200, 1, 1).select(F.repeat(F.lit("x"), size).alias("text"))
    got = common.map_texts(rows, run, "rows long, bytes long").toPandas()
    assert got["rows"].sum() == 200 and got["bytes"].sum() >= 199 * 100_000 + long
    assert got["bytes"].max() < common.BATCH_BYTES + long + 200_000
    assert (got["bytes"] < common.BATCH_BYTES + 200_000).sum() >= len(got) - 1
