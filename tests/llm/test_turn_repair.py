"""Conversation repair against a plain search over all edits."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest

from colvet.llm import turn_repair as tr

ROWS = "conv_id long, turn long, role string, text string, place string, at string, edit string"
INITIAL = {"user": "u", "assistant": "a", "system": "s"}
LEGAL = re.compile(r"(s?(ua)+)?\Z")


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def best_audit(rows, costs):
    """Cheapest, then ASCII-least audit of (initial, fault) rows, found from the back on plain strings."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    need = {"": "u", "s": "u", "u": "a", "a": "u"}

    best = {}
    for i in range(len(rows), -1, -1):
        for inserted in (3, 2, 1, 0):
            for state in need:
                out = [(0, "")] if i == len(rows) and state in ("", "a") else []

                def then(cost, letter, at):
                    c, s = best[at]
                    out.append((c + cost, letter + s))

                if inserted < 3:
                    then(costs.insert, "I", (i, need[state], inserted + 1))
                if i < len(rows):
                    initial, fault = rows[i]
                    then(costs.delete, "D", (i + 1, state, 0))
                    if fault not in ("blank", "duplicate"):
                        more = costs.truncated if fault == "truncated" else 0
                        if (state, initial) in step:
                            then(more, "K", (i + 1, step[state, initial], 0))
                        then(more + costs.rerole, "R", (i + 1, need[state], 0))
                best[i, state, inserted] = min(out) if out else (10**9, "")
    return best[0, "", 0]


def replay(rows, audit):
    """Repaired (role, text) rows that an audit of (role, text) rows stands for."""
    need = {"": "user", "s": "user", "u": "assistant", "a": "user"}
    state, out, rest = "", [], iter(rows)
    for c in audit:
        if c == "I":
            new = (need[state], "")
        else:
            role, text = next(rest)
            if c == "D":
                continue
            new = (role, text) if c == "K" else (need[state], text)
        out.append(new)
        state = new[0][:1]
    return out


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        space = lambda x: " " if x is None else x
        role, text = space(role), space(text)
        fate = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        if fate == 1:
            text = ""
        elif fate == 2:
            text = re.sub("[.!?]", "", text)
        elif fate == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(fate, 1)
    return out


def brute(rows, ids, costs):
    result = []
    for conv in ids:
        mine = [(t, r, x) for c, t, r, x in rows if c == conv]
        mine = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in mine]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, marks = set(), []
        for _, role, text in mine:
            solid = re.sub("[\x20\x09-\x0d]", "", text)
            marks.append((role[:1], "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""))
            seen.add((role, text))
        turns = {t for t, *_ in mine if t is not None}
        cost, audit = best_audit(tuple(marks), costs)
        lines = replay([r[1:] for r in mine], audit)
        assert LEGAL.match("".join(r[:1] for r, _ in lines))
        n = lambda f: sum(m[1] == f for m in marks)
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marks, marks[1:]))
        result.append((str(conv), max(turns) - min(turns) + 1 - len(turns) if turns else 0, n("blank"), n("duplicate"), n("truncated"), illegal,
                       cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in lines).encode()).hexdigest()))
    return sorted(result)


def conversations(rng, many, longest):
    rows = []
    for conv in range(many):
        for turn in range(int(rng.integers(0, longest))):
            role = rng.choice(["user", "assistant", "system", "tool", "", "User"], p=[.4, .4, .08, .04, .04, .04])
            if rng.random() < 0.6:
                role = ["user", "assistant"][turn % 2]
            text = rng.choice(["Hi.", "What now?", "no end", " \n ", "", "É!\t", "end. ", "x" * 40 + ".", f"t{rng.integers(0, 99)}."])
            rows.append((conv, None if rng.random() < 0.05 else turn + int(rng.integers(0, 2)), str(role), str(text)))
    rows += [(None, 1, "user", None), (None, None, None, "a."), (None, 2, "assistant", "b."), (None, 2, "assistant", "b.")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], ROWS)


def collected(df):
    return sorted((str(r["conv_id"]), r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"])
                  for r in df.collect())


@pytest.mark.parametrize("segment,costs", [(2048, tr.Costs()), (3, tr.Costs()), (4, tr.Costs(rerole=3, delete=4, insert=1, truncated=2))])
def test_repair_equals_the_search(spark, monkeypatch, segment, costs):
    monkeypatch.setattr(tr, "SEGMENT", segment)
    rows = conversations(np.random.default_rng(segment), 60, 14)
    ids = sorted({c for c, *_ in rows if c is not None}) + [None, 777]
    got = tr.Repair(frame(spark, rows), costs)
    asked = frame(spark, [*rows, (777, 0, "user", "dropped")])
    want = brute(rows, ids, costs)
    assert collected(got.report(asked)) == want
    if costs.insert == 1:
        assert sum("I" in r[7] for r in want) > 10
    lines = {}
    for r in got.repaired().collect():
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    sha = {str(c): hashlib.sha256("\n".join(x).encode()).hexdigest() for c, x in lines.items()}
    assert all(sha.get(r[0], hashlib.sha256(b"").hexdigest()) == r[8] for r in want)


def test_damage_and_repair_equal_the_search(spark):
    rows = conversations(np.random.default_rng(11), 80, 9)
    ids = sorted({c for c, *_ in rows if c is not None}) + [None]
    df = frame(spark, rows)
    assert collected(tr.Repair(tr.damage(df)).report(df)) == brute(damaged(rows), ids, tr.Costs())


def test_one_long_conversation_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(tr, "SEGMENT", 50)
    rng = np.random.default_rng(12)
    rows = [(1, t, ["user", "assistant"][int(rng.random() < 0.5 + 0.4 * (t % 2))], f"m{t}" + "." * int(rng.random() < 0.9)) for t in range(600)]
    rows += [(1, 7, "user", "again.")] * 300 + [(2, 0, "user", "y" * 300_000 + "."), (2, 1, "assistant", " " * 100_000 + "z")]
    got = collected(tr.Repair(frame(spark, rows)).report(frame(spark, rows)))
    assert got == brute(rows, [1, 2], tr.Costs())


def test_empty_table(spark):
    df = frame(spark, [(1, 1, "user", "a")]).limit(0)
    assert tr.Repair(tr.damage(df)).report(df).collect() == []


def test_audits_compare_as_their_strings():
    rng = np.random.default_rng(3)
    nodes = [tr.Audit()]
    for _ in range(4000):
        nodes.append(tr.Audit(nodes[int(rng.integers(max(0, len(nodes) - 30), len(nodes)))], "DIKR"[int(rng.integers(0, 4))]))
    pick = [nodes[int(k)] for k in rng.integers(0, len(nodes), 120)]
    for a, b in itertools.product(pick, pick):
        assert tr.less(a, b) == (a.text() < b.text())


def test_a_hash_collision_does_not_decide(monkeypatch):
    monkeypatch.setattr(tr, "_MOD", 3)  # nearly every hash collides
    rng = np.random.default_rng(4)
    for _ in range(60):
        rows = [("sua"[int(rng.integers(0, 3))], ["", "", "truncated", "blank", "duplicate"][int(rng.integers(0, 5))]) for _ in range(12)]
        for costs in (tr.Costs(), tr.Costs(2, 2, 2, 1)):
            cost, node = tr.close(tr.solve(rows, tr.NONE, costs), costs)
            assert (cost, node.text()) == best_audit(tuple(rows), costs)
