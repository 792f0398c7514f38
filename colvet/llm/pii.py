"""Personal data by weak supervision.

Candidate spans are the matches of the base patterns (email, ip, card, phone)
and of wider ones (numbers without a country code, spelt-out addresses, id
numbers, titled names). Four labelers vote on each candidate, for, against or
not at all: the strict pattern, a gazetteer, the words around it, and its
shape. Counts of vote patterns over all documents go through expectation-
maximisation, which estimates how reliable each labeler is (per kind of
candidate, without any labels); a logistic classifier is then trained on the
resulting probabilities and decides every candidate by its votes. Base matches
stay whatever it says; other candidates are added where it accepts.

The driver holds one row per kind and vote pattern (6 * 81 at most).

Positions are code points, end exclusive. Defined results: a null or empty text
has no spans (and stays as it is when redacted). Extra columns are ignored (kept
when redacted); repeated rows stay; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, map_texts, reach, texts

KINDS = ("email", "ip", "card", "phone", "id", "name")
LABELERS = 4
EM_ROUNDS = 50
ACCEPT = 0.5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits is taken whole or not at all, so no start inside a run can match
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOOSE_PHONE = re.compile(r"(?<![\w+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-]|\.[0-9])")
_SSN = re.compile(r"(?<![\w.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]|\.[0-9])")
_SPELT = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:\[at\]|\(at\)| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\[dot\]|\(dot\)| dot |\.) ?[A-Za-z]{2,24}){1,3}")
_NAME = re.compile(r"(?<!\w)(?:Mr|Mrs|Ms|Dr|Prof)\. [A-Z][a-z]+(?: [A-Z][a-z]+)?")

# The gazetteers.
_ENDINGS = frozenset("com org net edu gov io co info biz de fr es it uk us eu ch at nl be pl se no fi ru cn jp in br au ca mx".split())
_FIRST_NAMES = frozenset(
    "Anna Maria John James Mary Robert Linda Michael Sarah David Laura Thomas Peter Paul Julia Klaus Hans Marie Jean Pierre "
    "Sophie Carlos Juan Jose Carmen Ana Luis Emma Lucas Elena Max Eva Martin Daniel".split())
_CONTEXT = {
    0: ("mail", "contact", "write to", "reach"), 1: ("ip", "host", "server", "address", "login"),
    2: ("card", "visa", "credit", "payment", "account"), 3: ("phone", "call", "tel", "fax", "mobile", "number"),
    4: ("ssn", "social", "security", "passport", "id "), 5: ("name", "dear", "sincerely", "regards")}
#: Characters before a span in which the context labeler reads.
NEAR = 40


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list:
    """Leftmost matches of the email pattern. A match holds the first ``@`` after
    its start, so each ``@`` is looked at once, with the characters before it."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list:
    """``(kind number, start, end)`` of the base patterns by kind, then start."""
    out = [(0, s, e) for s, e in emails(text)]
    if not _DIGIT.search(text):
        return out
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            d = _only_digits(m.group())
            if 16 <= len(d) <= 19 and luhn(d):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_only_digits(m.group())) <= 15]
    return out


def _wider(text: str) -> list:
    out = []
    if " at " in text or " dot " in text or "[dot]" in text or "(dot)" in text or "[at]" in text or "(at)" in text:
        out += [(0, m.start(), m.end()) for m in _SPELT.finditer(text)]
    if _DIGIT.search(text):
        out += [(3, m.start(), m.end()) for m in _LOOSE_PHONE.finditer(text)]
        out += [(4, m.start(), m.end()) for m in _SSN.finditer(text)]
    if ". " in text:
        out += [(5, m.start(), m.end()) for m in _NAME.finditer(text)]
    return out


def _gazetteer(kind: int, s: str) -> int:
    if kind == 0:
        return 1 if re.split(r"[^A-Za-z]+", s)[-1].lower() in _ENDINGS else -1
    if kind == 1:
        first = int(s.split(".")[0] or 0)
        return -1 if first in (0, 127) or first >= 240 else 1
    d = _only_digits(s)
    if kind == 2:
        return 1 if d[0] in "3456" else -1
    if kind == 3:
        return 1 if s[0] == "+" and d[0] != "0" else 0 if d[0] not in "01" else -1
    if kind == 4:
        return -1 if d[:3] in ("000", "666") or d[0] == "9" or d[3:5] == "00" else 1
    return 1 if any(w in _FIRST_NAMES for w in s.split()) else 0


def _shape(kind: int, s: str) -> int:
    if kind == 0:
        return 1 if "@" in s and 5 <= len(s) <= 80 else 0 if len(s) <= 80 else -1
    if kind == 1:
        return -1 if any(len(p) > 1 and p[0] == "0" for p in s.split(".")) else 1
    marks = {c for c in s if c in " -"}
    if kind == 2:
        return 1 if len(marks) <= 1 else -1
    if kind == 3:
        return 1 if len(_only_digits(s)) >= 10 else 0
    return 1 if kind == 4 else 0 if len(s.split()) < 3 else 1


def _context(kind: int, text: str, start: int) -> int:
    before = text[max(0, start - NEAR):start].lower()
    return 1 if any(w in before for w in _CONTEXT[kind]) else 0


def candidates(text: str) -> list:
    """``(kind, start, end, base, votes)`` of one text; wider candidates that touch a
    base match are dropped. ``votes`` numbers the vote pattern in base 3."""
    base = base_spans(text)
    spans = [(*b, True) for b in base]
    starts, ends = reach(b[1:] for b in base)
    for w in _wider(text):
        i = bisect_left(starts, w[2])
        if not i or ends[i - 1] <= w[1]:
            spans.append((*w, False))
    out = []
    for kind, s, e, strict in spans:
        part = text[s:e]
        v = (1 if strict else 0, _gazetteer(kind, part), _context(kind, text, s), _shape(kind, part))
        out.append((kind, s, e, strict, sum((x + 1) * 3**i for i, x in enumerate(v))))
    return out


def _votes(pattern: np.ndarray) -> np.ndarray:
    return np.stack([pattern // 3**i % 3 for i in range(LABELERS)], 1) - 1


def reliabilities(kind: np.ndarray, pattern: np.ndarray, n: np.ndarray):
    """Expectation-maximisation over counted vote patterns. Returns the probability
    that a candidate of each row is personal data, and per labeler the
    probabilities of its votes given false and true."""
    v = _votes(pattern) + 1
    p = np.clip(0.5 + 0.2 * _votes(pattern).sum(1), 0.05, 0.95)
    given = np.full((2, LABELERS, 3), 1 / 3)
    for _ in range(EM_ROUNDS):
        for y, w in ((0, n * (1 - p)), (1, n * p)):
            for j in range(LABELERS):
                c = np.bincount(v[:, j], w, 3)
                # a labeler is held to be better than chance: two votes of prior on its side
                c = c + np.array([2.0, 1.0, 1.0] if y == 0 else [1.0, 1.0, 2.0])
                given[y, j] = c / c.sum()
        prior = np.array([(n * p)[kind == k].sum() + 1 for k in range(len(KINDS))]) / np.array(
            [n[kind == k].sum() + 2 for k in range(len(KINDS))])
        like = [np.log(np.prod([given[y, j][v[:, j]] for j in range(LABELERS)], 0)) for y in (0, 1)]
        z = like[1] - like[0] + np.log(prior / (1 - prior))[kind]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return p, given


def _features(kind: np.ndarray, pattern: np.ndarray) -> np.ndarray:
    v = _votes(pattern)
    return np.concatenate([(v > 0), (v < 0), np.eye(len(KINDS))[kind]], 1).astype(float)


def train(kind, pattern, n, p) -> np.ndarray:
    """Logistic weights fitted to the probabilities by Newton steps (ridge 1)."""
    x, w = _features(kind, pattern), np.zeros(2 * LABELERS + len(KINDS))
    scale = n / max(1.0, n.sum()) * 1000
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (scale * (p - q)) - w
        hess = (x * (scale * q * (1 - q))[:, None]).T @ x + np.eye(len(w))
        w = w + np.linalg.solve(hess, grad)
    return w


def fit(docs: DataFrame) -> np.ndarray:
    """Classifier weights from the vote patterns of all rows of ``docs``."""
    def run(batches):
        for b in by_bytes(batches):
            seen: dict = {}
            for t in texts(b):
                for kind, _, _, _, votes in candidates(t) if t else ():
                    seen[kind, votes] = seen.get((kind, votes), 0) + 1
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen], pa.int32()), pa.array([v for _, v in seen], pa.int32()),
                                                  pa.array(list(seen.values()), pa.int64())], names=["kind", "votes", "n"])

    rows = (map_texts(docs.select(F.col("text").cast("string").alias("text")), run, "kind int, votes int, n long")
                .groupBy("kind", "votes").agg(F.sum("n").alias("n")).orderBy("kind", "votes").collect())
    if not rows:
        return np.zeros(2 * LABELERS + len(KINDS))
    kind, votes, n = (np.array([r[i] for r in rows]) for i in range(3))
    p, _ = reliabilities(kind, votes, n.astype(float))
    return train(kind, votes, n.astype(float), p)


def decided(text: str, weights: np.ndarray) -> list:
    """All spans ``(kind, start, end, base)`` of one text, by kind, then start."""
    found = candidates(text)
    if any(not c[3] for c in found):
        x = _features(np.array([c[0] for c in found]), np.array([c[4] for c in found]))
        ok = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30))) > ACCEPT
        found = [c for c, a in zip(found, ok) if c[3] or a]
    return sorted(c[:4] for c in found)


def render(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e, _ in spans)


def find(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added)``, one row per row."""
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]

    def run(batches):
        for b in by_bytes(batches):
            rows = []
            for t in texts(b):
                spans = decided(t, weights) if t else []
                base = [x for x in spans if x[3]]
                rows.append((*(sum(1 for x in base if x[0] == k) for k in range(4)),
                             hashlib.sha256(render(base).encode()).hexdigest(), render(spans), len(spans) - len(base)))
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, zip(*rows))], names=names)

    return map_texts(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")),
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redacted(text: str, weights: np.ndarray) -> str:
    """``text`` with each span replaced by its kind, as ``[EMAIL]``; overlapping spans are
    replaced as one, by the first one's kind."""
    out, at = [], 0
    for kind, s, e, _ in sorted(decided(text, weights), key=lambda x: (x[1], x[0])):
        if s >= at:
            out += [text[at:s], f"[{KINDS[kind].upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:] if out else text


def redact(docs: DataFrame, weights: np.ndarray, column: str = "text") -> DataFrame:
    """``docs`` with personal data replaced in ``column``."""
    schema = docs.schema

    def run(batches):
        for b in by_bytes(batches, column):
            i = b.schema.get_field_index(column)
            new = pa.array([redacted(t, weights) if t else t for t in texts(b, column)], b.schema.field(i).type)
            yield pa.RecordBatch.from_arrays([new if k == i else c for k, c in enumerate(b.columns)], schema=b.schema)

    return map_texts(docs, run, schema)
