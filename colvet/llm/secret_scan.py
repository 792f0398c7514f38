"""Secret scan: pattern matches, and high-entropy windows of candidate strings.

Base kinds: ``assign`` (a named credential and its value), ``access`` (access
key ids), ``hex`` (long lower-case hexadecimal strings). Beyond them every
candidate string (a maximal run of ``[A-Za-z0-9+/_=-]`` of ``WINDOW`` or more)
is read with a window of WINDOW characters whose counts, class counts and
Shannon entropy are updated by the one character that enters and the one that
leaves. A window is hot if its entropy reaches the threshold of its character
class; hot windows that touch are one ``entropy`` span. The allow-list judges each
window, not the whole run: a window is suppressed if it meets a UUID or a
placeholder (``ALLOWED``), or if every piece of letters and digits that it touches
is a plain word (``WORD``), as in paths, links and hyphenated names. A secret beside
a harmless string is still found. Spans inside base spans are dropped. All steps are
linear in the text.

Positions are code points, end exclusive. Defined results: a null or empty text
has no spans. Extra columns are ignored; repeated rows stay; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, map_texts, reach, texts

WINDOW = 20
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(
    r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Words of which ASSIGN needs one.
NAMES = (b"passw", b"secret", b"token", b"api")
#: Least entropy in bits of a window by character class; other classes are never hot.
THRESHOLDS = {"hex": 3.3, "alnum": 3.7, "base64": 3.9}
#: Harmless strings: UUIDs, placeholders, alphabets in order.
ALLOWED = re.compile(
    r"(?i)(?<![0-9a-f])[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}(?![0-9a-f])"
    r"|example|placeholder|changeme|x{4,}|abcdefgh|01234567|lorem")
#: A plain word: letters, then at most four digits.
WORD = re.compile(r"[A-Za-z]*[0-9]{0,4}")
PIECE = re.compile(r"[A-Za-z0-9]+")

_RUN = np.zeros(256, bool)
_RUN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True
_PLOGP = [0.0] + [-(n / WINDOW) * math.log2(n / WINDOW) for n in range(1, WINDOW + 1)]


def _groups(c: str) -> tuple:
    """(hexadecimal digit, lower, upper, digit) of a character; none: a symbol."""
    return (c in "0123456789abcdef", "a" <= c <= "z", "A" <= c <= "Z", "0" <= c <= "9")


def quiet_windows(run: str):
    """Whether the window at each start of ``run`` is suppressed by the allow-list;
    None if all are."""
    odd = np.zeros(len(run) + 1, np.int64)
    for m in PIECE.finditer(run):
        if not WORD.fullmatch(run, m.start(), m.end()):
            odd[m.start() + 1:m.end() + 1] = 1
    if not odd.any():
        return None
    known = np.zeros(len(run) + 1, np.int64)
    for m in ALLOWED.finditer(run):
        known[m.start() + 1:m.end() + 1] = 1
    odd, known = np.cumsum(odd), np.cumsum(known)
    return (odd[WINDOW:] == odd[:-WINDOW]) | (known[WINDOW:] > known[:-WINDOW])


def hot_spans(run: str, quiet=None) -> list:
    """``[(start, end)]`` of touching hot windows of ``run``; windows that begin where
    ``quiet`` holds are not hot."""
    if len(run) < WINDOW:
        return []
    counts: dict = {}
    cls = [0, 0, 0, 0]
    entropy, out = 0.0, []
    for i, c in enumerate(run):
        n = counts.get(c, 0)
        entropy += _PLOGP[n + 1] - _PLOGP[n]
        counts[c] = n + 1
        for k, g in enumerate(_groups(c)):
            cls[k] += g
        if i >= WINDOW:
            old = run[i - WINDOW]
            n = counts[old]
            entropy += _PLOGP[n - 1] - _PLOGP[n]
            counts[old] = n - 1
            for k, g in enumerate(_groups(old)):
                cls[k] -= g
        if i >= WINDOW - 1:
            hexa, lower, upper, digit = cls
            if hexa == WINDOW:
                kind = "hex" if digit and lower else None
            elif lower + upper + digit == WINDOW:
                kind = "alnum" if digit >= 2 and lower + upper else None
            else:
                kind = "base64" if digit >= 2 and lower and upper else None
            begin = i - WINDOW + 1
            if kind and entropy >= THRESHOLDS[kind] and (quiet is None or not quiet[begin]):
                if out and begin <= out[-1][1]:
                    out[-1] = (out[-1][0], i + 1)
                else:
                    out.append((begin, i + 1))
    return out


def _long_runs(raw: bytes) -> list:
    """Byte ranges of the candidate strings."""
    hit = _RUN[np.frombuffer(raw, np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    keep = end - start >= WINDOW
    return list(zip(start[keep].tolist(), end[keep].tolist()))


def scan(text: str) -> list:
    """All spans ``(kind number, start, end)`` of one text, base ones first found."""
    raw = text.encode("utf-8", "surrogatepass")
    found = []
    low = raw.lower()
    if any(n in low for n in NAMES):
        found += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    runs = _long_runs(raw)
    if runs:
        ascii_ = len(raw) == len(text)
        before = None if ascii_ else np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
        extra = []
        for b, e in runs:
            run = raw[b:e].decode("ascii")
            if run.isalpha() and not run.startswith("AKIA") and "AKIA" not in run and not HEX.search(run):
                continue
            at = b if ascii_ else int(before[b]) - 1
            found += [(1, at + m.start(), at + m.end()) for m in ACCESS.finditer(run) if m.end() - m.start() >= 20]
            found += [(2, at + m.start(), at + m.end()) for m in HEX.finditer(run)]
            quiet = quiet_windows(run)
            if quiet is not None:
                extra += [(3, at + s, at + t) for s, t in hot_spans(run, quiet.tolist())]
        starts, ends = reach(x[1:] for x in found)
        for x in extra:
            i = bisect_right(starts, x[1])
            if not i or ends[i - 1] < x[2]:
                found.append(x)
    return found


def render(spans: list) -> str:
    """``kind:start:end`` by start, then kind as listed."""
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], x[0], x[2])))


def find_secrets(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy)``, one row per row."""
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy"]

    def run(batches):
        for b in by_bytes(batches):
            rows = []
            for t in texts(b):
                spans = scan(t) if t else []
                n = [sum(1 for x in spans if x[0] == k) for k in range(4)]
                base = render([x for x in spans if x[0] < 3])
                rows.append((n[0], n[1], n[2], hashlib.sha256(base.encode()).hexdigest(), render(spans), n[3]))
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, zip(*rows))], names=names)

    return map_texts(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")),
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long")
