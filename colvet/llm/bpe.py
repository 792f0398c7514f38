"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece there is exactly one token that can come last in
its encoding: the vocabulary token that ends there and may follow the last
token of what precedes it. So one array, the last token of each prefix,
holds the encodings of all prefixes. Appending bytes only adds entries; an
edit keeps the entries before it and recomputes those from the edit on.

Whether token ``r`` may follow token ``l`` is decided by replaying the merges
inside both: while their facing ends are the parts a and b, no merge of
a and b may come before the next merge on either side (on equal rank the
leftmost comes first).

Text is cut by the pattern first; each match is encoded on its own. Between a
character that is not white space and one that is there is always a cut, so
chunks (white space, then text) are encoded once per worker and remembered in
tables of bounded size. A full table becomes the old generation: what is asked
for again moves to the new one, the rest goes when that is full in its turn.

Defined results: a null or empty text has no ids, and decodes to nothing.
Extra columns are ignored; repeated rows stay; an empty table gives an empty
result. Unpaired surrogates cannot occur in a Parquet string.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, map_texts, texts

#: Bytes (about) that a worker's memory of chunks, of pieces and of token pairs
#: each hold per generation.
REMEMBERED = 96 << 20
#: What an entry costs beside its texts.
ENTRY = 200
_NEVER = 1 << 60


def load_ranks(path: str) -> dict:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Vocabulary:
    """Ranks with, per token, the ends that its own merges pass through."""

    def __init__(self, ranks: dict):
        self.ranks = ranks
        self.bytes = {i: t for t, i in ranks.items()}
        #: rank of each token and -1 for each proper prefix of a token that is none
        self.starts = {t[:n]: -1 for t in ranks for n in range(1, len(t))} | ranks
        self._ends: dict = {}
        self._follows: dict = {}
        self._followed: dict = {}

    def merge(self, piece: bytes) -> tuple:
        """Merge ``piece`` by rank. Returns ``(parts, lefts, rights)``; lefts and rights
        list the parts that stood at the piece's ends, each with the rank of the
        merge that replaced it."""
        ranks = self.ranks
        parts = [piece[i:i + 1] for i in range(len(piece))]
        lefts, rights = [], []
        while len(parts) > 1:
            rank, i = min((ranks.get(parts[k] + parts[k + 1], _NEVER), k) for k in range(len(parts) - 1))
            if rank == _NEVER:
                break
            if i == 0:
                lefts.append((parts[0], rank))
            if i == len(parts) - 2:
                rights.append((parts[-1], rank))
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        lefts.append((parts[0], _NEVER))
        rights.append((parts[-1], _NEVER))
        return parts, lefts, rights

    def ends(self, token: int) -> tuple:
        """``(lefts, rights)``, or nothing where the token is not its own encoding."""
        got = self._ends.get(token)
        if got is None:
            parts, lefts, rights = self.merge(self.bytes[token])
            got = self._ends[token] = (lefts, rights) if len(parts) == 1 else ()
        return got

    def follows(self, left: int, right: int) -> bool:
        """Whether the encoding of both tokens' bytes is these two tokens (left -1:
        whether ``right`` is its own encoding)."""
        key = (left << 32) | right
        ok = self._follows.get(key)
        if ok is None:
            ok = self._followed.get(key)
            if ok is None:
                b = self.ends(right)
                ok = bool(b) if left < 0 else bool(b) and bool(self.ends(left)) and self._apart(self.ends(left)[1], b[0])
            if len(self._follows) * ENTRY > REMEMBERED:
                self._followed = dict(self._follows)
                self._follows.clear()
            self._follows[key] = ok
        return ok

    def _apart(self, rights, lefts) -> bool:
        i = j = 0
        while True:
            (a, next_a), (b, next_b) = rights[i], lefts[j]
            rank = self.ranks.get(a + b, _NEVER)
            if rank != _NEVER and rank < next_a and rank <= next_b:
                return False
            if next_a == next_b == _NEVER:
                return True
            # the side whose merge comes first moves on (equal ranks: the left one)
            if next_a <= next_b:
                i += 1
            else:
                j += 1


class Prefixes:
    """Last token of every prefix of one piece, open to appends and edits."""

    def __init__(self, vocab: Vocabulary, piece: bytes = b""):
        self.vocab, self.piece, self.last = vocab, b"", [-1]
        self.append(piece)

    def append(self, more: bytes) -> Prefixes:
        """Fill the table for the new prefixes: from each place, every token that
        starts there and may follow the last token of the prefix before it is
        the last token of the prefix that it ends."""
        done = len(self.piece)
        piece = self.piece = self.piece + more
        v, last, size = self.vocab, self.last, len(self.piece)
        starts, known, follows = v.starts, v._follows, v.follows
        last += [None] * (size - done)
        # tokens that cross the old end start at places before it; ``open_at`` is the first
        # prefix without a last token: what ends before it is settled
        open_at = done + 1
        for at in range(max(0, done - _longest(v) + 1), size):
            while open_at <= size and last[open_at] is not None:
                open_at += 1
            if open_at > size:
                break
            left = last[at]
            high = left << 32
            for end in range(open_at if open_at > at else at + 1, size + 1):
                token = starts.get(piece[at:end])
                if token is None:
                    break
                if token >= 0 and last[end] is None:
                    ok = known.get(high | token)
                    if ok or ok is None and follows(left, token):
                        last[end] = token
        return self

    def replace(self, start: int, end: int, new: bytes) -> Prefixes:
        """Replace bytes ``start:end``; entries of prefixes up to ``start`` stay."""
        tail = new + self.piece[end:]
        self.piece = self.piece[:start]
        del self.last[start + 1:]
        return self.append(tail)

    def tokens(self, end: int | None = None) -> list:
        """Encoding of the prefix of ``end`` bytes (the whole piece if None)."""
        at, out = len(self.piece) if end is None else end, []
        while at:
            out.append(self.last[at])
            at -= len(self.vocab.bytes[self.last[at]])
        return out[::-1]


def _longest(v: Vocabulary) -> int:
    if not hasattr(v, "longest"):
        v.longest = max(map(len, v.ranks))
    return v.longest


class _Memo(dict):
    """``make(key)``, remembered for short keys in two generations of about REMEMBERED bytes."""

    def __init__(self, make):
        super().__init__()
        self.make = make
        self.old: dict = {}
        self.held = 0

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if len(key) <= 64:
            if self.held > REMEMBERED:
                self.old, self.held = dict(self), 0
                self.clear()
            self.held += ENTRY + len(key) + len(got)
            self[key] = got
        return got


#: A cut lies before each white-space character that follows something else;
#: both sides are kept to characters whose class no engine disputes.
_CUT = regex.compile(r"(?<=[!-~\p{L}\p{N}])(?=[ \n\t\r])")
_MARKS = ".,;:!?"


class Encoder:
    """Text to ids and back. Ids travel as text, each after one blank."""

    def __init__(self, path: str, pattern: str):
        self.vocab = Vocabulary(load_ranks(path))
        self.pattern = regex.compile(pattern)
        self.named = {str(i): t for i, t in self.vocab.bytes.items()}
        self.pieces = _Memo(self._piece)
        self.chunks = _Memo(self._chunk)
        self.after_blank = _Memo(self._word)

    def _piece(self, s: str) -> str:
        v, p = self.vocab, s.encode("utf-8", "surrogatepass")
        got = v.ranks.get(p)
        found = [got] if got is not None and v.ends(got) else Prefixes(v, p).tokens()
        return "".join([f" {i}" for i in found])

    def _chunk(self, s: str) -> str:
        return "".join(map(self.pieces.__getitem__, self.pattern.findall(s)))

    def _word(self, w: str) -> str:
        core = w.rstrip(_MARKS)
        if core.isalpha() and (core.isascii() or max(core) < "\u0250"):
            # letters, then marks: two matches of the pattern
            tail = w[len(core):]
            return self.pieces[" " + core] + self.pieces[tail] if tail else self.pieces[" " + core]
        return self._chunk(" " + w)

    def ids(self, text: str) -> str:
        """Ids of the whole text, as `` 12 345``."""
        words = text.split()
        if words and sum(map(len, words)) + len(words) - 1 == len(text) and text.count(" ") + text.count("\n") == len(words) - 1:
            # single blanks and line ends only: each begins a chunk
            out = []
            for k, line in enumerate(text.split("\n")):
                first, *rest = line.split(" ")
                out.append(self.chunks["\n" + first if k else first])
                out += map(self.after_blank.__getitem__, rest)
            return "".join(out)
        return "".join([self.chunks[c] for c in _CUT.split(text) if c])

    def encode(self, text: str) -> list:
        return list(map(int, self.ids(text).split()))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.vocab.bytes.__getitem__, ids))


_READY: dict = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder per worker and vocabulary."""
    if (path, pattern) not in _READY:
        _READY[path, pattern] = Encoder(path, pattern)
    return _READY[path, pattern]


def tokenize(docs: DataFrame, path: str, pattern: str, ids: bool = True) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids array<int>])``, one row
    per row: ids of the whole text, and the digest of the bytes that the ids
    decode to. ``path`` must name a file that every executor has."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if ids else "")
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + (["ids"] if ids else [])

    def run(batches):
        enc = encoder(path, pattern)
        for b in by_bytes(batches):
            count, ids_sha, raw_sha, values = [], [], [], []
            for t in texts(b):
                got = enc.ids(t or "")[1:]
                each = got.split(" ") if got else []
                count.append(len(each))
                ids_sha.append(hashlib.sha256(got.encode()).hexdigest())
                raw_sha.append(hashlib.sha256(b"".join(map(enc.named.__getitem__, each))).hexdigest())
                if ids:
                    values.append(np.array(each, np.int32) if each else np.zeros(0, np.int32))
            cols = [b.column(0), pa.array(count, pa.int64()), pa.array(ids_sha), pa.array(raw_sha)]
            if ids:
                off = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(values))))
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return map_texts(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, schema)
