"""Language identification by interpolated Kneser-Ney character models.

One model per language over the letters of words (each word between a begin
and an end sign, up to ``ORDER`` letters of history). Counts are taken by
Spark from a bounded sample of labelled rows: the ``SAMPLE`` documents of each
language with the smallest hash of their id, whole texts. The n-grams of all
languages lie in one sorted array of 64-bit hashes per order, with a column
per language for the discounted probability and the weight passed to the next
shorter history, so one binary search per letter and order serves all models.

A text's score under a language is its cross-entropy in bits per letter; the
lowest wins (ties: the first language by code point). Texts are scored by
their distinct words; a worker remembers up to ``REMEMBERED`` of them.

Calibration uses the part of the sample that the counts leave out: a
temperature that makes the probabilities fit, and per language a bound on
cross-entropy, ``a + b / sqrt(letters)``. It lies above a high quantile of
the held-back documents that are predicted as they are labelled, by ``MARGIN`` and
a multiple of that quantile's distance from the median: the long tail of real
documents is kept, and some wrong labels or garbled texts do not move it; texts beyond the
bound of their language are in no learned language and are rejected.

Defined results: a null text, or one without a letter, is ``und`` with score 0
(rejected), and so is every text if no language was learned. Labels, sources
and ids never enter a prediction. A null id is not held out and not learned
from. Of rows that repeat an id under one label, the sample holds one (the text
with the smallest hash). Extra columns are ignored; repeated rows stay; an empty table gives an
empty result.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes, map_texts, mix, texts

ORDER = 5
#: Labelled documents per language that the models are fitted on (at most 1000,
#: Spark's limit for ranking before the shuffle).
SAMPLE = 1000
REMEMBERED = 200_000
#: Bytes of text that are counted or scored at a time.
CHUNK = 1 << 20
#: Where the bound of a language starts among its held-back documents, the room above
#: in distances of that quantile from the median, and in bits per letter.
QUANTILE, TAIL, MARGIN = 0.95, 4.0, 0.5
_BEGIN, _END = 1, 2
_A = np.uint64(0x9E3779B97F4A7C15)


def _letters() -> np.ndarray:
    t = np.zeros(0x110000, bool)
    t[[c for c in range(len(t)) if unicodedata.category(chr(c))[0] == "L"]] = True
    return t


_TABLE: list = []


def words(values: list):
    """Letter codes of all words end to end, word starts and lengths, and the number
    of words of each text. Words are runs of letters, in lower case."""
    if not _TABLE:
        _TABLE.append(_letters())
    low = [v.lower() if v else "" for v in values]
    cp = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _TABLE[0][cp]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], letter, [False])).view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    stop = np.cumsum([len(v) + 1 for v in low])
    n = np.diff(np.concatenate(([0], np.searchsorted(start, stop))))
    return cp, start, end - start, n


def _word_keys(cp, start, length):
    """64-bit hash per word (sum of mixed letters times powers of an odd number)."""
    if not len(start):
        return np.zeros(0, np.uint64)
    at = np.repeat(start, length) + _ramp(length)
    with np.errstate(over="ignore"):
        powers = np.full(int(length.max()) + 1, _A, np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        val = mix(cp[at].astype(np.uint64)) * powers[_ramp(length)]
        first = np.cumsum(length) - length
        return mix(np.add.reduceat(val, first) + length.astype(np.uint64))


def _ramp(length):
    return np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)


def grams(cp, start, length):
    """Per order k the hashes of the k-grams that end at each sign of the words
    (begin and end signs included), and each sign's place in its word."""
    n = length + 2
    place = _ramp(n)
    sign = np.full(len(place), _BEGIN, np.uint64)
    inner = (place > 0) & (place < np.repeat(n, n) - 1)
    sign[inner] = cp[np.repeat(start, length) + _ramp(length)]
    sign[(place > 0) & ~inner] = _END
    with np.errstate(over="ignore"):
        h = [mix(sign + np.uint64(77))]
        for k in range(2, ORDER + 1):
            prev = np.concatenate(([np.uint64(0)], h[-1][:-1]))
            h.append(mix(prev * _A + sign * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(k)))
    return h, place, n


class Model:
    """Sorted hash arrays per order: ``keys``, ``plus[key, language]`` (discounted
    probability as last sign of its gram), ``down[key, language]`` (weight of the
    shorter history when the gram is the history). The last row stands for an
    unseen gram: nothing is added, the shorter history counts in full."""

    def __init__(self, langs, keys, plus, down, floor):
        self.langs, self.keys, self.plus, self.down, self.floor = langs, keys, plus, down, floor
        self.heat, self.a, self.b = 1.0, np.full(len(langs), np.inf), 0.0

    def find(self, k, h):
        keys = self.keys[k]
        i = np.searchsorted(keys, h)
        i[i == len(keys)] = 0
        return np.where(keys[i] == h, i, len(keys)) if len(keys) else np.zeros(len(h), np.int64)

    def bits(self, cp, start, length):
        """``(words, languages)``: minus log2 probability of each word."""
        if not len(start):
            return np.zeros((0, len(self.langs)))
        h, place, n = grams(cp, start, length)
        at = [self.find(k, h[k]) for k in range(ORDER)]
        p = self.plus[0][at[0]] + self.floor
        for k in range(1, ORDER):
            has = np.flatnonzero(place >= k)
            p[has] = self.plus[k][at[k][has]] + self.down[k - 1][at[k - 1][has - 1]] * p[has]
        cost = -np.log2(p)
        cost[place == 0] = 0.0
        return np.add.reduceat(cost, np.cumsum(n) - n, axis=0)


def count_grams(sample: DataFrame) -> DataFrame:
    """``(lang, k, gram, history, suffix, initial, n)`` counts of ``sample(lang, text)``;
    ``initial`` marks grams that begin with the begin sign."""
    def run(batches):
        for b in by_bytes(batches, limit=CHUNK):
            langs = b.column(0).to_pylist()
            values = texts(b)
            for lang in sorted(set(langs)):
                cp, start, length, _ = words([v for v, x in zip(values, langs) if x == lang])
                if not len(start):
                    continue
                # each distinct word once, as often as it occurs
                _, one, times = np.unique(_word_keys(cp, start, length), return_index=True, return_counts=True)
                h, place, size = grams(cp, start[one], length[one])
                times = np.repeat(times, size)
                for k in range(ORDER):
                    has = np.flatnonzero(place >= k) if k else np.arange(len(place))
                    zero = np.zeros(len(has), np.uint64)
                    hist = h[k - 1][has - 1] if k else zero
                    suffix = h[k - 1][has] if k else zero
                    _, first, which = np.unique(h[k][has], return_index=True, return_inverse=True)
                    n = np.bincount(which, times[has]).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(n)), pa.array(np.full(len(n), k, np.int32)),
                         *(pa.array(x.view(np.int64)) for x in (h[k][has][first], hist[first], suffix[first])),
                         pa.array(place[has][first] == k), pa.array(n)],
                        names=["lang", "k", "gram", "history", "suffix", "initial", "n"])

    return (map_texts(
        sample.select("lang", "text"), run, "lang string, k int, gram long, history long, suffix long, initial boolean, n long")
        .groupBy("lang", "k", "gram", "history", "suffix", "initial").agg(F.sum("n").alias("n")))


def build(counts: pa.Table, langs: list) -> Model:
    """Interpolated Kneser-Ney from the collected counts (size bounded by the sample).
    They stay Arrow columns and flat arrays: the driver's memory is small."""
    order, total_n, initial = (counts[c].to_numpy() for c in ("k", "n", "initial"))
    grams_, histories, suffixes = (counts[c].to_numpy().view(np.uint64) for c in ("gram", "history", "suffix"))
    of = pc.index_in(counts["lang"], pa.array(langs, pa.string())).to_numpy()
    keys = [np.unique(grams_[order == k]) for k in range(ORDER)]
    plus = [np.zeros((len(k) + 1, len(langs))) for k in keys]
    down = [np.ones((len(k) + 1, len(langs))) for k in keys]
    floor = np.zeros(len(langs))
    for j in range(len(langs)):
        rows = [np.flatnonzero((of == j) & (order == k)) for k in range(ORDER)]
        for k in range(ORDER):
            t = rows[k]
            gram, hist, n = grams_[t], histories[t], total_n[t].astype(float)
            if k + 1 < ORDER:
                # how many different signs come before the gram; raw counts at a word's begin
                seen = np.bincount(np.searchsorted(keys[k], suffixes[rows[k + 1]]), minlength=len(keys[k]))
                n = np.where(initial[t] & (k > 0), n, seen[np.searchsorted(keys[k], gram)])
            if k == 0:
                n = np.where(gram == mix(np.array([_BEGIN + 77], np.uint64))[0], 0.0, n)
            n1, n2 = (n == 1).sum(), (n == 2).sum()
            d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            at = np.searchsorted(keys[k], gram)
            if k == 0:
                total = max(n.sum(), 1.0)
                plus[0][at, j] = np.maximum(n - d, 0) / total
                floor[j] = max(d * (n > 0).sum() / total, 1e-6) / (len(keys[0]) + 1)
                continue
            up = np.searchsorted(keys[k - 1], hist)
            total = np.bincount(up, n, len(keys[k - 1]))
            kinds = np.bincount(up, n > 0, len(keys[k - 1]))
            plus[k][at, j] = np.maximum(n - d, 0) / np.maximum(total[up], 1e-300)
            some = total > 0
            down[k - 1][:-1][some, j] = d * kinds[some] / total[some]
    return Model(langs, keys, plus, down, floor)


class Scorer:
    """Scores texts by distinct words, remembering words between calls."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self):
        self.known, self.bits = np.zeros(0, np.uint64), np.zeros((0, len(self.model.langs)))

    def entropies(self, values: list):
        """``(bits per letter and language, letters)`` of each text; the end of a
        word counts as a letter."""
        cp, start, length, n = words(values)
        keys = _word_keys(cp, start, length)
        distinct, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != distinct[inside]
        cost = np.empty((len(distinct), len(self.model.langs)))
        cost[~new] = self.bits[at[~new]]
        cost[new] = self.model.bits(cp, start[first[new]], length[first[new]])
        if len(self.known) + new.sum() > REMEMBERED:
            self.forget()
        if new.sum() <= REMEMBERED:
            k = np.concatenate((self.known, distinct[new]))
            order = np.argsort(k, kind="stable")
            self.known, self.bits = k[order], np.concatenate((self.bits, cost[new]))[order]
        doc = np.repeat(np.arange(len(values)), n)
        letters = np.bincount(doc, (length + 1).astype(float), len(values))
        total = np.stack([np.bincount(doc, cost[inverse, j], len(values)) for j in range(cost.shape[1])], 1)
        return total / np.maximum(letters, 1.0)[:, None], letters


def _fold(col):
    return F.pmod(F.crc32(col.cast("string")), F.lit(4))


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit on labelled rows with remainder 0 or 1 and calibrate on remainder 3
    (crc32 of the id, modulo 4; remainder 2 is held out). None without labels."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                    F.col("text").cast("string").alias("text"))
    fold = _fold(F.col("doc_id"))
    named = d.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (fold != 2))
    named = named.withColumn("part", (fold == 3).cast("int"))
    w = Window.partitionBy("lang", "part").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = (named.select("doc_id", "lang", "part").distinct().withColumn("r", F.row_number().over(w))
                   .where(F.col("r") <= F.when(F.col("part") == 1, max(1, sample // 4)).otherwise(sample)).where(F.col("r") <= sample)
                   .select("doc_id", "lang", "part"))
    chosen = named.join(F.broadcast(picked), ["doc_id", "lang", "part"], "left_semi")  # at most 1.25 * sample ids a language
    chosen = chosen.groupBy("doc_id", "lang", "part").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))
    counts = count_grams(chosen.where("part = 0")).toArrow()
    langs = sorted(counts["lang"].unique().to_pylist())
    if not langs:
        return None
    model = build(counts, langs)
    del counts
    return calibrate(model, chosen.where("part = 1"), docs.sparkSession)


def calibrate(model: Model, held: DataFrame, spark) -> Model:
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(shared.value)
        for b in by_bytes(batches, limit=CHUNK):
            ce, n = scorer.entropies(texts(b))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(list(ce), pa.list_(pa.float64()))],
                                             names=["lang", "letters", "ce"])

    # one small row per held-back document: bounded by the sample
    got = map_texts(held.select("lang", "text"), run, "lang string, letters double, ce array<double>").where("letters > 0").toArrow()
    got = got.filter(pc.is_in(got["lang"], pa.array(model.langs, pa.string())))
    if not got.num_rows:
        return model
    ce, n = np.array(got["ce"].to_pylist()), got["letters"].to_numpy()
    true = np.array([model.langs.index(x) for x in got["lang"].to_pylist()])
    best, right = ce.min(1), ce.argmin(1) == true
    if right.any():
        spread = float(np.median(np.abs(best - np.median(best[right]))[right] * np.sqrt(n[right]))) * 1.5
        model.b = 6 * spread
        least = best - model.b / np.sqrt(n)
        seen = np.unique(true[right])
        for j in seen:
            middle, high = np.quantile(least[right & (true == j)], [0.5, QUANTILE], method="lower")
            model.a[j] = high + TAIL * (high - middle) + MARGIN
        # no held-back document of a language was told: the widest of the others
        model.a[np.setdiff1d(np.arange(len(model.langs)), seen)] = model.a[seen].max()
    heats = 2.0 ** np.arange(-6, 7)
    losses = [-np.log(np.maximum(_soft(ce, n, t)[np.arange(len(true)), true], 1e-12)).mean() for t in heats]
    model.heat = float(heats[int(np.argmin(losses))])
    return model


def _soft(ce, n, heat):
    z = -ce * np.minimum(n, 1000.0)[:, None] * np.log(2) / heat
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, rejected)``, one row per row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b, (lang, score, rejected) in judged(batches, shared.value):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(lang), pa.array(score), pa.array(rejected)],
                                             names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                      F.coalesce(_fold(F.col("doc_id").cast("long")) == 2, F.lit(False)).alias("held_out"))
    return map_texts(src, run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def judged(batches, model: Model | None, column: str = "text"):
    """Each piece of the batches with ``(language, score, rejected)`` per row."""
    scorer = Scorer(model) if model else None
    for b in by_bytes(batches, column, CHUNK):
        values = texts(b, column)
        if scorer is None:
            yield b, (["und"] * len(values), [0.0] * len(values), [True] * len(values))
            continue
        ce, n = scorer.entropies(values)
        best = ce.argmin(1)
        some = n > 0
        score = np.where(some, _soft(ce, n, model.heat)[np.arange(len(best)), best], 0.0)
        out = ~some | (ce.min(1) > model.a[best] + model.b / np.sqrt(np.maximum(n, 1.0)))
        yield b, ([model.langs[i] if s else "und" for i, s in zip(best, some)], score.tolist(), out.tolist())


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` that are not rejected, all columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b, (_, _, rejected) in judged(batches, shared.value):
            yield b.filter(pa.array([not r for r in rejected]))

    return map_texts(docs, run, docs.schema)
