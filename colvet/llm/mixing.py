"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source starts with the same expected number of copies,
target / size of its source. The whole part is given to each; the fractional
parts are rounded by the pivotal method: two parties with fractional copies
trade expected words at random until one of them is integral, so that each
document's expectation stays and the source's total of words never moves.

Documents above ``HEAVY`` of their source go first, from long to short: each trades
with all shorter ones together, so it becomes integral at once and the shorter
ones take up its residual, an equal part of a copy each. The others trade one to one:
each hash bucket of a source is settled on its own and passes on one undecided
document; these are settled again in a tree of groups of ``FAN`` until one is
left per source, which a last draw decides. A source's words so miss its target by
less than one document that holds at most ``HEAVY`` of the source; where all its
documents are longer than that, by less than its shortest. (Where the shorter ones
reach 0 copies or the cap they have nothing left to trade: then the document in
hand is drawn.)

The random numbers come from seeded hashes of the documents, and buckets from
their content, so reruns agree however the input is partitioned.

Defined results: a null or blank text has size 0 and takes nothing; a null
source is a source, ordered last; equal rows are interchangeable (the copies
go to them in one fixed order). A source of size 0 has target 0. Extra columns
travel along in ``copies``. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_word_count, materialize

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
BUCKET = 20_000
#: Share of its source above which a document is settled against all shorter ones (so at most 1 / HEAVY of a source are).
HEAVY = 1e-3
FAN = 4096
SEED = 5
#: Below this distance from an integer a copy number is integral.
TINY = 1e-12


def targets(sizes: list, weights=WEIGHTS, cap: float = CAP) -> dict:
    """``source -> target`` words. ``sizes``: ``(source, size)`` per source. Weights go
    to the sources by code point, null last, over and over; no target exceeds
    ``cap`` times its source's size, and what is cut goes to the others by weight."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    w = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size = {s: n for s, n in order}
    total, out, free = float(sum(size.values())), {}, [s for s, _ in order]
    while free:
        left = total - sum(out.values())
        unit = left / sum(w[s] for s in free)
        over = [s for s in free if unit * w[s] > cap * size[s]]
        if not over:
            out |= {s: unit * w[s] for s in free}
            break
        out |= {s: cap * size[s] for s in over}
        free = [s for s in free if s not in out]
    return out


def pivot(p: np.ndarray, size: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Round fractions ``p`` in order, keeping ``sum(p * size)``: the document in
    hand meets the next one; one of the two becomes 0 or 1, the other goes on.
    Returns the rounded values; at most one stays fractional."""
    out = p.tolist()
    s, r = size.tolist(), u.tolist()
    held = -1
    for i, q in enumerate(out):
        if not TINY < q < 1 - TINY:
            out[i] = float(round(q))
            continue
        if held < 0:
            held = i
            continue
        a, b = out[held], q
        sa, sb = s[held], s[i]
        # words that can move from i to held, and from held to i
        up, down = min((1 - a) * sa, b * sb), min(a * sa, (1 - b) * sb)
        d = up if r[i] * (up + down) < down else -down
        a, b = a + d / sa, b - d / sb
        a = 0.0 if a <= TINY else 1.0 if a >= 1 - TINY else a
        b = 0.0 if b <= TINY else 1.0 if b >= 1 - TINY else b
        out[held], out[i] = a, b
        if 0 < b < 1:
            held = i
        elif not 0 < a < 1:
            held = -1
    return np.array(out)


def heavy(n: np.ndarray, size: np.ndarray, u: np.ndarray, f: float, total: float, cap: float = CAP) -> tuple:
    """``(copies, rest)``: copies of each heavy document (``n`` equal rows of ``size`` words, ordered from
    long to short) and the copies then expected of every other one. ``f`` copies are
    expected of each, ``total`` words are in the source."""
    copies, left = np.zeros(len(n)), float(total)
    for i, (k, s) in enumerate(zip(n.tolist(), size.tolist())):
        left -= k * s
        whole = np.floor(f * k + TINY)
        a = max(0.0, f * k - whole)
        if a <= TINY or a >= 1 - TINY:
            copies[i] = whole + round(a)
            continue
        # words that can come from the shorter ones, and go to them
        up, down = min((1 - a) * s, f * left), min(a * s, (cap - f) * left)
        if up + down > 0:
            d = up if u[i] * (up + down) < down else -down
            a, f = a + d / s, min(cap, max(0.0, f - d / left))
        if TINY < a < 1 - TINY:  # the shorter ones have nothing left to trade
            a = float(_again(u[i]) < a)
        copies[i] = whole + round(a)
    return copies, f


def _again(u: float) -> float:
    """A second random number made from ``u``."""
    return (u * 1_000_003.0 + 0.123456789) % 1.0


def _settle_heavy(cap: float):
    def run(pdf):
        pdf = pdf.sort_values(["size", "key"], ascending=[False, True], kind="stable")
        copies, rest = heavy(pdf.n_rows.to_numpy(), pdf["size"].to_numpy(np.float64), pdf.u.to_numpy(), float(pdf.f.iloc[0]),
                             float(pdf.source_size.iloc[0]), cap)
        return pdf.assign(whole=copies.astype(np.int64), p=0.0, rest=rest)
    return run


def _settle(pdf):
    pdf = pdf.sort_values(["size", "key"], ascending=[False, True], kind="stable")
    return pdf.assign(p=pivot(pdf.p.to_numpy(), pdf["size"].to_numpy(np.float64), pdf.u.to_numpy()))


def _keyed(df: DataFrame, seed: int) -> tuple:
    """Size, and a hash of what makes rows equal here: id, source, and the text by
    its size and checksum."""
    text = F.col("text").cast("string")
    size = ascii_word_count(text)
    return size, F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.crc32(text), size, F.col("source").cast("string"))


def allocate(df: DataFrame, weights=WEIGHTS, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """``(key, doc_id, source, size, source_size, target, n_rows, copies)``, one row per
    group of ``n_rows`` equal rows; ``copies`` is what the group gives in all."""
    size, key = _keyed(df, seed)
    rows = df.select(F.col("doc_id").cast("string").alias("doc"), F.col("source").cast("string").alias("source"),
                     size.alias("size"), key.alias("key"))
    rows = materialize(rows.groupBy("key", "doc", "source", "size").agg(F.count(F.lit(1)).alias("n_rows")), "sizes")
    per = [(r["source"], r["size"], r["n"]) for r in rows.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n_rows")).alias("size"), F.count(F.lit(1)).alias("n")).collect()]  # one row per source
    goal = targets([(s, n) for s, n, _ in per], weights, cap)
    plan = df.sparkSession.createDataFrame(
        [(s, int(n), float(goal[s]), goal[s] / n if n else 0.0, -(-c // BUCKET)) for s, n, c in per],
        "psource string, source_size long, target double, f double, buckets long")
    rows = rows.join(F.broadcast(plan), rows["source"].eqNullSafe(plan["psource"])).drop("psource")
    rows = rows.withColumn("u", F.pmod(F.xxhash64(F.lit(seed + 1), "key"), F.lit(2**53)) / F.lit(float(2**53)))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 2), "key"), "buckets"))
    long = F.col("size") > HEAVY * F.col("source_size")
    zero = [F.lit(0).cast("long").alias("whole"), F.lit(0.0).alias("p")]
    names = ["key", "doc", "source", "size", "source_size", "target", "n_rows", *zero, "u", "bucket", "f"]
    longs = rows.where(long).select(*names, F.lit(0.0).alias("rest"))
    longs = materialize(longs.groupBy("source").applyInPandas(_settle_heavy(cap), longs.schema), "heavy")
    rest = longs.groupBy(F.col("source").alias("rsource")).agg(F.first("rest").alias("rest"))  # one row per source
    rows = rows.where(~long).join(F.broadcast(rest), rows["source"].eqNullSafe(rest["rsource"]), "left")
    rows = rows.withColumn("all", F.when(F.col("size") > 0, F.coalesce("rest", "f") * F.col("n_rows")).otherwise(F.lit(0.0)))
    rows = rows.withColumn("whole", F.floor("all").cast("long")).withColumn("p", F.col("all") - F.col("whole"))
    rows = rows.select("key", "doc", "source", "size", "source_size", "target", "n_rows", "whole", "p", "u", "bucket")
    types = rows.schema
    done = materialize(rows.groupBy("source", "bucket").applyInPandas(_settle, types), "settled")
    parts, width = [], max((-(-c // BUCKET) for *_, c in per), default=0)
    while width > 1:  # the tree: FAN buckets' left-over documents meet in one
        parts.append(done.where("p = 0 or p = 1"))
        up = done.where("p > 0 and p < 1").withColumn("bucket", F.floor(F.col("bucket") / FAN).cast("long"))
        done = materialize(up.groupBy("source", "bucket").applyInPandas(_settle, types), "settled")
        width = -(-width // FAN)
    for d in [*parts, longs.drop("f", "rest")]:
        done = done.unionByName(d)
    last = F.when(F.col("p").isin(0.0, 1.0), F.col("p")).otherwise((F.col("u") < F.col("p")).cast("double"))
    return done.select("key", F.col("doc").cast("long").alias("doc_id"), "source", "size", "source_size", "target", "n_rows",
                       (F.col("whole") + last.cast("long")).alias("copies"))


def shares(allocated: DataFrame) -> DataFrame:
    """One row per row: ``(doc_id, source, size, source_size, target, copies, taken)``;
    a group's copies are dealt out evenly to its rows."""
    i = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows")))
    n = F.floor(F.col("copies") / F.col("n_rows")) + (F.col("i") <= F.col("copies") % F.col("n_rows")).cast("long")
    return (allocated.withColumn("i", i).withColumn("copies", n.cast("long"))
            .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")))


def mix(df: DataFrame, weights=WEIGHTS, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """The mix itself: each row of ``df``, all columns, as often as its copies say."""
    given = allocate(df, weights, cap, seed).where("copies > 0").select(
        F.col("key").alias("_mix_key"), F.col("n_rows").alias("_mix_rows"), F.col("copies").alias("_mix_copies"))
    j = df.withColumn("_mix_key", _keyed(df, seed)[1]).join(given, "_mix_key")
    n = F.row_number().over(Window.partitionBy("_mix_key").orderBy(F.col("_mix_copies")))
    j = j.withColumn("_mix_n", F.floor(F.col("_mix_copies") / F.col("_mix_rows"))
                     + (n <= F.col("_mix_copies") % F.col("_mix_rows")).cast("long"))
    j = j.withColumn("_mix_n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_mix_n").cast("long")))).where("_mix_n > 0")
    return j.select(*df.columns)
