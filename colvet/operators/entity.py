"""Entity keys: which reconstructed customer key is real?

A candidate key is a text paste of columns (plus an optional spell start day).
Its groups are judged by label purity against what the same group *sizes*
give under a label shuffle. Everything reduces to ``groupBy(uid)`` (partial
aggregation absorbs a hot key) and then to the size histogram.

Purity null mean, exact: a multi-row group of size n is pure under a shuffle
of N labels with K positives with probability
``[C(N-K, n) + C(K, n)] / C(N, n)``; the mean over groups needs only the size
histogram. The quantile and p-value still need draws: every draw deals the
positives down a tree over the size histogram, whose leaves deal to groups.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.columns import day_of
from ..operators.binning import type7_quantiles
from ..plans.cumulative import cumulative
from ..plans.dealing import deal, marked_places, seeded
from ..session import cut_lineage
from .forensic import gini_from_histogram


def entity_uid(columns, anchor: str | None = None, time: str = "t", null_anchor: str = "keep"):
    """Key column: parts joined by ``|``; null when any key column is null.

    With an anchor ("days since" column) the spell start day
    ``floor(t/86400) - anchor`` is appended; a null anchor writes ``NA`` into
    the key (rows share one spell) unless ``null_anchor='drop'``.
    """
    parts = [F.col(c).cast("string") for c in columns]
    if anchor is not None:
        start = (day_of(time) - F.col(anchor)).cast("long").cast("string")
        parts.append(F.coalesce(start, F.lit("NA")) if null_anchor == "keep" else start)
    key = F.concat_ws("|", *[F.coalesce(p, F.lit("NA")) for p in parts])
    missing = None
    for c in columns:
        m = F.col(c).isNull()
        missing = m if missing is None else (missing | m)
    if anchor is not None and null_anchor == "drop":
        missing = missing | F.col(anchor).isNull()
    return F.when(missing, F.lit(None).cast("string")).otherwise(key)


def groups(frame: DataFrame, uid, label: str) -> DataFrame:
    ok = frame.where(uid.isNotNull() & F.col(label).isNotNull())
    return ok.groupBy(uid.alias("uid")).agg(F.count(F.lit(1)).alias("n"),
                                             F.sum(F.col(label)).cast("long").alias("pos"))


def group_summary(g: DataFrame) -> DataFrame:
    return g.agg(F.count(F.lit(1)).alias("groups"),
                 F.count(F.when(F.col("n") > 1, F.lit(1))).alias("multi_groups"),
                 (F.count(F.when(F.col("n") == 1, F.lit(1))) / F.count(F.lit(1))).alias("singleton_share"),
                 F.sum("n").alias("rows_covered"))


def purity(g: DataFrame) -> DataFrame:
    m = g.where(F.col("n") > 1)
    pure = (F.col("pos") == 0) | (F.col("pos") == F.col("n"))
    return m.agg(F.avg(pure.cast("double")).alias("pure_share"))


def _none_of(n: int, marked: int, total: int) -> float:
    """Probability that ``n`` rows drawn from ``total`` hold none of ``marked``: the
    product of ``1 - marked / (total - i)``, as a sum of logarithms in blocks."""
    if n > total - marked:
        return 0.0
    log = 0.0
    for i in range(0, n, 65536):
        left = total - np.arange(i, min(n, i + 65536), dtype=np.float64)
        log += float(np.log1p(-marked / left).sum())
        if log < -745.0:
            return 0.0
    return math.exp(log)


@F.pandas_udf(DoubleType())
def pure_probability(size: pd.Series, rows: pd.Series, positives: pd.Series) -> pd.Series:
    out = []
    for n, N, K in zip(size, rows, positives):
        n, N, K = int(n), int(N), int(K)
        out.append(_none_of(n, K, N) + _none_of(n, N - K, N))
    return pd.Series(out, dtype="float64")


def purity_null_mean(g: DataFrame) -> DataFrame:
    """Exact expected pure share of multi-row groups under a label shuffle."""
    tot = g.agg(F.sum("n").alias("N"), F.sum("pos").alias("K")).withColumn("_one", F.lit(1))
    hist = (g.where(F.col("n") > 1).groupBy(F.col("n").alias("size")).agg(F.count(F.lit(1)).alias("m"))
             .withColumn("_one", F.lit(1)))
    h = hist.join(tot, "_one")
    h = h.withColumn("p", pure_probability(F.col("size"), F.col("N"), F.col("K")))
    return h.agg((F.sum(F.col("m") * F.col("p")) / F.sum("m")).alias("null_mean"))


#: Rows of equal groups that one leaf of the dealing tree holds (a larger group is a leaf of its own).
LEAF_ROWS = 16384
#: Draws that a leaf handles at once.
DRAWS_AT_ONCE = 32


def _leaves(g: DataFrame, key: str) -> DataFrame:
    """``(key, leaf, size, groups, rows)``: groups of one size, up to LEAF_ROWS rows of them to a leaf;
    the groups of one row, which are not judged, are leaf 0."""
    hist = g.groupBy(key, F.col("n").alias("size")).agg(F.count(F.lit(1)).alias("m"))
    per = F.greatest(F.lit(1), F.floor(F.lit(LEAF_ROWS) / F.col("size"))).cast("long")
    multi = hist.where("size > 1").withColumn("per", per).withColumn("parts", F.ceil(F.col("m") / F.col("per")).cast("long"))
    # one row per distinct size: at most the square root of twice the rows
    first = F.sum("parts").over(Window.partitionBy(key).orderBy("size").rowsBetween(Window.unboundedPreceding, -1))
    multi = multi.withColumn("first", F.coalesce(first, F.lit(0))).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    groups = F.least(F.col("per"), F.col("m") - F.col("part") * F.col("per"))
    leaves = multi.select(key, (1 + F.col("first") + F.col("part")).alias("leaf"), "size", groups.alias("groups"), (groups * F.col("size")).alias("rows"))
    single = hist.where("size = 1").select(key, F.lit(0).cast("long").alias("leaf"), "size", F.lit(0).cast("long").alias("groups"), F.col("m").alias("rows"))
    return leaves.unionByName(single)


def _pure_in_leaf(size: int, groups: int, got: np.ndarray, rng) -> np.ndarray:
    """Pure ones among equal groups, per draw of ``got`` positives over their rows."""
    if groups == 1:
        return ((got == 0) | (got == size)).astype(np.int64)
    out = []
    for lo in range(0, len(got), DRAWS_AT_ONCE):
        pos = marked_places(size * groups, got[lo:lo + DRAWS_AT_ONCE], rng).reshape(-1, groups, size).sum(axis=2)
        out.append(((pos == 0) | (pos == size)).sum(axis=1))
    return np.concatenate(out)


def purity_null_draws(g: DataFrame, draws: int = 200, seed: int = 0, key: str = "candidate") -> DataFrame:
    """``(key, draw, share)``: pure share of multi-row groups under label shuffles, for every
    ``key`` of ``g`` (key, n, pos) at once. Positives are dealt down a tree of equal-sized
    groups (``plans/dealing.py``); a leaf deals its own to single groups."""
    leaves = cut_lineage(_leaves(g, key))
    marked = g.groupBy(key).agg(F.sum("pos").alias("marked"))
    dealt = deal(leaves.select(key, "leaf", "rows"), marked, draws, seed, key)
    each = leaves.where("groups > 0").select(F.col(key).alias("of"), F.col("leaf").alias("at"), "size", "groups").join(
        dealt, (F.col("of") == F.col(key)) & (F.col("at") == F.col("leaf")))

    def run(batches):
        for pdf in batches:
            parts = [pd.DataFrame({key: k, "draw": np.arange(draws), "pure": _pure_in_leaf(
                int(s), int(m), np.asarray(got, np.int64), seeded(seed, k, 2**32 - 1, int(at)))})
                for k, at, s, m, got in zip(pdf[key], pdf["at"], pdf["size"], pdf["groups"], pdf["got"])]
            if parts:
                yield pd.concat(parts)

    kind = g.schema[key].dataType.simpleString()
    pure = each.select(key, "at", "size", "groups", "got").mapInPandas(run, f"{key} {kind}, draw int, pure long")
    total = g.where("n > 1").groupBy(key).agg(F.count(F.lit(1)).alias("multi"))
    return pure.groupBy(key, "draw").agg(F.sum("pure").alias("pure")).join(total, key).select(key, "draw", (F.col("pure") / F.col("multi")).alias("share"))


def purity_p_values(g: DataFrame, draws: int = 200, seed: int = 0, key: str = "candidate") -> DataFrame:
    """``(key, pure_share, null_q99, p_value)``: observed pure share, 99 % quantile of the shuffles and
    one-sided p ``(1 + #{null >= observed}) / (B + 1)``."""
    pure = (F.col("pos") == 0) | (F.col("pos") == F.col("n"))
    obs = g.where(F.col("n") > 1).groupBy(key).agg(F.avg(pure.cast("double")).alias("pure_share"))
    d = purity_null_draws(g, draws, seed, key).join(obs, key)
    ge = F.count(F.when(F.col("share") >= F.col("pure_share"), 1))
    null = d.groupBy(key).agg(F.percentile("share", 0.99).alias("null_q99"), ((1 + ge) / (F.count(F.lit(1)) + 1)).alias("p_value"))
    return obs.join(null, key, "left")


def purity_null(g: DataFrame, draws: int = 200, seed: int = 0) -> DataFrame:
    """Observed pure share, exact null mean, q99 and p-value of one key's groups."""
    one = purity_p_values(g.withColumn("candidate", F.lit("key")), draws, seed).withColumn("_one", F.lit(1))
    mean = purity_null_mean(g).withColumn("_one", F.lit(1))
    return one.join(mean, "_one").select("pure_share", "null_mean", "null_q99", "p_value")


def coverage(frame: DataFrame, uid, time: str) -> DataFrame:
    """Rows covered, entities, median size, Gini, median span (days),
    multi-row share -- from the per-entity table and its histograms."""
    per = frame.groupBy(uid.alias("uid")).agg(F.count(F.lit(1)).alias("rows"),
                                               ((F.max(time) - F.min(time)) / F.lit(86400.0)).alias("span"))
    return coverage_from_entities(per)


def coverage_from_entities(per: DataFrame) -> DataFrame:
    """Coverage figures from (uid, rows, span); the null uid row holds the
    rows without a key."""
    covered = per.where(F.col("uid").isNotNull()).select("uid", F.col("rows").alias("n"), "span")
    rows = per.agg(F.sum("rows").alias("rows")).withColumn("_one", F.lit(1))
    hist = covered.groupBy(F.col("n").alias("size")).agg(F.count(F.lit(1)).alias("m"))
    gini = gini_from_histogram(hist).withColumn("_one", F.lit(1))
    ent = covered.agg(F.count(F.lit(1)).alias("entities"), F.sum("n").alias("covered_rows"),
                      (F.count(F.when(F.col("n") > 1, F.lit(1))) / F.count(F.lit(1))).alias("multi_row_share")) \
                 .withColumn("_one", F.lit(1))
    sizes = hist.select(F.lit(1).alias("_one"), F.col("size").cast("double").alias("vnum"),
                        F.col("m").alias("c"))
    sizes = sizes.join(ent.select("_one", F.col("entities").alias("nonnull")), "_one")
    med_size = type7_quantiles(sizes, ["_one"], [0.5]).select("_one", F.col("q").alias("median_size"))
    spans = covered.groupBy(F.lit(1).alias("_one"), F.col("span").alias("vnum")).agg(F.count(F.lit(1)).alias("c"))
    spans = spans.join(ent.select("_one", F.col("entities").alias("nonnull")), "_one")
    med_span = type7_quantiles(spans, ["_one"], [0.5]).select("_one", F.col("q").alias("median_span_days"))
    j = rows.join(ent, "_one").join(gini, "_one").join(med_size, "_one").join(med_span, "_one")
    return j.select((F.col("covered_rows") / F.col("rows")).alias("rows_covered"),
                    F.col("entities").cast("long").alias("entities"), "median_size", "gini",
                    "median_span_days", "multi_row_share")


def verify_key(frame: DataFrame, mine, theirs_col: str) -> DataFrame:
    """Agreement of a candidate key with a supplied key, as partitions.

    A row agrees when both keys are null, or both are set and its group maps
    one-to-one: its candidate group meets exactly one supplied group and that
    supplied group meets exactly one candidate group.
    """
    if theirs_col not in frame.columns:
        raise ValueError(f"`{theirs_col}` is not in the frame; load it by name to compare keys")
    t = frame.select(mine.alias("mine"), F.col(theirs_col).cast("string").alias("theirs"))
    pairs = t.where(F.col("mine").isNotNull() & F.col("theirs").isNotNull()) \
             .groupBy("mine", "theirs").agg(F.count(F.lit(1)).alias("n"))
    m1 = pairs.groupBy("mine").agg(F.count(F.lit(1)).alias("k_mine"))
    t1 = pairs.groupBy("theirs").agg(F.count(F.lit(1)).alias("k_theirs"))
    agree_rows = (pairs.join(m1, "mine").join(t1, "theirs")
                       .where((F.col("k_mine") == 1) & (F.col("k_theirs") == 1))
                       .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("a"))).withColumn("_one", F.lit(1))
    tot = t.agg(F.count(F.lit(1)).alias("rows"),
                F.count(F.when(F.col("mine").isNull() & F.col("theirs").isNull(), F.lit(1))).alias("both_null"),
                F.count(F.when(F.col("mine").isNull(), F.lit(1))).alias("null_mine"),
                F.count(F.when(F.col("theirs").isNull(), F.lit(1))).alias("null_theirs"),
                F.countDistinct("mine").alias("groups_here"),
                F.countDistinct("theirs").alias("groups_pipeline")).withColumn("_one", F.lit(1))
    j = tot.join(agree_rows, "_one")
    return j.select(((F.col("a") + F.col("both_null")) / F.col("rows")).alias("agreement"),
                    (F.col("null_mine") / F.col("rows")).alias("null_here"),
                    (F.col("null_theirs") / F.col("rows")).alias("null_pipeline"),
                    F.col("groups_here").cast("long").alias("groups_here"),
                    F.col("groups_pipeline").cast("long").alias("groups_pipeline"))


def history_share(frame: DataFrame, uid, time: str, id_col: str) -> DataFrame:
    """Share of rows with no key / first row of its entity / with prior history.

    Each entity has exactly one first row (earliest time, then id), so the
    first-seen count is the entity count: no window over a possibly huge
    entity is needed.
    """
    t = frame.select(uid.alias("uid"))
    return t.agg(
        (F.count(F.when(F.col("uid").isNull(), F.lit(1))) / F.count(F.lit(1))).alias("no_key"),
        (F.countDistinct("uid") / F.count(F.lit(1))).alias("first_seen"),
        ((F.count("uid") - F.countDistinct("uid")) / F.count(F.lit(1))).alias("has_history"))


def compare_keys(frame: DataFrame, candidates: dict, label: str, time: str,
                 draws: int = 0) -> DataFrame:
    """Candidate keys side by side, lift of purity over the exact null mean; with
    ``draws`` label shuffles also the null's 99 % quantile and the p-value.

    One pass over the rows for every candidate: each row yields one
    (candidate, key) pair per candidate, reduced at once to one row per entity
    (size, labelled size, positives, span) and written to the checkpoint
    folder. Purity, the null mean, Gini and the medians are then computed with
    the candidate as a group key.
    """
    names = list(candidates)
    pairs = F.array(*[F.struct(F.lit(n).alias("candidate"),
                               entity_uid(candidates[n][0], candidates[n][1], time).alias("uid"))
                      for n in names])
    long = frame.select(F.col(label).alias("_y"), F.col(time).alias("_t"), F.inline(pairs))
    per = cut_lineage(long.groupBy("candidate", "uid").agg(
        F.count(F.lit(1)).alias("rows"), F.count("_y").alias("n"),
        F.sum("_y").cast("long").alias("pos"),
        ((F.max("_t") - F.min("_t")) / F.lit(86400.0)).alias("span")))
    k = ["candidate"]
    g = per.where(F.col("uid").isNotNull() & (F.col("n") > 0))
    summ = g.groupBy(*k).agg((F.count(F.when(F.col("n") == 1, F.lit(1))) / F.count(F.lit(1))).alias("singleton_share"))
    pure = (F.col("pos") == 0) | (F.col("pos") == F.col("n"))
    pur = g.where(F.col("n") > 1).groupBy(*k).agg(F.avg(pure.cast("double")).alias("pure_share"))
    tot = g.groupBy(*k).agg(F.sum("n").alias("N"), F.sum("pos").alias("K"))
    hist_m = g.where(F.col("n") > 1).groupBy(*k, F.col("n").alias("size")).agg(F.count(F.lit(1)).alias("m"))
    nm = (hist_m.join(tot, k).withColumn("p", pure_probability(F.col("size"), F.col("N"), F.col("K")))
                .groupBy(*k).agg((F.sum(F.col("m") * F.col("p")) / F.sum("m")).alias("null_mean")))
    # coverage
    rows_all = per.groupBy(*k).agg(F.sum("rows").alias("all_rows"))
    covered = per.where(F.col("uid").isNotNull())
    ent = covered.groupBy(*k).agg(F.count(F.lit(1)).alias("entities"), F.sum("rows").alias("covered_rows"),
                                  (F.count(F.when(F.col("rows") > 1, F.lit(1))) / F.count(F.lit(1))).alias("multi_row_share"))
    hist = covered.groupBy(*k, F.col("rows").alias("size")).agg(F.count(F.lit(1)).alias("m"))
    cum = cumulative(hist, k, "size", ["m"])
    gini = (cum.select(*k, (F.col("size") * (F.col("m") * F.col("m_below") + F.col("m") * (F.col("m") + 1) / 2.0)).alias("ix"),
                       (F.col("size") * F.col("m")).alias("x"), "m")
               .groupBy(*k).agg(((2 * F.sum("ix") / F.sum("x") - (F.sum("m") + 1)) / F.sum("m")).alias("gini")))
    sizes = hist.select(*k, F.col("size").cast("double").alias("vnum"), F.col("m").alias("c")) \
                .join(ent.select(*k, F.col("entities").alias("nonnull")), k)
    med_size = type7_quantiles(sizes, k, [0.5]).select(*k, F.col("q").alias("median_size"))
    spans = covered.groupBy(*k, F.col("span").alias("vnum")).agg(F.count(F.lit(1)).alias("c")) \
                   .join(ent.select(*k, F.col("entities").alias("nonnull")), k)
    med_span = type7_quantiles(spans, k, [0.5]).select(*k, F.col("q").alias("median_span_days"))
    comps = frame.sparkSession.createDataFrame(
        [(n, " + ".join(list(candidates[n][0]) + ([candidates[n][1]] if candidates[n][1] else []))) for n in names],
        "candidate string, components string")
    r = (comps.join(rows_all, k).join(ent, k).join(gini, k).join(med_size, k).join(med_span, k)
              .join(summ, k, "left").join(pur, k, "left").join(nm, k, "left"))
    r = r.select("candidate", "components", (F.col("covered_rows") / F.col("all_rows")).alias("rows_covered"),
                 F.col("entities").cast("long").alias("entities"), "median_size", "singleton_share", "gini",
                 "median_span_days", "pure_share", "null_mean",
                 (F.col("pure_share") - F.col("null_mean")).alias("lift_over_null"))
    if draws:
        r = r.join(purity_p_values(g.select("candidate", "n", "pos"), draws).drop("pure_share"), "candidate", "left")
    return r
