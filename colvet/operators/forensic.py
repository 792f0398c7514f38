"""Forensic passes: Benford, daily rate and level breaks, hour-of-day profile,
Rayleigh test, concentration (Gini, HHI), power-law tail.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import day_of, hour_angle, hour_of, leading_digit
from ..functions.dist import p_chi2
from ..plans.cumulative import cumulative
from ..session import cut_lineage
from ..sources.frames import FrameSpec


def benford(frame: DataFrame, spec: FrameSpec, column: str = "value", with_p: bool = False) -> DataFrame:
    """Leading-digit shares of positive ``column`` among positives (label 1),
    against log10(1 + 1/d); MAD and chi-squared on 8 degrees of freedom."""
    x = frame.where((F.col(spec.label) == 1) & (F.col(column) > 0)).select(leading_digit(column).alias("digit"))
    counts = x.groupBy("digit").agg(F.count(F.lit(1)).alias("n"))
    digits = frame.sparkSession.range(1, 10).select(F.col("id").cast("int").alias("digit"))
    d = digits.join(counts, "digit", "left").fillna(0, ["n"])
    w = Window.partitionBy()
    d = d.select("digit", "n",
                 F.try_divide(F.col("n"), F.sum("n").over(w)).alias("observed"),
                 F.log10(F.lit(1.0) + F.lit(1.0) / F.col("digit")).alias("expected"),
                 F.sum("n").over(w).alias("_tot"))
    d = d.select("*",
                 F.avg(F.abs(F.col("observed") - F.col("expected"))).over(w).alias("mad"),
                 F.sum(F.try_divide((F.col("n") - F.col("_tot") * F.col("expected")) ** 2,
                                    F.col("_tot") * F.col("expected"))).over(w).alias("chi2")).drop("_tot")
    if with_p:
        d = d.withColumn("p_value", p_chi2(F.col("chi2"), F.lit(8.0)))
    return d


def daily_rate(frame: DataFrame, spec: FrameSpec, min_n: int = 200) -> DataFrame:
    g = frame.groupBy(day_of(spec.time).cast("long").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(spec.label).alias("rate"))
    return g.where(F.col("n") > min_n)


def hour_profile(frame: DataFrame, spec: FrameSpec) -> DataFrame:
    return frame.groupBy(F.floor(hour_of(spec.time)).cast("int").alias("hour")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(spec.label).alias("rate"))


def rayleigh(frame: DataFrame, spec: FrameSpec, by=None) -> DataFrame:
    """Rayleigh test of uniformity of the positives' hour angle: mean resultant
    length R, p-value (series approximation), circular mean hour."""
    pos = frame.where(F.col(spec.label) == 1).select(*( [by] if by else []), hour_angle(spec.time).alias("a"))
    keys = [by] if by else []
    g = pos.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.cos("a")).alias("c"),
                               F.avg(F.sin("a")).alias("s"))
    rbar = F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s"))
    g = g.withColumn("r", rbar).withColumn("z", F.col("n") * F.col("r") * F.col("r"))
    z, n = F.col("z"), F.col("n")
    p = F.exp(-z) * (F.lit(1.0) + (2 * z - z * z) / (4 * n)
                     - (24 * z - 132 * z * z + 76 * z * z * z - 9 * z * z * z * z) / (288 * n * n))
    peak = F.pmod(F.atan2(F.col("s"), F.col("c")), F.lit(2 * math.pi)) * F.lit(24 / (2 * math.pi))
    return g.select(*keys, "n", "r", p.alias("p_value"), peak.alias("peak_hour"))


def size_histogram(groups: DataFrame, size_col: str = "n") -> DataFrame:
    """(size, groups with that size): the whole concentration story in a table
    no bigger than the number of distinct group sizes."""
    return groups.groupBy(F.col(size_col).alias("size")).agg(F.count(F.lit(1)).alias("m"))


def gini_from_histogram(hist: DataFrame) -> DataFrame:
    """Uncorrected Gini  sum (2i - n - 1) x_(i) / (n sum x)  over sorted sizes,
    from the histogram with exact cumulative group counts."""
    c = cumulative(hist, [], "size", ["m"])
    # sizes ranked b+1..b+m within a histogram row: sum of ranks = m*b + m(m+1)/2
    t = c.select((F.col("size") * (F.col("m") * F.col("m_below") + F.col("m") * (F.col("m") + 1) / 2.0)).alias("ix"),
                 (F.col("size") * F.col("m")).alias("x"), F.col("m"))
    a = t.agg(F.sum("ix").alias("six"), F.sum("x").alias("sx"), F.sum("m").alias("n"))
    g = (2 * F.col("six") / F.col("sx") - (F.col("n") + 1)) / F.col("n")
    return a.select(g.alias("gini"), F.col("n").alias("groups"))


def concentration(frame: DataFrame, key) -> DataFrame:
    """Clients, Gini of transactions per client, HHI, share seen exactly once."""
    per = frame.groupBy(key.alias("uid")).agg(F.count(F.lit(1)).alias("n"))
    hist = size_histogram(per)
    gini = gini_from_histogram(hist).withColumn("_one", F.lit(1))
    tot = hist.agg(F.sum(F.col("size") * F.col("m")).alias("rows"), F.sum("m").alias("clients"),
                   F.sum(F.when(F.col("size") == 1, F.col("m")).otherwise(0)).alias("once"),
                   F.sum(F.col("m") * F.col("size") * F.col("size")).alias("s2")).withColumn("_one", F.lit(1))
    # two one-row tables, joined on a constant key
    return tot.join(gini, "_one").select(
        F.col("clients").cast("long").alias("clients"), "gini",
        (F.col("s2") / (F.col("rows") * F.col("rows"))).alias("hhi"),
        (F.col("once") / F.col("clients")).alias("once_share"))


# ---------------------------------------------------------------- breaks ---
def _segment_ssr(prefix, prefix2, i, j):
    n = j - i
    s = prefix[j] - prefix[i]
    return (prefix2[j] - prefix2[i]) - s * s / n


def bai_perron_mean(y: np.ndarray, h_frac: float = 0.1):
    """Optimal mean-shift breakpoints by dynamic programming over segment SSR
    (prefix sums), minimum segment length h = floor(h_frac * n); number of breaks by
    BIC, up to ceil(n / h) - 2."""
    n = len(y)
    h = max(1, int(math.floor(h_frac * n)))
    if n < 2 * h:
        return [], 0
    p1 = np.concatenate([[0.0], np.cumsum(y)])
    p2 = np.concatenate([[0.0], np.cumsum(y * y)])
    max_m = max(0, -(-n // h) - 2)
    inf = float("inf")
    # cost[m][j]: best SSR of y[:j] in m+1 segments; arg for backtracking
    cost = np.full((max_m + 1, n + 1), inf)
    arg = np.full((max_m + 1, n + 1), -1)
    ends = np.arange(h, n + 1)
    cost[0][h:] = _segment_ssr(p1, p2, 0, ends)
    for m in range(1, max_m + 1):
        for j in range((m + 1) * h, n + 1):
            starts = np.arange(m * h, j - h + 1)
            c = cost[m - 1][starts] + _segment_ssr(p1, p2, starts, j)
            k = int(np.argmin(c))
            cost[m][j], arg[m][j] = c[k], starts[k]
    bic = []
    for m in range(0, max_m + 1):
        rss = cost[m][n]
        k = (m + 1) + m + 1  # segment means, break dates, variance
        bic.append(n * math.log(max(rss, 1e-300) / n) + k * math.log(n) if rss < inf else inf)
    m_best = int(np.argmin(bic))
    breaks, j = [], n
    for m in range(m_best, 0, -1):
        i = int(arg[m][j])
        breaks.append(i)
        j = i
    return sorted(breaks), m_best


def level_breaks(frame: DataFrame, spec: FrameSpec, series_key: str | None = None,
                 min_n: int = 200, h_frac: float = 0.1) -> DataFrame:
    """Bai-Perron mean breaks in the daily rate (days with n > min_n), one
    series per ``series_key`` value (plus the pooled series ``__all__``); each
    series is a few hundred days, solved in its own task."""
    day = day_of(spec.time).cast("long").alias("day")
    key = F.coalesce(F.col(series_key).cast("string"), F.lit("__null__")) if series_key else F.lit("__all__")
    per = frame.groupBy(key.alias("series"), day).agg(F.count(F.lit(1)).alias("n"),
                                                      F.avg(spec.label).alias("rate"))
    if series_key:
        pooled = frame.groupBy(F.lit("__all__").alias("series"), day).agg(
            F.count(F.lit(1)).alias("n"), F.avg(spec.label).alias("rate"))
        per = per.unionByName(pooled)
    per = per.where(F.col("n") > min_n)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day")
        br, m = bai_perron_mean(pdf["rate"].to_numpy(dtype=float), h_frac)
        days = pdf["day"].to_numpy()
        return pd.DataFrame({"series": [pdf["series"].iloc[0]] * max(1, len(br)),
                             "breaks": [m] * max(1, len(br)),
                             "break_day": [int(days[i - 1]) for i in br] if br else [None]})

    return per.groupBy("series").applyInPandas(solve, "series string, breaks int, break_day long")


# ------------------------------------------------------------- power law ---
#: Buckets of the ordered distinct values: a fixed number, so their ends fit any task.
BUCKETS = 4096
#: Candidates that one task holds against a bucket's values.
CANDIDATES_AT_ONCE = 50_000


class _Ends:
    """First and last value of every bucket, their counts, and cumulative counts
    up to and including them."""

    def __init__(self, rows):
        rows = sorted(rows, key=lambda r: r["bucket"])
        self.bucket = np.array([r["bucket"] for r in rows], np.int64)
        self.first, self.last = (np.array([r[e]["v"] for r in rows], float) for e in ("a", "z"))
        self.c_first, self.c_last = (np.array([r[e]["c"] for r in rows], float) for e in ("a", "z"))
        self.upto_first, self.upto_last = (np.array([r[e]["c_below"] + r[e]["c"] for r in rows], float) for e in ("a", "z"))


def _fit(v, xmin, alpha):
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        return 1.0 - (v / xmin) ** (1.0 - alpha)


def _distance(v, c, upto, xmin, alpha, n, before):
    """Largest gap between empirical and fitted tail at each value (both ends of its step)."""
    fit = _fit(v, xmin, alpha)
    return np.maximum(np.abs((upto - before) / n - fit), np.abs((upto - c - before + 1) / n - fit))


def _bounds(e: _Ends, xmin, alpha, n, before) -> tuple:
    """Of one candidate: a lower bound of its distance (the largest at a bucket's end), and per bucket an
    upper bound: empirical and fitted tail both only rise inside a bucket."""
    reach = e.last >= xmin
    gaps = [np.where(v >= xmin, _distance(v, c, u, xmin, alpha, n, before), -np.inf)
            for v, c, u in ((e.first, e.c_first, e.upto_first), (e.last, e.c_last, e.upto_last))]
    start = np.maximum(e.first, xmin)
    low = (np.maximum(e.upto_first - e.c_first, before) - before + 1) / n
    high = (e.upto_last - before) / n
    upper = np.maximum(high - _fit(start, xmin, alpha), _fit(e.last, xmin, alpha) - low)
    return max(gaps[0].max(), gaps[1].max()), np.where(reach, upper, -np.inf)


def _tail_fits(x: DataFrame) -> DataFrame:
    """``(v, c, c_below, bucket, n_tail, alpha)`` per distinct value: the tail from it on, its MLE from
    suffix sums (null where all of the tail is one value)."""
    vc = x.groupBy("v").agg(F.count(F.lit(1)).alias("c")).withColumn("l", F.col("c") * F.log("v")).withColumn("one", F.lit(1).cast("long"))
    t = cumulative(vc, [], "v", ["c", "l", "one"])
    n = (F.col("c_total") - F.col("c_below")).cast("long")
    logs = F.col("l_total") - F.col("l_below") - n * F.log("v")
    bucket = F.floor(F.col("one_below") * F.least(F.lit(BUCKETS), F.col("one_total")) / F.col("one_total")).cast("long")
    rest = F.col("one_below") < F.col("one_total") - 1
    return t.select("v", F.col("c").cast("long").alias("c"), F.col("c_below").cast("long").alias("c_below"), bucket.alias("bucket"),
                    n.alias("n_tail"), F.when(rest & (logs > 1e-12 * n), 1 + n / logs).alias("alpha"))


def _exact(tails: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(xmin, ks)``: the largest distance of each candidate over the buckets that ``pairs`` names
    (bucket, xmin, alpha, n_tail, before). A bucket with many candidates is read by several tasks."""
    pairs = cut_lineage(pairs)
    asked = pairs.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / CANDIDATES_AT_ONCE).cast("long").alias("parts"))
    left = tails.join(asked, "bucket").select("bucket", "v", "c", "c_below", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    right = pairs.join(asked, "bucket").select(F.col("bucket").alias("of"), F.pmod(F.xxhash64("xmin"), "parts").alias("of_part"),
                                               "xmin", "alpha", "n_tail", "before")

    def run(vals: pd.DataFrame, cands: pd.DataFrame) -> pd.DataFrame:
        vals = vals.sort_values("v")
        v, c = vals["v"].to_numpy(float), vals["c"].to_numpy(float)
        upto = vals["c_below"].to_numpy(float) + c
        ks = []
        for xmin, alpha, n, before in zip(cands["xmin"], cands["alpha"], cands["n_tail"], cands["before"]):
            i = int(np.searchsorted(v, xmin))
            ks.append(float(_distance(v[i:], c[i:], upto[i:], xmin, alpha, n, before).max()) if i < len(v) else 0.0)
        return pd.DataFrame({"xmin": cands["xmin"].to_numpy(float), "ks": np.array(ks, float)})

    each = left.groupBy("bucket", "part").cogroup(right.groupBy("of", "of_part")).applyInPandas(run, "xmin double, ks double")
    return each.groupBy("xmin").agg(F.max("ks").alias("ks"))


def power_law(frame: DataFrame, spec: FrameSpec, column: str = "value", xmax: float = 1e5) -> DataFrame:
    """Continuous power-law tail of positive ``column`` among label-1 rows: every
    distinct value up to ``xmax`` but the last is a candidate xmin; alpha is the MLE
    ``1 + n / sum ln(x / xmin)`` over the tail, and the chosen xmin has the
    smallest Kolmogorov-Smirnov distance between the tail's empirical CDF and
    the fitted one (the smaller xmin on ties). ``candidates`` and ``above_xmax``
    tell how many values were candidates and how many ``xmax`` excluded.

    Suffix sums give every alpha. The ends of BUCKETS buckets of values bound every
    candidate's distance from below; the candidate with the least bound is evaluated
    over all values, and only candidates whose bound does not exceed its distance are
    evaluated too, in the buckets that can raise their bound. No value leaves the
    tasks but the buckets' ends. No label-1 value gives no row.
    """
    x = frame.where((F.col(spec.label) == 1) & (F.col(column) > 0)).select(F.col(column).cast("double").alias("v"))
    tails = cut_lineage(_tail_fits(x))
    end = lambda f: f(F.struct("v", "c", "c_below"))
    ends = _Ends(tails.groupBy("bucket").agg(end(F.min).alias("a"), end(F.max).alias("z")).collect())  # at most BUCKETS rows
    cands = tails.where(F.col("alpha").isNotNull() & (F.col("v") <= xmax)).select(
        F.col("v").alias("xmin"), "alpha", "n_tail", F.col("c_below").alias("before"))

    def bounded(batches):
        for pdf in batches:
            pdf["bound"] = [_bounds(ends, *r)[0] for r in zip(pdf["xmin"], pdf["alpha"], pdf["n_tail"], pdf["before"])]
            yield pdf

    base = "xmin double, alpha double, n_tail long, before long, bound double"
    cands = cut_lineage(cands.mapInPandas(bounded, base))
    first = cands.orderBy("bound", "xmin").limit(1)
    buckets = tails.select("bucket").distinct()
    best = _exact(tails, first.select(F.lit(1).alias("_one"), "xmin", "alpha", "n_tail", "before").join(
        buckets.withColumn("_one", F.lit(1)), "_one").drop("_one")).first()
    limit = best["ks"] if best else 0.0

    def needed(batches):
        for pdf in batches:
            rows = []
            for xmin, alpha, n, before, bound in pdf[["xmin", "alpha", "n_tail", "before", "bound"]].itertuples(index=False):
                upper = _bounds(ends, xmin, alpha, n, before)[1]
                rows += [(int(b), xmin, alpha, int(n), int(before)) for b in ends.bucket[upper > bound]]
            yield pd.DataFrame(rows, columns=["bucket", "xmin", "alpha", "n_tail", "before"])

    near = cands.where(F.col("bound") <= F.lit(limit))
    exact = _exact(tails, near.mapInPandas(needed, "bucket long, xmin double, alpha double, n_tail long, before long"))
    fits = near.join(exact, "xmin", "left").withColumn("ks", F.greatest("bound", F.coalesce("ks", "bound")))
    best = fits.agg(F.min_by(F.struct("xmin", "alpha", "n_tail", "ks"), F.struct("ks", "xmin")).alias("b")).where("b is not null").select("b.*")
    known = tails.agg(F.count(F.when(F.col("v") <= xmax, 1)).alias("candidates"), F.count(F.when(F.col("v") > xmax, 1)).alias("above_xmax"))
    return best.withColumn("_one", F.lit(1)).join(known.withColumn("_one", F.lit(1)), "_one").select("xmin", "alpha", "n_tail", "ks", (F.col("alpha") > 3).alias("finite_variance"), "candidates", "above_xmax")
