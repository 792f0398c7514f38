"""Column-expression builders shared by the operators (all JVM-side)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..policy import Z95


def wilson(x, n, z: float = Z95):
    """Wilson score interval of x successes in n trials, clamped to [0, 1].

    Returns (lo, hi) column expressions.
    """
    x = F.col(x) if isinstance(x, str) else x
    n = F.col(n) if isinstance(n, str) else n
    p = x / n
    z2 = z * z
    denom = F.lit(1.0) + F.lit(z2) / n
    centre = (p + F.lit(z2) / (2 * n)) / denom
    half = F.lit(z) * F.sqrt(p * (1 - p) / n + F.lit(z2) / (4 * n * n)) / denom
    return (F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half))


def day_of(t: str | Column):
    t = F.col(t) if isinstance(t, str) else t
    return F.floor(t / F.lit(86400))


def hour_of(t: str | Column):
    """Hour on the 24 h clock as a real number (seconds axis, any origin)."""
    t = F.col(t) if isinstance(t, str) else t
    return F.pmod(t / F.lit(3600.0), F.lit(24.0))


def hour_angle(t: str | Column):
    return hour_of(t) * F.lit(2 * math.pi / 24)


def paste_key(cols, sep: str = "|"):
    """Text key of several columns; a null part is written as ``NA`` (as a
    paste of the parts would), so callers null the key themselves when a key
    column is missing."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in cols]
    return F.concat_ws(sep, *parts)


def null_count(cols):
    """Number of null columns among ``cols`` in each row."""
    return sum((F.col(c).isNull().cast("int") for c in cols), F.lit(0))


def leading_digit(x: str | Column):
    """First significant digit of a positive number (scaled by an exact power of ten)."""
    x = F.col(x) if isinstance(x, str) else x
    k = F.floor(F.log10(x))
    scaled = F.when(k >= 0, x / F.pow(F.lit(10.0), k)).otherwise(x * F.pow(F.lit(10.0), -k))
    return F.floor(scaled).cast("int")


def safe_corr(a: str, b: str):
    """Pearson correlation over the rows where both columns are set; null (not an
    ANSI division error) when one of them is constant there."""
    xa = F.when(F.col(b).isNotNull(), F.col(a))
    xb = F.when(F.col(a).isNotNull(), F.col(b))
    return F.try_divide(F.covar_samp(a, b), F.stddev_samp(xa) * F.stddev_samp(xb))


def corr_long(df, cols):
    """Pairwise-complete Pearson correlation of ``cols`` as rows (a, b, r) for a < b
    (by position); null where a column is constant on the pair's rows.

    Two passes whatever the number of columns: the means (one row), then per
    task the sums, squares, cross-products and counts over rows where both
    columns are set, of values taken from the means; a group-by adds them up.
    """
    cols = list(cols)
    spark = df.sparkSession
    if len(cols) < 2:
        return spark.createDataFrame([], "a string, b string, r double")
    rows = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    first = rows.agg(*[F.avg(f"c{i}").alias(f"c{i}") for i in range(len(cols))]).first()
    means = np.array([first[i] if first[i] is not None and np.isfinite(first[i]) else 0.0 for i in range(len(cols))])
    iu, ju = np.triu_indices(len(cols), 1)

    def partial(it):
        acc = None
        for pdf in it:
            x = pdf.to_numpy(dtype=float) - means
            m = ~np.isnan(x)
            x, m = np.where(m, x, 0.0), m.astype(float)
            sx, sxx = x.T @ m, (x * x).T @ m
            got = np.stack([(m.T @ m)[iu, ju], sx[iu, ju], sx[ju, iu], sxx[iu, ju], sxx[ju, iu], (x.T @ x)[iu, ju]])
            acc = got if acc is None else acc + got
        if acc is not None:
            yield pd.DataFrame({"i": iu, "j": ju, **dict(zip(("n", "sa", "sb", "saa", "sbb", "sab"), acc))})

    names = F.array(*[F.lit(c) for c in cols])
    t = rows.mapInPandas(partial, "i int, j int, n double, sa double, sb double, saa double, sbb double, sab double")
    t = t.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")])
    n = F.when(F.col("n") > 1, F.col("n"))
    va, vb = F.col("saa") - F.col("sa") * F.col("sa") / n, F.col("sbb") - F.col("sb") * F.col("sb") / n
    # what rounding leaves of a constant column counts as constant
    set_ = (va > 1e-12 * F.col("saa")) & (vb > 1e-12 * F.col("sbb"))
    r = F.when(set_, (F.col("sab") - F.col("sa") * F.col("sb") / n) / F.sqrt(va * vb))
    return t.select(names[F.col("i")].alias("a"), names[F.col("j")].alias("b"), r.alias("r"))
