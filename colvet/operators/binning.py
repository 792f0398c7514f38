"""Bin edges fitted once on a reference window, carried to every other window.

``fit`` turns the reference window's VALUES into one row per feature:

* numeric, fewer than 2 distinct non-null values -> degenerate
  (``no non-null values`` / ``constant``)
* numeric, <= ``bins`` distinct                 -> ``discrete``: one bin per value
* numeric otherwise: type-7 quantile grid at 0, 1/bins, ..., 1, de-duplicated;
  >= 3 edges -> ``numeric`` with outer edges -inf/+inf, else ``discrete`` on
  the ``max_levels`` most frequent values
* text -> ``categorical`` on the ``max_levels`` most frequent levels

Ties among equally frequent values break by value / level (binary order).
``__other__`` follows the kept values of discrete and categorical binnings;
``__null__`` is always the last bin. Quantiles are exact: order statistics come
from bucketed cumulative counts (``plans.cumulative``), never a collect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.cumulative import order_statistics
from ..session import cut_lineage
from ..policy import NULL_BUCKET, OTHER_BUCKET
from ..sources.frames import FrameSpec

BINNING_COLUMNS = ["feature", "kind", "degenerate", "null_share", "edges", "vals",
                   "levels", "n_core", "n_bins"]


def type7_probs(bins: int):
    """Probabilities exactly as ``seq(0, 1, length.out = bins + 1)`` builds them."""
    by = 1.0 / bins
    return [0.0] + [j * by for j in range(1, bins)] + [1.0]


def type7_quantiles(counts: DataFrame, keys, probs, n_col: str = "nonnull") -> DataFrame:
    """Type-7 (linear interpolation) quantiles of weighted values, exactly.

    ``counts``: keys + ``vnum`` + ``c`` (one row per distinct non-null value)
    plus the per-key non-null total ``n_col``. Returns keys + ``j`` + ``q``.
    """
    keys = list(keys)
    totals = counts.select(*keys, n_col).distinct()
    grid = F.array(*[F.lit(float(p)) for p in probs])
    # index = 1 + (n-1) p ; lo = floor, hi = ceiling ; h = index - lo
    idx = (totals.select(*keys, n_col, F.posexplode(grid).alias("j", "p"))
                 .withColumn("index", F.lit(1.0) + (F.col(n_col) - 1).cast("double") * F.col("p"))
                 .withColumn("lo", F.floor("index").cast("long"))
                 .withColumn("hi", F.ceil("index").cast("long"))
                 .withColumn("h", F.col("index") - F.col("lo")))
    ranks = (idx.select(*keys, "j", (F.col("lo") - 1).alias("rank"), F.lit("lo").alias("side"))
                .unionByName(idx.select(*keys, "j", (F.col("hi") - 1).alias("rank"),
                                        F.lit("hi").alias("side"))))
    stats = order_statistics(counts.select(*keys, "vnum", "c"), keys, "vnum", "c", ranks)
    piv = (stats.groupBy(*keys, "j")
                .agg(F.max(F.when(F.col("side") == "lo", F.col("value"))).alias("x_lo"),
                     F.max(F.when(F.col("side") == "hi", F.col("value"))).alias("x_hi")))
    out = piv.join(idx.select(*keys, "j", "index", "lo", "h"), [*keys, "j"])
    q = F.when((F.col("index") > F.col("lo")) & (F.col("x_hi") != F.col("x_lo")),
               (F.lit(1.0) - F.col("h")) * F.col("x_lo") + F.col("h") * F.col("x_hi")) \
         .otherwise(F.col("x_lo"))
    return out.select(*keys, "j", q.alias("q"))


def top_values(vc: DataFrame, value_col: str, k: int, keys=("feature",)) -> DataFrame:
    """The ``k`` most frequent values per key, ties by value, as (keys, rn, value).

    ``row_number() <= k`` is planned as a window group limit: each task keeps
    its own top ``k`` before the shuffle, so a key with millions of values
    ships at most ``k`` rows per task.
    """
    w = Window.partitionBy(*keys).orderBy(F.col("c").desc(), F.col(value_col).asc())
    return (vc.withColumn("rn", F.row_number().over(w))
              .where(F.col("rn") <= k)
              .select(*keys, "rn", F.col(value_col).alias("value")))


def reference_counts(values: DataFrame, ref_window: str | None = "early",
                     window_col: str = "window") -> DataFrame:
    v = values if ref_window is None else values.where(F.col(window_col) == F.lit(ref_window))
    return v.groupBy("feature", "vnum", "vtxt").agg(F.sum("n").alias("c"))


def fit(values: DataFrame, spec: FrameSpec, features=None, bins: int = 10,
        max_levels: int = 20, ref_window: str | None = "early",
        window_col: str = "window") -> DataFrame:
    spark = values.sparkSession
    features = list(features or spec.features)
    kinds = spark.createDataFrame([(f, spec.kind_of(f)) for f in features],
                                  "feature string, declared string")
    # read by every branch below (stats, grid, few values, top values, levels): written once
    vc = cut_lineage(reference_counts(values, ref_window, window_col).join(kinds, "feature"))
    notnull = F.col("vnum").isNotNull() | F.col("vtxt").isNotNull()
    stats = (vc.groupBy("feature")
               .agg(F.sum("c").alias("total"),
                    F.sum(F.when(notnull, F.col("c")).otherwise(0)).alias("nonnull"),
                    F.count(F.when(notnull, F.lit(1))).alias("distinct")))
    stats = kinds.join(stats, "feature", "left").fillna(0, ["total", "nonnull", "distinct"])

    num = vc.where(F.col("declared") == "numeric").where(F.col("vnum").isNotNull())
    txt = vc.where(F.col("declared") == "text").where(F.col("vtxt").isNotNull())

    # numeric columns with many values: the quantile grid
    grid_keys = stats.where((F.col("declared") == "numeric") & (F.col("distinct") > bins)) \
                     .select("feature", "nonnull")
    grid_counts = num.join(grid_keys, "feature", "inner")
    q = type7_quantiles(grid_counts, ["feature"], type7_probs(bins))
    grid = (q.groupBy("feature")
             .agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("j", "q"))),
                                                lambda s: s["q"])).alias("grid")))

    # numeric columns with few values: every value is a bin (bounded by ``bins``)
    few_keys = stats.where((F.col("declared") == "numeric") & (F.col("distinct") <= bins)
                           & (F.col("distinct") >= 2)).select("feature")
    few = (num.join(few_keys, "feature", "inner").groupBy("feature")
              .agg(F.array_sort(F.collect_list("vnum")).alias("all_vals")))

    # fallback for a collapsed grid, and the categorical levels
    top_num = (top_values(num.join(grid_keys.select("feature"), "feature"), "vnum", max_levels)
               .groupBy("feature").agg(F.array_sort(F.collect_list("value")).alias("top_vals")))
    top_txt = (top_values(txt, "vtxt", max_levels)
               .groupBy("feature")
               .agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "value"))),
                                lambda s: s["value"]).alias("top_levels")))

    b = (stats.join(grid, "feature", "left").join(few, "feature", "left")
              .join(top_num, "feature", "left").join(top_txt, "feature", "left"))
    is_num = F.col("declared") == "numeric"
    degenerate = (F.when(F.col("nonnull") == 0, F.lit("no non-null values"))
                   .when(is_num & (F.col("distinct") < 2), F.lit("constant")))
    kind = (F.when(~is_num, F.lit("categorical"))
             .when(F.col("distinct") <= bins, F.lit("discrete"))
             .when(F.size("grid") >= 3, F.lit("numeric"))
             .otherwise(F.lit("discrete")))
    b = b.withColumn("degenerate", degenerate).withColumn("kind", kind)
    inner = F.slice("grid", 2, F.greatest(F.size("grid") - 2, F.lit(0)))
    edges = F.when((F.col("kind") == "numeric") & F.col("degenerate").isNull(),
                   F.concat(F.array(F.lit(float("-inf"))), inner, F.array(F.lit(float("inf")))))
    vals = (F.when(F.col("degenerate").isNotNull(), F.lit(None))
             .when(is_num & (F.col("distinct") <= bins), F.col("all_vals"))
             .when(F.col("kind") == "discrete", F.col("top_vals")))
    levels = F.when((F.col("kind") == "categorical") & F.col("degenerate").isNull(), F.col("top_levels"))
    b = (b.withColumn("edges", edges.cast("array<double>"))
          .withColumn("vals", vals.cast("array<double>"))
          .withColumn("levels", levels.cast("array<string>")))
    n_core = (F.when(F.col("degenerate").isNotNull(), F.lit(None))
               .when(F.col("kind") == "numeric", F.size("edges") - 1)
               .when(F.col("kind") == "discrete", F.size("vals") + 1)
               .otherwise(F.size("levels") + 1)).cast("int")
    b = (b.withColumn("n_core", n_core)
          .withColumn("n_bins", (F.col("n_core") + 1).cast("int"))
          .withColumn("null_share", F.when(F.col("total") > 0,
                                           (F.col("total") - F.col("nonnull")) / F.col("total"))
                                     .otherwise(F.lit(None).cast("double"))))
    return b.select(*BINNING_COLUMNS)


def _fmt(x):
    """Number as a bin label: whole numbers without a decimal part, +-Inf spelled out."""
    return (F.when(x == F.lit(float("inf")), F.lit("Inf"))
             .when(x == F.lit(float("-inf")), F.lit("-Inf"))
             .when(x == F.floor(x), F.format_string("%.0f", x))
             .otherwise(F.format_string("%.15g", x)))


def bin_labels(binning: DataFrame) -> DataFrame:
    """One row per (feature, bin_idx) with a display label, ``__null__`` last.

    Labels are for reading only; joins always use ``bin_idx`` (two close edges
    can print the same).
    """
    b = binning.where(F.col("degenerate").isNull())
    e = b.select("feature", "kind", "edges", "vals", "levels", "n_core",
                 F.explode(F.sequence(F.lit(0), F.col("n_core"))).alias("bin_idx"))
    i = F.col("bin_idx")
    numeric = F.concat(F.lit("["), _fmt(F.element_at("edges", i + 1)), F.lit(", "),
                       _fmt(F.element_at("edges", i + 2)), F.lit(")"))
    label = (F.when(i == F.col("n_core"), F.lit(NULL_BUCKET))
              .when(i == F.col("n_core") - 1, F.when(F.col("kind") == "numeric", numeric)
                                                .otherwise(F.lit(OTHER_BUCKET)))
              .when(F.col("kind") == "numeric", numeric)
              .when(F.col("kind") == "discrete", _fmt(F.element_at("vals", i + 1)))
              .otherwise(F.element_at("levels", i + 1)))
    return e.select("feature", "bin_idx", label.alias("bin"))
