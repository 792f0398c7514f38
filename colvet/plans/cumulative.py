"""Exact cumulative counts over ordered values without a whole group in one task.

Rank statistics (mid-ranks, AUC placements, order statistics, empirical CDFs)
need, for every distinct value of a column, the total weight of the values
strictly below it. A window ``partitionBy(feature).orderBy(value)`` computes
that, but puts every distinct value of a feature into one task, and a
near-unique double column at scale has billions of them.

Here the value axis of each key is first cut into buckets at approximate
quantiles (a small table, bounded by keys x grid), bucket totals give exact
offsets, and the running sum inside each bucket is a window over that bucket
only. The result is exact; only the bucket sizes are approximate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Rows per bucket the split aims for, and the finest quantile grid used.
TARGET_ROWS_PER_BUCKET = 2_000_000
GRID = 1024


def _as_number(df: DataFrame, col: str):
    """A double that sorts like ``col`` (timestamps and dates by their epoch count)."""
    t = df.schema[col].dataType.simpleString()
    c = F.col(col)
    if t == "timestamp_ntz":  # against the zone-less epoch: monotone whatever the session time zone
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{col}`)").cast("double")
    if t.startswith("timestamp"):
        return F.unix_micros(c).cast("double")
    if t == "date":
        return F.unix_date(c).cast("double")
    return c.cast("double")


def _bucket_bounds(df: DataFrame, keys: list, order: str) -> DataFrame:
    """Per key, the value bounds cutting it into buckets of about TARGET rows,
    or None when every key fits one bucket.

    Keys small enough for one bucket get no bounds and cost only a count; the
    quantile sketch runs only over the keys that need splitting.
    """
    spark = df.sparkSession
    grid = int(spark.conf.get("colvet.cumulative.grid", str(GRID)))
    target = int(spark.conf.get("colvet.cumulative.target_rows", str(TARGET_ROWS_PER_BUCKET)))
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_cnt"))
    big = [r for r in counts.where(F.col("_cnt") > target).collect()]
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    schema = (schema + ", " if schema else "") + "_bounds array<double>"
    if not big:
        return None  # every key fits one bucket
    out = []
    probs = [i / grid for i in range(1, grid)]
    wanted = spark.createDataFrame([tuple(r[k] for k in keys) for r in big],
                                   ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys))
    sketch = (df.join(F.broadcast(wanted), keys, "left_semi").groupBy(*keys)
                .agg(F.count(F.lit(1)).alias("_cnt"),
                     F.percentile_approx(_as_number(df, order), probs, 10000).alias("_q"))
                .collect())
    for r in sketch:
        n_buckets = max(1, min(grid, -(-int(r["_cnt"]) // target)))
        step = grid // n_buckets
        q = list(r["_q"] or [])
        out.append(tuple(r[k] for k in keys) + (sorted(set(q[step - 1::step])),))
    return spark.createDataFrame(out, schema=schema)


def cumulative(df: DataFrame, keys, order: str, weights, max_key_rows: int | None = None) -> DataFrame:
    """Add ``<w>_below`` and ``<w>_total`` for each weight column.

    ``<w>_below`` is the sum of ``w`` over rows with the same ``keys`` and a
    strictly smaller ``order`` value. ``df`` must hold one row per
    ``(keys, order)`` with ``order`` non-null (an aggregated table).
    """
    keys = list(keys)
    weights = list(weights)
    added_key = False
    if not keys:
        df = df.withColumn("_k0", F.lit(0))
        keys = ["_k0"]
        added_key = True

    target = int(df.sparkSession.conf.get("colvet.cumulative.target_rows", str(TARGET_ROWS_PER_BUCKET)))
    if max_key_rows is not None and max_key_rows <= target:
        bounds = None  # the caller knows every key fits one bucket: no count job needed
    else:
        bounds = _bucket_bounds(df, keys, order)
    if bounds is None:
        # every key fits one bucket: a plain running sum per key (one shuffle)
        below = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        whole = Window.partitionBy(*keys)
        out = df.select("*", *[F.coalesce(F.sum(w).over(below), F.lit(0)).alias(f"{w}_below") for w in weights],
                        *[F.sum(w).over(whole).alias(f"{w}_total") for w in weights])
        return out.drop("_k0") if added_key else out
    # Bounded by (keys x grid): schema-sized, safe to broadcast.
    b = (df.join(F.broadcast(bounds), keys, "left")
           .withColumn("_bkt", F.coalesce(
               F.size(F.filter("_bounds", lambda x: x < _as_number(df, order))),
               F.lit(0)))
           .drop("_bounds"))

    totals = b.groupBy(*keys, "_bkt").agg(*[F.sum(w).alias(f"_t_{w}") for w in weights])
    before = Window.partitionBy(*keys).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = totals.select(
        *keys, "_bkt",
        *[F.coalesce(F.sum(f"_t_{w}").over(before), F.lit(0)).alias(f"_o_{w}") for w in weights],
        *[F.sum(f"_t_{w}").over(whole).alias(f"{w}_total") for w in weights])

    inside = (Window.partitionBy(*keys, "_bkt").orderBy(order)
              .rowsBetween(Window.unboundedPreceding, -1))
    local = b.select("*", *[F.coalesce(F.sum(w).over(inside), F.lit(0)).alias(f"_l_{w}")
                            for w in weights])
    out = local.join(F.broadcast(offsets), [*keys, "_bkt"], "inner")
    out = out.select(
        *[c for c in df.columns],
        *[(F.col(f"_o_{w}") + F.col(f"_l_{w}")).alias(f"{w}_below") for w in weights],
        *[F.col(f"{w}_total") for w in weights])
    if added_key:
        out = out.drop("_k0")
    return out


def order_statistics(counts: DataFrame, keys, order: str, weight: str,
                     ranks: DataFrame, rank_col: str = "rank", max_key_rows: int | None = None) -> DataFrame:
    """Value at each 0-based ``rank`` of the weighted, ordered values.

    ``counts`` is one row per (keys, value) with weight ``weight``; ``ranks``
    holds ``keys`` + ``rank_col`` (+ any label columns) and is small.
    """
    keys = list(keys)
    cum = cumulative(counts.where(F.col(order).isNotNull()), keys, order, [weight], max_key_rows)
    r = ranks.select(*[F.col(c).alias(f"_r_{c}") for c in ranks.columns])
    cond = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    cond.append(F.col(f"{weight}_below") <= F.col(f"_r_{rank_col}"))
    cond.append(F.col(f"_r_{rank_col}") < F.col(f"{weight}_below") + F.col(weight))
    cond_all = cond[0]
    for c in cond[1:]:
        cond_all = cond_all & c
    joined = cum.join(F.broadcast(r), cond_all, "inner")
    return joined.select(*[F.col(f"_r_{c}").alias(c) for c in ranks.columns],
                         F.col(order).alias("value"))
