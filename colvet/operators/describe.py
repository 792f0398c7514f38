"""Descriptive passes: rates with Wilson intervals, rarity bands, type profile.

All are single aggregations (partial aggregation map-side, one shuffle on the
grouping key), so a hot key costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import day_of, wilson
from ..policy import RARITY_BREAKS, RARITY_LABELS, SECONDS_PER_DAY
from ..sources.frames import FrameSpec


def _rate_cols(k="k", n="n"):
    lo, hi = wilson(k, n)
    return [(F.col(k) / F.col(n)).alias("rate"), lo.alias("lo"), hi.alias("hi")]


def base_rate(frame: DataFrame, spec: FrameSpec) -> DataFrame:
    t = spec.time
    agg = frame.agg(F.count(F.lit(1)).alias("n"), F.sum(spec.label).cast("long").alias("k"),
                    F.min(t).alias("_lo"), F.max(t).alias("_hi"))
    return agg.select("n", "k", *_rate_cols(),
                      F.round((F.col("_hi") - F.col("_lo")) / F.lit(SECONDS_PER_DAY), 1).alias("days"))


def rates_by(frame: DataFrame, key, label: str) -> DataFrame:
    g = frame.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(label).cast("long").alias("k"))
    return g.select("*", *_rate_cols())


def daily_rate_ci(frame: DataFrame, spec: FrameSpec, min_n: int = 200) -> DataFrame:
    d = rates_by(frame.withColumn("day", day_of(spec.time).cast("long")), "day", spec.label)
    return d.where(F.col("n") > min_n)


def segment_rates(frame: DataFrame, spec: FrameSpec, segment: str | None = None) -> DataFrame:
    seg = segment or spec.segment
    g = rates_by(frame, seg, spec.label)
    tot = Window.partitionBy()  # over the segment table: one row per level
    return g.select("*", (F.col("n") / F.sum("n").over(tot)).alias("share_of_volume"),
                    (F.col("rate") / (F.sum("k").over(tot) / F.sum("n").over(tot))).alias("ratio_to_pooled"))


def presence_rates(frame: DataFrame, spec: FrameSpec, column: str) -> DataFrame:
    return rates_by(frame.withColumn("present", F.col(column).isNotNull()), "present", spec.label)


def rarity_profile(frame: DataFrame, spec: FrameSpec, columns) -> DataFrame:
    """Rate by how common a value is in its own column: [0,10) [10,100) ...

    One pass for all columns: rows become (column, value) pairs, reduced to
    (column, value) -> rows, positives; the band depends only on that count,
    so the bands are summed from the reduced table (no row-level join; a value
    holding most rows is one row per task).
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                      for c in columns])
    per = (frame.select(F.col(spec.label).alias("_y"), F.inline(pairs))
                .where(F.col("value").isNotNull())
                .groupBy("column", "value")
                .agg(F.count(F.lit(1)).alias("freq"), F.sum("_y").alias("pos")))
    b = F.when(F.col("freq") < RARITY_BREAKS[1], F.lit(RARITY_LABELS[0]))
    for i in range(1, len(RARITY_BREAKS)):
        upper = RARITY_BREAKS[i + 1] if i + 1 < len(RARITY_BREAKS) else None
        cond = F.col("freq") >= RARITY_BREAKS[i]
        if upper is not None:
            cond = cond & (F.col("freq") < upper)
        b = b.when(cond, F.lit(RARITY_LABELS[i]))
    g = per.groupBy("column", b.alias("band")).agg(F.sum("freq").alias("n"), F.sum("pos").cast("long").alias("k"))
    w = Window.partitionBy("column")  # bands of one column: at most five rows
    return g.select("column", "band", "n", "k", *_rate_cols(),
                    ((F.col("k") / F.col("n")) / (F.sum("k").over(w) / F.sum("n").over(w))).alias("ratio"))


STORED = {"double": "numeric", "float": "numeric", "bigint": "integer", "int": "integer",
          "smallint": "integer", "tinyint": "integer", "string": "character", "boolean": "logical"}


def type_profile(frame: DataFrame, spec: FrameSpec, values: DataFrame) -> DataFrame:
    """Stored type, distinct non-null values, null share and effective type per
    feature. ``values`` is VALUES over the whole frame (no window)."""
    spark = frame.sparkSession
    stored = spark.createDataFrame(
        [(f, STORED.get(frame.schema[f].dataType.simpleString(), "other")) for f in spec.features],
        "feature string, stored string")
    notnull = F.col("vnum").isNotNull() | F.col("vtxt").isNotNull()
    per = (values.groupBy("feature", "vnum", "vtxt").agg(F.sum("n").alias("c"))
                 .groupBy("feature")
                 .agg(F.count(F.when(notnull, F.lit(1))).alias("distinct"),
                      (F.sum(F.when(~notnull, F.col("c")).otherwise(0)) / F.sum("c")).alias("null_share")))
    p = stored.join(per, "feature")
    eff = (F.when(F.col("distinct") <= 2, F.lit("binary"))
            .when(F.col("distinct") <= 20, F.lit("low-cardinality"))
            .when(F.col("stored").isin("character", "factor"), F.lit("categorical"))
            .otherwise(F.lit("continuous")))
    p = p.withColumn("effectively", eff)
    # how many columns share each (stored, effective) pair: a feature-sized window
    return p.withColumn("pair_count", F.count(F.lit(1)).over(Window.partitionBy("stored", "effectively")))


def type_mismatch(profile: DataFrame) -> DataFrame:
    return (profile.where(F.col("stored").isin("numeric", "integer") & (F.col("distinct") <= 20))
                   .select("feature", "distinct", "null_share"))
