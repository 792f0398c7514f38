"""The two count tables nearly every audit is a function of.

VALUES  ``(feature, [by...], y, vnum, vtxt) -> n``  -- the frame unpivoted to
        long form and reduced at once (partial aggregation runs map-side, so a
        value that holds most rows costs one row per task, not a hot key).
CELLS   ``(feature, [by...], bin_idx) -> n, pos, neg`` -- VALUES after bin
        assignment.

Numeric features travel as ``vnum`` (double), text features as ``vtxt``; a
null value is kept as its own row (``unpivot`` drops nothing here).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.frames import FrameSpec


def long_values(frame: DataFrame, spec: FrameSpec, features=None, by=("window",),
                label: str | None = None) -> DataFrame:
    """Unpivot ``features`` into ``(by..., y, feature, vnum, vtxt)`` rows."""
    features = list(features or spec.features)
    label = label or spec.label
    structs = []
    for f in features:
        if spec.kind_of(f) == "numeric":
            structs.append(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("vnum"),
                                    F.lit(None).cast("string").alias("vtxt")))
        else:
            structs.append(F.struct(F.lit(f).alias("feature"), F.lit(None).cast("double").alias("vnum"),
                                    F.col(f).cast("string").alias("vtxt")))
    return frame.select(*by, F.col(label).cast("int").alias("y"), F.inline(F.array(*structs)))


def values_table(frame: DataFrame, spec: FrameSpec, features=None, by=("window",),
                 label: str | None = None) -> DataFrame:
    """VALUES: counts per (feature, by..., y, value)."""
    lv = long_values(frame, spec, features, by, label)
    return (lv.groupBy("feature", *by, "y", "vnum", "vtxt")
              .agg(F.count(F.lit(1)).alias("n")))


def value_counts(values: DataFrame, by=()) -> DataFrame:
    """VALUES summed over the label: (feature, by..., vnum, vtxt) -> n, pos, neg."""
    return (values.groupBy("feature", *by, "vnum", "vtxt")
                  .agg(F.sum("n").alias("n"),
                       F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("pos"),
                       F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("neg")))


def is_null_value():
    return F.col("vnum").isNull() & F.col("vtxt").isNull()


def assign_bin_expr():
    """Bin index of a VALUES row joined to its binning (see ``binning.fit``).

    numeric:      interval [e_i, e_{i+1}), outer edges -inf/+inf, last closed
    discrete:     position in the kept values, else ``__other__`` (n_core-1)
    categorical:  position in the kept levels, else ``__other__``
    null:         ``__null__``, always index n_core (last)
    """
    vn, vt = F.col("vnum"), F.col("vtxt")
    numeric = F.least(F.size(F.filter("edges", lambda e: e <= vn)) - 1, F.col("n_core") - 1)
    pos_num = F.array_position("vals", vn)
    pos_txt = F.array_position("levels", vt)
    discrete = F.when(pos_num > 0, pos_num - 1).otherwise(F.col("n_core") - 1)
    categorical = F.when(pos_txt > 0, pos_txt - 1).otherwise(F.col("n_core") - 1)
    return (F.when(is_null_value(), F.col("n_core"))
             .when(F.col("kind") == "numeric", numeric)
             .when(F.col("kind") == "discrete", discrete)
             .otherwise(categorical)).cast("int")


def cells_table(values: DataFrame, binning: DataFrame, by=("window",)) -> DataFrame:
    """CELLS: VALUES assigned to fitted bins, counts per (feature, by..., bin_idx).

    The binning has one row per feature (bounded by the schema, not the data),
    so it is broadcast and assignment needs no shuffle of VALUES.
    """
    fitted = binning.where(F.col("degenerate").isNull()) \
                    .select("feature", "kind", "edges", "vals", "levels", "n_core")
    j = values.join(F.broadcast(fitted), "feature", "inner")
    return (j.withColumn("bin_idx", assign_bin_expr())
             .groupBy("feature", *by, "bin_idx")
             .agg(F.sum("n").alias("n"),
                  F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("pos"),
                  F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("neg")))
