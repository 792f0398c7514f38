"""Weight of evidence and information value over fitted bins.

Per (feature, window, bin): ``n, pos, neg, share, p_pos, p_neg, woe, iv_part``.
Both cells of a bin get +0.5 only when one of them is zero, so an empty bin's
WoE is ``ln((0.5/SP)/(0.5/SN))`` -- not zero (see README, empty-bin note).
All windows here partition by (feature, window): a group is at most
``max_levels + 2`` rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import safe_corr


def complete_cells(cells: DataFrame, binning: DataFrame, by_values=None,
                   by_col: str = "window") -> DataFrame:
    """Every bin of every fitted feature for every ``by`` value, zeros filled.

    ``by_values``: the values of ``by_col`` to lay out (``None``: take the
    distinct values present in ``cells``; their number is bounded by design --
    two windows, or the segment levels).
    """
    grid = binning.where(F.col("degenerate").isNull()) \
                  .select("feature", F.explode(F.sequence(F.lit(0), F.col("n_core"))).alias("bin_idx"))
    if by_values is not None:
        grid = grid.withColumn(by_col, F.explode(F.array(*[F.lit(v) for v in by_values])))
    else:
        levels = cells.select("feature", by_col).distinct()
        grid = grid.join(levels, "feature")
    return (grid.join(cells, ["feature", by_col, "bin_idx"], "left")
                .fillna(0, ["n", "pos", "neg"]))


def woe_table(full_cells: DataFrame, by=("window",)) -> DataFrame:
    w = Window.partitionBy("feature", *by)
    adj = F.when((F.col("pos") == 0) | (F.col("neg") == 0), F.lit(0.5)).otherwise(F.lit(0.0))
    t = (full_cells.withColumn("pos_adj", F.col("pos") + adj)
                   .withColumn("neg_adj", F.col("neg") + adj))
    t = (t.withColumn("p_pos", F.col("pos_adj") / F.sum("pos_adj").over(w))
          .withColumn("p_neg", F.col("neg_adj") / F.sum("neg_adj").over(w))
          .withColumn("share", F.when(F.sum("n").over(w) > 0, F.col("n") / F.sum("n").over(w))))
    t = (t.withColumn("woe", F.log(F.col("p_pos") / F.col("p_neg")))
          .withColumn("iv_part", (F.col("p_pos") - F.col("p_neg")) * F.col("woe")))
    return t.select("feature", *by, "bin_idx", "n", "pos", "neg", "share", "p_pos", "p_neg",
                    "woe", "iv_part")


def information_value(woe: DataFrame, by=("window",)) -> DataFrame:
    return woe.groupBy("feature", *by).agg(F.sum("iv_part").alias("iv"))


def score_cells(cells: DataFrame, ref_woe: DataFrame, by=("window",)) -> DataFrame:
    """Attach the reference window's WoE to each cell: the scorecard applied unchanged."""
    lookup = ref_woe.select("feature", "bin_idx", F.col("woe").alias("score"))
    return cells.join(lookup, ["feature", "bin_idx"], "inner")


def woe_agreement(ref: DataFrame, cur: DataFrame, eps: float = 0.05) -> DataFrame:
    """Spearman of two WoE vectors over bins populated on both sides (>= 3 such
    bins, else null), and the current window's share in bins whose WoE changed
    sign with both |WoE| > eps."""
    j = (ref.select("feature", "bin_idx", F.col("woe").alias("w_ref"), F.col("n").alias("n_ref"))
            .join(cur.select("feature", "bin_idx", F.col("woe").alias("w_cur"),
                             F.col("n").alias("n_cur"), F.col("share").alias("s_cur")),
                  ["feature", "bin_idx"]))
    usable = (F.col("n_ref") > 0) & (F.col("n_cur") > 0)
    flipped = usable & (F.abs("w_ref") > eps) & (F.abs("w_cur") > eps) & \
        (F.signum("w_ref") != F.signum("w_cur"))
    flip = j.groupBy("feature").agg(
        F.sum(F.when(flipped, F.col("s_cur")).otherwise(F.lit(0.0))).alias("flip_mass"))
    u = j.where(usable)
    rho = spearman_pairs(u, ["feature"], "w_ref", "w_cur").withColumnRenamed("rho", "rho")
    counts = u.groupBy("feature").agg(F.count(F.lit(1)).alias("usable_bins"))
    out = flip.join(counts, "feature", "left").join(rho, "feature", "left")
    return out.select("feature",
                      F.when(F.coalesce(F.col("usable_bins"), F.lit(0)) >= 3, F.col("rho")).alias("rho"),
                      "flip_mass")


def mid_rank(col: str, keys):
    """Average rank of ``col`` within ``keys`` (ties share the mean of their ranks)."""
    w = Window.partitionBy(*keys).orderBy(F.col(col))
    tie = Window.partitionBy(*keys, col)
    return F.rank().over(w) + (F.count(F.lit(1)).over(tie) - 1) / 2.0


def spearman_pairs(df: DataFrame, keys, a: str, b: str) -> DataFrame:
    """Spearman correlation of two small vectors per key (null when undefined)."""
    r = df.select(*keys, mid_rank(a, keys).alias("ra"), mid_rank(b, keys).alias("rb"))
    c = r.groupBy(*keys).agg(safe_corr("ra", "rb").alias("rho"))
    return c.select(*keys, F.when(F.isnan("rho"), F.lit(None)).otherwise(F.col("rho")).alias("rho"))
