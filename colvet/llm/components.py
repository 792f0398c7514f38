"""Connected components of an edge table by alternating large-star and
small-star steps (Kiveris et al. 2014): every step is a minimum per node and a
join, so a node with very many neighbours is combined map-side and its join
partition can be split; no neighbour list is gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _sum(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of any comparable type, either direction, repeats and
    loops allowed -> ``(node, component)``, component = smallest node reachable.
    Nodes without an edge to another node do not appear. An empty table gives
    an empty table."""
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    e = materialize(e, "edges")
    seen = _sum(e)
    while seen[0]:
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a > b").distinct()
        # small star: (u, v) with v < u; everything below u, and u, hangs on the least v
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                      .unionByName(low.select("a", F.col("m").alias("b"))))
        e = materialize(small.distinct(), "edges")
        now = _sum(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
