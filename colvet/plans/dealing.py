"""Random re-labellings of a whole table without moving its rows.

A permutation of labels over N rows gives each stretch of rows a hypergeometric
number of marked ones. ``deal`` hands the marked rows of a key down a tree of
stretches, 64 children a node: every node splits its number among its children,
for all draws at once, so a task sees one node and no task a whole key. A leaf
learns how many marked rows it has in each draw and how many lie before it.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sampling import multivariate_hypergeometric

FAN_BITS = 6


def seeded(seed: int, key: str, *place: int):
    """Generator of one place of one key: reruns and other partitionings agree."""
    return np.random.default_rng([seed, zlib.crc32(str(key).encode()), *[int(p) for p in place]])


def deal(leaves: DataFrame, marked: DataFrame, draws: int, seed: int = 0, key: str = "feature") -> DataFrame:
    """``(key, leaf, got array<long>, before array<long>)``: per draw the marked rows of a
    leaf and of all leaves before it.

    ``leaves`` is ``(key, leaf, rows)`` with leaf numbers from 0 in the order of the rows
    (gaps allowed), ``marked`` is ``(key, marked)``. A key without a row in
    ``marked`` gets none.
    """
    kind = leaves.schema[key].dataType.simpleString()
    levels = [leaves.select(key, F.col("leaf").alias("node"), "rows")]
    top = leaves.agg(F.max("leaf")).first()[0] or 0
    while top:
        levels.append(levels[-1].groupBy(key, F.shiftright("node", FAN_BITS).alias("node")).agg(F.sum("rows").alias("rows")))
        top >>= FAN_BITS
    zero = F.lit(0).cast("long")
    state = levels[-1].select(key, "node").join(marked.select(key, F.col("marked").cast("long").alias("marked")), key).select(
        key, "node", F.array_repeat("marked", draws).alias("got"), F.array_repeat(zero, draws).alias("before"))

    def step(level):
        def run(parent: pd.DataFrame, kids: pd.DataFrame) -> pd.DataFrame:
            if parent.empty or kids.empty:
                return pd.DataFrame(columns=[key, "node", "got", "before"])
            kids = kids.sort_values("kid")
            name, node = parent[key].iloc[0], int(parent["node"].iloc[0])
            got = np.asarray(parent["got"].iloc[0], np.int64)
            dealt = multivariate_hypergeometric(kids["rows"].tolist(), got, draws, seeded(seed, name, level, node))
            before = np.asarray(parent["before"].iloc[0], np.int64)[:, None] + np.cumsum(dealt, axis=1) - dealt
            return pd.DataFrame({key: name, "node": kids["kid"].to_numpy(), "got": list(dealt.T), "before": list(before.T)})
        return run

    for level in range(len(levels) - 2, -1, -1):
        kids = levels[level].select(F.col(key).alias("kid_of"), F.col("node").alias("kid"), "rows",
                                    F.shiftright("node", FAN_BITS).alias("parent"))
        state = state.groupBy(key, "node").cogroup(kids.groupBy("kid_of", "parent")).applyInPandas(
            step(level), f"{key} {kind}, node long, got array<long>, before array<long>")
    return state.withColumnRenamed("node", "leaf")


def marked_places(rows: int, got: np.ndarray, rng) -> np.ndarray:
    """``(draws, rows)`` booleans, ``got[d]`` of row d set at random places."""
    u = rng.random((len(got), rows))
    edge = np.sort(u, axis=1)
    cut = np.where(got > 0, edge[np.arange(len(got)), np.maximum(got, 1) - 1], -1.0)
    return u <= cut[:, None]
