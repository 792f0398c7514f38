"""Registered queries: one Spark plan and (where SQL can express it) one
reference SQL per operator key.

Float columns named in a registration are rounded the same way on both sides
(``round(x * 1e6) / 1e6 + 0.0``: the scaled double rounded half away from
zero, and -0.0 folded into 0.0), so the checker compares numbers, not the last
bits of two summation orders.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Query:
    key: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    floats: tuple = field(default_factory=tuple)
    origin: str = ""


REGISTRY: dict[str, Query] = {}


def round6(c):
    return F.round(c * F.lit(1e6)) / F.lit(1e6) + F.lit(0.0)


def register(key: str, sql: str | None = None, floats=()):
    def deco(fn):
        floats_t = tuple(floats)

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            if floats_t:
                df = df.select(*[round6(F.col(c).cast("double")).alias(c) if c in floats_t
                                 else F.col(c) for c in df.columns])
            return df

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        wrapped_sql = None
        if sql is not None:
            if floats_t:
                rep = ", ".join(f"round(CAST({c} AS DOUBLE) * 1e6::DOUBLE) / 1e6::DOUBLE + 0.0::DOUBLE AS {c}"
                                for c in floats_t)
                wrapped_sql = f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) q"
            else:
                wrapped_sql = sql
        REGISTRY[key] = Query(key, run, wrapped_sql, floats_t, f"{fn.__module__}.{fn.__name__}")
        return run
    return deco
