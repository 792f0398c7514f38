"""Readers and writers: pinned-schema CSV, windowed Parquet, block and
fragment JSON, and the frame / fragment / declaration sinks.

Schemas are pinned (``[{"name", "type"}]`` with BigQuery-style types), never
inferred. Writes go to a folder under the session's checkpoint location unless
a path is given, so they land on shared storage on a cluster.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (BooleanType, DoubleType, LongType, StringType, StructField,
                               StructType)

from ..operators.windows import Windows, check_windows, quantile_nearest
from ..session import ensure_checkpoint_dir

NULL_TOKENS = ("", "NA", "NaN")
BQ_TYPES = {"INTEGER": LongType(), "INT64": LongType(), "FLOAT": DoubleType(), "FLOAT64": DoubleType(),
            "STRING": StringType(), "BOOLEAN": BooleanType(), "BOOL": BooleanType()}
BLOCKS_DIR = os.path.join(os.path.dirname(__file__), "blocks")


def scratch_path(spark: SparkSession, name: str) -> str:
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "colvet-out", f"{name}-{uuid.uuid4().hex[:12]}")


def read_pinned_csv(spark: SparkSession, csv_path: str, fields: list) -> DataFrame:
    """Read a CSV under a pinned schema: every column is read as text, the null
    tokens ``""``, ``NA``, ``NaN`` become null, ``T``/``F`` become booleans
    (other text in a boolean column is null), numbers are cast (a failed cast
    is null, not an error)."""
    text_schema = StructType([StructField(f["name"], StringType(), True) for f in fields])
    raw = (spark.read.option("header", True).option("nullValue", None).option("emptyValue", "")
                .schema(text_schema).csv(csv_path))
    cols = []
    for f in fields:
        c = F.col(f["name"])
        c = F.when(c.isin(*NULL_TOKENS) | c.isNull(), F.lit(None).cast("string")).otherwise(c)
        t = f["type"].upper()
        if t in ("BOOLEAN", "BOOL"):
            c = F.when(c == "T", F.lit(True)).when(c == "F", F.lit(False)).otherwise(F.lit(None).cast("boolean"))
        elif t in ("INTEGER", "INT64"):
            c = c.try_cast("long")
        elif t in ("FLOAT", "FLOAT64"):
            c = c.try_cast("double")
        cols.append(c.alias(f["name"]))
    return raw.select(*cols)


def load_windows(spark: SparkSession, path: str, label: str, time: str, features=None,
                 excluded=(), train=(0.0, 0.17), holdout=(0.83, 1.0)) -> tuple[DataFrame, Windows, list]:
    """Only the wanted columns and only the rows of the two windows.

    The time axis is read first (one column) to find the four edges; the row
    filter then carries them as literals and reaches the Parquet scan.
    """
    check_windows(train, holdout)
    ds = spark.read.parquet(path)
    cols = ds.columns
    if features is None:
        features = [c for c in cols if c not in set(excluded) | {label, time}]
    missing = [f for f in features if f not in cols]
    if missing:
        raise ValueError(f"the file has no column {missing[:5]}")
    edges = quantile_nearest(ds.select(time), time, [train[0], train[1], holdout[0], holdout[1]])
    win = Windows(tuple(train), tuple(holdout), tuple(edges))
    tt = ds.schema[time].dataType.simpleString()
    early, late = win.condition(time, "early", tt), win.condition(time, "late", tt)
    wanted = list(dict.fromkeys([*features, label, time]))
    out = (spark.read.parquet(path).select(*wanted).where(early | late)
                .withColumn("window", F.when(early, F.lit("early")).otherwise(F.lit("late"))))
    return out, win, list(features)


def block_file(name: str) -> list:
    """The packaged block definitions of a frame."""
    with open(os.path.join(BLOCKS_DIR, f"{name}.json")) as f:
        return json.load(f)["blocks"]


def load_blocks(spark: SparkSession, name_or_path: str = "events") -> DataFrame:
    """Pinned column blocks, flattened: (block, group_idx, column). A packaged
    definition is read here on the driver, a path by Spark."""
    if not name_or_path.endswith(".json"):
        rows = [(b["block"], i, c) for b in block_file(name_or_path) for i, g in enumerate(b["groups"]) for c in g]
        return spark.createDataFrame(rows, "block string, group_idx int, column string")
    doc = spark.read.option("multiLine", True).json(name_or_path)
    b = doc.select(F.explode("blocks").alias("b"))
    g = b.select(F.col("b.block").alias("block"), F.posexplode("b.groups").alias("group_idx", "members"))
    return g.select("block", "group_idx", F.explode("members").alias("column"))


def read_fragments(spark: SparkSession, folder: str, order=None) -> DataFrame:
    """Every fragment written under ``folder`` (see ``write_fragment``); with
    ``order``, each named check must exist, and rows come in that order."""
    frags = spark.read.json(os.path.join(folder, "fragments", "*"))
    if order:
        want = spark.createDataFrame([(c, i) for i, c in enumerate(order)], "check string, precedence int")
        missing = [r["check"] for r in want.join(frags.select("check"), "check", "left_anti").collect()]
        if missing:
            raise ValueError(f"fragments missing for checks {missing}")
        frags = frags.join(want, "check").orderBy("precedence")
    return frags


def write_fragment(spark: SparkSession, fragment: dict, report: DataFrame, folder: str) -> dict:
    """Fragment as JSON (missing numbers as null, 10 significant digits) and
    its report as CSV."""
    def clean(x):
        if isinstance(x, float):
            return None if x != x else float(f"{x:.10g}")
        if isinstance(x, dict):
            return {k: clean(v) for k, v in x.items()}
        if isinstance(x, (list, tuple)):
            return [clean(v) for v in x]
        return x
    text = json.dumps(clean(fragment))
    frag_dir = os.path.join(folder, "fragments")
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(
        os.path.join(frag_dir, fragment["check"]))
    report.coalesce(1).write.mode("overwrite").option("header", True).csv(
        os.path.join(folder, "tables", fragment["check"]))
    return {"fragment": os.path.join(frag_dir, fragment["check"]),
            "report": os.path.join(folder, "tables", fragment["check"])}


def write_declaration(declared: DataFrame, path: str, derivations=None, data=None, fitted=None) -> str:
    """Column list with source and dtype as one JSON row, with the time, what the
    data were, the derivation specs and the parameters that fitted ones learned."""
    row = declared.agg(F.sort_array(F.collect_list(F.struct("name", "source", "dtype"))).alias("columns"))
    row = (row.withColumn("version", F.lit("1"))
              .withColumn("created_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"))
              .withColumn("data", F.lit(json.dumps(data or {})))
              .withColumn("derivations", F.lit(json.dumps(derivations or [])))
              .withColumn("fitted_parameters", F.lit(json.dumps(fitted or {}))))
    row.coalesce(1).write.mode("overwrite").json(path)
    return path


def write_contract(spark: SparkSession, body: dict, path: str) -> str:
    """The contract body as one JSON document (sized by columns and checks)."""
    text = json.dumps(body)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return path
