"""Audit frames built from the supplied tables, or from any table (``audit_frame``).

An audit frame is one wide DataFrame with a row id, an integer-second time
axis, a 0/1 label, an optional segment and entity column, and the features.
``FrameSpec`` records which column plays which part; every operator reads the
spec instead of guessing roles.

The frames are plain joins; Catalyst prunes unused columns down to the Parquet
scan and picks the join strategy from size statistics (the dimension tables
are broadcast by the planner's own size check, the fact tables sort-merge).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (BooleanType, DateType, DoubleType, FloatType, NumericType, StringType, TimestampNTZType,
                               TimestampType)


@dataclass(frozen=True)
class FrameSpec:
    name: str
    numeric: tuple
    text: tuple
    id: str = "row_id"
    time: str = "t"
    label: str = "y"
    segment: str | None = None
    entity: str | None = None
    extra: tuple = field(default_factory=tuple)
    raw_time: str | None = None   # source timestamp or date behind ``time`` (for scan pushdown)
    logical: tuple = ()           # the members of ``numeric`` that are true / false: they travel as 1 / 0

    @property
    def features(self) -> tuple:
        return tuple(self.numeric) + tuple(self.text)

    @property
    def measured(self) -> tuple:
        """Numeric features that are numbers in the table, not true / false."""
        return tuple(f for f in self.numeric if f not in self.logical)

    @property
    def categorical(self) -> tuple:
        """Features with unordered levels: text and true / false."""
        return tuple(self.text) + tuple(self.logical)

    def kind_of(self, feature: str) -> str:
        return "numeric" if feature in self.numeric else "text"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floating NaN becomes null once, at ingest (a NaN is missing, not a value)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append(F.when(F.isnan(F.col(f.name)), F.lit(None))
                        .otherwise(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def unix_seconds(col: str, zoneless: bool = True):
    """Whole seconds since 1970-01-01 of a timestamp column.

    A zone-less timestamp is measured against the zone-less epoch, so the
    result does not depend on the session time zone; an instant uses its own
    epoch seconds.
    """
    if zoneless:
        return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{col}`)")
    return F.unix_seconds(F.col(col))


def _zoneless(df: DataFrame, col: str) -> bool:
    return df.schema[col].dataType.simpleString() == "timestamp_ntz"


def _part(t) -> str | None:
    """The part a column type can play as a feature."""
    if isinstance(t, BooleanType):
        return "logical"
    if isinstance(t, NumericType):
        return "numeric"
    return "text" if isinstance(t, StringType) else None


def _label01(df: DataFrame, label: str, positive):
    t, c = df.schema[label].dataType, F.col(label)
    if positive is not None:
        return (c == F.lit(positive)).cast("int")
    if isinstance(t, BooleanType):
        return c.cast("int")
    if isinstance(t, NumericType):
        return F.when(c.isin(0, 1), c.cast("int")).otherwise(F.raise_error(F.lit(f"label {label} has values besides 0 and 1")))
    raise ValueError(f"label {label!r} is neither logical nor a number: name its positive value")


def _seconds(df: DataFrame, time: str):
    """(time axis, whether the column itself can carry the window filter)."""
    t, c = df.schema[time].dataType, F.col(time)
    if isinstance(t, (TimestampType, TimestampNTZType)):
        return unix_seconds(time, _zoneless(df, time)), True
    if isinstance(t, DateType):
        return F.unix_date(c).cast("long") * 86400, True
    if isinstance(t, NumericType):
        return c, False
    raise ValueError(f"time {time!r} is neither a time, a date nor a number")


def audit_frame(df: DataFrame, label: str, time: str, exclude=(), features=None, positive=None, id: str | None = None,
                segment: str | None = None, entity: str | None = None, name: str = "table") -> tuple[DataFrame, FrameSpec]:
    """Any table as an audit frame, the parts its columns play read off the schema.

    Numbers are numeric features, true / false columns logical ones, strings text;
    columns of other types (times, arrays, maps, binary) are no features. ``label``,
    ``time``, ``id``, ``entity`` and ``exclude`` are never features; names in
    ``exclude`` that the table lacks are ignored. ``features`` names them instead.
    The label is logical, a number 0 / 1 (any other value stops the job) or equal to
    ``positive``. Rows without label or time (NaN is missing) cannot be placed and
    are left out. Without ``id`` a row's id is a hash of its columns, so rows equal
    in all of them share one: name a unique column where redundancy is asked for.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    parts = {c: _part(t) for c, t in types.items()}
    lacking = [c for c in (label, time, id, segment, entity, *(features or ())) if c is not None and c not in types]
    if lacking:
        raise ValueError(f"the table has no columns {lacking}")
    never = {label, time, id, entity, *exclude}
    if features is None:
        features = [c for c in types if c not in never and parts[c]]
    wrong = [c for c in features if c in (label, time) or not parts[c] or "." in c or "`" in c or c.lower() == "window"]
    if wrong:
        raise ValueError(f"columns {wrong} cannot be features (their type, their part, a dot, or the name 'window')")
    seconds, pushes = _seconds(df, time)
    kept = list(dict.fromkeys([*features, *[c for c in (segment, entity, time if pushes else None) if c]]))
    taken = {c.lower() for c in kept}

    def free(n: str) -> str:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        return n

    id_name, t_name, y_name = free("row_id"), free("t"), free("y")
    hashed = [c for c in types if parts[c] or isinstance(types[c], (DateType, TimestampType, TimestampNTZType))]
    row_id = F.col(id) if id else F.xxhash64(*[F.col(f"`{c}`") for c in hashed])
    placed = nan_to_null(df.select(*[F.col(f"`{c}`") for c in types])).where(F.col(label).isNotNull() & F.col(time).isNotNull())
    out = placed.select(row_id.alias(id_name), seconds.alias(t_name), _label01(df, label, positive).alias(y_name),
                        *[F.col(c) for c in kept])
    spec = FrameSpec(name=name, numeric=tuple(c for c in features if parts[c] != "text"),
                     text=tuple(c for c in features if parts[c] == "text"), id=id_name, time=t_name, label=y_name,
                     segment=segment, entity=entity, raw_time=time if pushes else None,
                     logical=tuple(c for c in features if parts[c] == "logical"))
    return out, spec


EVENTS_SPEC = FrameSpec(
    name="events",
    numeric=("value", "k", "s_acctbal", "s_nationkey", "c_acctbal", "c_nationkey"),
    text=("c_mktsegment", "c_nation"),
    id="row_id", time="t", label="y", segment="c_mktsegment", entity="user_id",
    extra=("event_type",), raw_time="ts",
)


def events_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` LEFT ``supplier`` LEFT ``customer`` LEFT ``nation``.

    Users outnumber suppliers, so the supplier columns go missing together: a
    natural missingness family. Label: ``event_type = 'error'``.
    """
    e = read_table(spark, sf_dir, "events")
    s = read_table(spark, sf_dir, "supplier")
    c = read_table(spark, sf_dir, "customer")
    n = read_table(spark, sf_dir, "nation")
    df = (e.join(s, e.user_id == s.s_suppkey, "left")
           .join(c, e.user_id == c.c_custkey, "left")
           .join(n, F.col("c_nationkey") == n.n_nationkey, "left")
           .select(F.col("event_id").alias("row_id"),
                   unix_seconds("ts", _zoneless(e, "ts")).alias("t"), F.col("ts"),
                   (F.col("event_type") == F.lit("error")).cast("int").alias("y"),
                   F.col("event_type"),
                   F.col("user_id"),
                   F.col("value").cast("double").alias("value"),
                   F.get_json_object("props", "$.k").cast("long").alias("k"),
                   F.col("s_acctbal").cast("double").alias("s_acctbal"),
                   F.col("s_nationkey").cast("long").alias("s_nationkey"),
                   F.col("c_acctbal").cast("double").alias("c_acctbal"),
                   F.col("c_nationkey").cast("long").alias("c_nationkey"),
                   F.col("c_mktsegment"),
                   F.col("n_name").alias("c_nation")))
    return nan_to_null(df)


#: Seconds from which the planted columns behave as in the late window (mid-January 2024).
PLANTED_FROM = 1705320000

PLANTED_SPEC = FrameSpec(
    name="planted", numeric=EVENTS_SPEC.numeric + ("flip", "flip_mate", "drift_a", "drift_b"), text=EVENTS_SPEC.text,
    id="row_id", time="t", label="y", segment="c_mktsegment", entity="user_id", extra=("event_type",), raw_time="ts",
)


def planted_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events frame with four columns that an audit has to reject: ``flip`` ranks the
    label up before mid-month and down after it, ``flip_mate`` shares its block,
    ``drift_a`` and ``drift_b`` move by one."""
    def spread(times: int, plus: int, of: int):
        return (F.col("row_id") * times + plus) % of / F.lit(float(of))

    late = F.when(F.col("t") >= PLANTED_FROM, 1).otherwise(0)
    return events_frame(spark, sf_dir).withColumns({
        "flip": spread(7919, 13, 1009) + F.lit(0.35) * F.col("y") * (1 - 2 * late), "flip_mate": spread(104729, 7, 997),
        "drift_a": spread(15485863, 3, 991) + late, "drift_b": spread(7919, 13, 1009) * spread(104729, 7, 997) + late})


LINES_SPEC = FrameSpec(
    name="lines",
    numeric=("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber",
             "o_totalprice", "p_size", "p_retailprice", "c_acctbal", "c_nationkey"),
    text=("l_linestatus", "o_orderstatus", "o_orderpriority", "p_brand", "p_type",
          "c_mktsegment"),
    id="row_id", time="t", label="y", segment="c_mktsegment", entity="o_custkey",
    raw_time="l_shipdate",
)


def lines_frame(spark: SparkSession, sf_dir: str, lookups: dict | None = None) -> DataFrame:
    """``lineitem`` joined to ``part`` and to ``orders`` with their ``customer``.

    The volume frame. Label: ``l_returnflag = 'R'``; time: ship date. There is
    no unique key, so the row id is a hash of the full lineitem row. Customers meet
    the orders first, so the lines move once by part and once by order. ``lookups``
    (``operators.derive``) add counts to the part and order tables in the same way.
    """
    l = read_table(spark, sf_dir, "lineitem")
    o = read_table(spark, sf_dir, "orders")
    p = read_table(spark, sf_dir, "part")
    c = read_table(spark, sf_dir, "customer")
    lcols = [F.col(x) for x in l.columns]
    o, found = o.join(c, o.o_custkey == c.c_custkey, "inner"), []
    for column, add in (lookups or {}).items():
        before = {*o.columns, *p.columns}
        if column in o.columns:
            o = add(o, column)
        else:
            p = add(p, "p_partkey" if column == "l_partkey" else column)
        found += [x for x in (*o.columns, *p.columns) if x not in before]
    df = (l.join(p, F.col("l_partkey") == F.col("p_partkey"), "inner")
           .join(o, F.col("l_orderkey") == F.col("o_orderkey"), "inner")
           .select(F.xxhash64(*lcols).alias("row_id"),
                   unix_seconds("l_shipdate", _zoneless(l, "l_shipdate")).alias("t"), F.col("l_shipdate"),
                   F.col("l_orderkey"), F.col("l_partkey"),
                   F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date"))
                    .cast("double").alias("days_since_order"),
                   (F.col("l_returnflag") == F.lit("R")).cast("int").alias("y"),
                   F.col("o_custkey"),
                   F.col("l_quantity").cast("double"), F.col("l_extendedprice").cast("double"),
                   F.col("l_discount").cast("double"), F.col("l_tax").cast("double"),
                   F.col("l_linenumber").cast("long"), F.col("o_totalprice").cast("double"),
                   F.col("p_size").cast("long"), F.col("p_retailprice").cast("double"),
                   F.col("c_acctbal").cast("double"), F.col("c_nationkey").cast("long"),
                   F.col("l_linestatus"), F.col("o_orderstatus"), F.col("o_orderpriority"),
                   F.col("p_brand"), F.col("p_type"), F.col("c_mktsegment"), *[F.col(x) for x in found]))
    return nan_to_null(df)


DOCS_SPEC = FrameSpec(
    name="docs",
    numeric=("n_chars",),
    text=("lang", "source"),
    id="doc_id", time="doc_id", label="quality", segment="lang", entity="source",
)


def docs_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` LEFT ``labels``: a sparse side table, so ``quality`` and
    ``toxic`` are null where no label exists."""
    d = read_table(spark, sf_dir, "documents")
    lb = read_table(spark, sf_dir, "labels")
    return (d.join(lb, "doc_id", "left")
             .select("doc_id", "lang", "source", "n_chars", "quality", "toxic"))


#: What ``audit_frame`` makes of the orders table (a test holds them equal).
ORDERS_SPEC = FrameSpec(
    name="orders", numeric=("o_totalprice", "c_nationkey", "c_acctbal", "in_debt", "urgent"),
    text=("o_orderpriority", "c_mktsegment"), id="row_id", time="t", label="y", segment="c_mktsegment",
    entity="o_custkey", raw_time="o_orderdate", logical=("in_debt", "urgent"),
)


def orders_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` LEFT ``customer`` with two true / false columns; ``in_debt`` is null for
    customers with a balance below 100."""
    o, c = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "customer")
    return (o.join(c, o.o_custkey == c.c_custkey, "left")
             .withColumn("in_debt", F.when(F.abs("c_acctbal") >= 100, F.col("c_acctbal") < 0))
             .withColumn("urgent", F.col("o_orderpriority") == "1-URGENT"))


def orders_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders table as a user would audit it: nothing but its parts is named."""
    return audit_frame(orders_table(spark, sf_dir), "o_orderstatus", "o_orderdate", exclude=("c_custkey", "c_name"),
                       positive="F", id="o_orderkey", segment="c_mktsegment", entity="o_custkey", name="orders")[0]


FRAMES = {
    "orders": (orders_frame, ORDERS_SPEC),
    "events": (events_frame, EVENTS_SPEC),
    "planted": (planted_frame, PLANTED_SPEC),
    "lines": (lines_frame, LINES_SPEC),
    "docs": (docs_frame, DOCS_SPEC),
}


def load_frame(spark: SparkSession, sf_dir: str, name: str = "events"):
    build, spec = FRAMES[name]
    return build(spark, sf_dir), spec
