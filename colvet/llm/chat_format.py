"""Chat formatting by perspective rotation: for every participant of a
conversation, the dialogue with that speaker as the assistant, everyone else as
a named user, and the mask of the characters that the assistant says.

All of it is DataFrame functions. A conversation is rendered in parts of
``PART`` turn numbers, so that one very long conversation is many small rows.
Turn numbers need not be distinct: a part whose turns take more than ``LIMIT``
bytes (``ROW`` added for each turn) is cut further, into rows of about that
size with the same ``part``. ``char_start`` places each row in the whole
rendering; rows joined in the order of ``part``, then ``char_start``, are the
whole rendering.

Format of a turn: ``<|start|>NAME\\nTEXT<|end|>\\n`` with NAME ``assistant`` for
the chosen speaker, ``system`` for system turns (never rotated), else
``user:SPEAKER``. A mask span covers TEXT and ``<|end|>`` of an assistant turn,
as ``start:end`` in code points from the beginning of the whole rendering.

Defined results: a null text is empty; a null role speaks as ``unknown``; a
null turn number comes after all others (its own part); turns with the same
number are ordered by role, then text; repeated rows stay. Rows with a null
conversation id are one conversation. Conversations with system turns only
have no participant and no row. Extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

PART = 64
#: Size of a row's array and strings up to which a part is one row; ``ROW`` is added per turn.
LIMIT, ROW = 4 << 20, 1 << 10
#: Leading letters of a text that range partitioning compares.
LEAD = 128
OPEN, CLOSE = "<|start|>", "<|end|>"

_CONV = ["unnamed", "conv"]  # a null conversation id as two columns that are never null
_GROUP = [*_CONV, "part"]
_UNIT = [*_GROUP, "slice", "cut"]


def _turns(df: DataFrame) -> DataFrame:
    conv = F.col("conv_id").cast("long")
    return df.select(
        conv.isNull().alias("unnamed"), F.coalesce(conv, F.lit(0)).alias("conv"),
        F.coalesce(F.floor(F.col("turn").cast("long") / PART).cast("long"), F.lit(2**62)).alias("part"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _name_length(role):
    """Length of a turn's name, unless its speaker is the assistant."""
    return F.when(role == "system", F.length(F.lit("system"))).otherwise(F.length(F.lit("user:")) + F.length(role))


def _size():
    return F.octet_length("text") + F.octet_length("role") + ROW


def _counts(t: DataFrame, by: list) -> DataFrame:
    """Turns, rendered length (nobody the assistant) and size per group and role."""
    marks = len(OPEN) + len(CLOSE) + 2
    return t.groupBy(*by, "role").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.length("text") + _name_length(F.col("role")) + marks).cast("long")).alias("length"),
        F.sum(_size().cast("long")).alias("size"))


def _cut(t: DataFrame, hot: DataFrame) -> DataFrame:
    """The turns of the parts in ``hot`` with ``(slice, cut)``: consecutive turns
    of about ``LIMIT`` bytes, numbered in the order of the turns. The order comes from
    range partitions; equal turns are spread over them by a row number, so that
    neither a hot part nor one turn repeated many times is one task's."""
    short = F.length("text") <= LEAD
    order = [*_GROUP, "turn", "role", "lead", "tie"]
    t = (t.withColumn("lead", F.substring("text", 1, LEAD))
          .withColumn("tie", F.when(short, F.monotonically_increasing_id()).otherwise(F.lit(2**63 - 1)))
          .join(hot, _GROUP, "left_semi"))
    spark = t.sparkSession
    slices = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    t = t.repartitionByRange(slices, *order).sortWithinPartitions(*order, "text")
    t = t.withColumn("at", F.monotonically_increasing_id()).withColumn("slice", F.spark_partition_id())
    before = F.sum(_size().cast("long")).over(
        Window.partitionBy("slice").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    t = t.withColumn("cut", F.floor(F.coalesce(before, F.lit(0)) / LIMIT).cast("long"))
    return materialize(t.select(*_UNIT, "turn", "role", "text"), "hot-turns")


def _starts(counts: DataFrame, who: DataFrame) -> DataFrame:
    """``char_start`` per unit and participant: a running sum of rendered lengths over
    all units of a conversation, as range partitions with an offset each."""
    total = counts.groupBy(*_UNIT).agg(F.sum("length").alias("length"))
    own = counts.select(*_UNIT, F.col("role").alias("participant"), "n")
    name = F.length(F.lit("assistant")) - _name_length(F.col("participant"))
    rows = (total.join(who, _CONV).join(own, [*_UNIT, "participant"], "left")
                 .withColumn("length", F.col("length") + F.coalesce("n", F.lit(0)) * name))
    view = [*_CONV, "participant"]
    rows = rows.repartitionByRange(*view, "part", "slice", "cut").withColumn("stretch", F.spark_partition_id())
    rows = materialize(rows.select(*_UNIT, "participant", "length", "stretch"), "starts")
    first = Window.unboundedPreceding
    stretches = (rows.groupBy(*view, "stretch").agg(F.sum("length").alias("length"))
                     .withColumn("before", F.sum("length").over(Window.partitionBy(*view).orderBy("stretch").rowsBetween(first, -1)))
                     .drop("length"))
    inside = F.sum("length").over(Window.partitionBy(*view, "stretch").orderBy("part", "slice", "cut").rowsBetween(first, -1))
    return (rows.withColumn("inside", inside).join(stretches, [*view, "stretch"])
                .select(*_UNIT, "participant", (F.coalesce("before", F.lit(0)) + F.coalesce("inside", F.lit(0))).cast("long").alias("char_start")))


def rotate(df: DataFrame) -> DataFrame:
    """``(conv_id, participant, part, char_start, n_turns, n_masked, rendered, mask)``,
    one row per conversation, participant and part (several, told apart by
    ``char_start``, for a part beyond ``LIMIT``)."""
    t = _turns(df)
    counts = materialize(_counts(t, _GROUP), "counts")
    who = counts.where(F.col("role") != "system").select(*_CONV, F.col("role").alias("participant")).distinct()
    hot = counts.groupBy(*_GROUP).agg(F.sum("size").alias("size")).where(F.col("size") > LIMIT).select(*_GROUP)
    hot = materialize(hot, "hot-parts")
    whole = [F.lit(0).alias("slice"), F.lit(0).cast("long").alias("cut")]
    if hot.isEmpty():
        t, counts = t.select("*", *whole), counts.select("*", *whole)
    else:
        cut = _cut(t, hot)
        t = t.join(hot, _GROUP, "left_anti").select("*", *whole).unionByName(cut)
        counts = counts.join(hot, _GROUP, "left_anti").select("*", *whole).unionByName(_counts(cut, _UNIT))
    units = t.groupBy(*_UNIT).agg(F.sort_array(F.collect_list(F.struct(
        F.col("turn").isNull().alias("last"), "turn", "role", "text"))).alias("turns"))
    both = units.join(_starts(counts, who), _UNIT)
    name = lambda x: (F.when(x["role"] == F.col("participant"), F.lit("assistant"))
                      .when(x["role"] == "system", F.lit("system")).otherwise(F.concat(F.lit("user:"), x["role"])))
    seg = F.transform("turns", lambda x: F.struct(
        F.concat(F.lit(OPEN), name(x), F.lit("\n")).alias("head"),
        F.concat(x["text"], F.lit(CLOSE)).alias("body"),
        (x["role"] == F.col("participant")).alias("own")))
    conv = F.when(~F.col("unnamed"), F.col("conv")).alias("conv_id")
    both = both.select(conv, "participant", "part", "char_start", seg.alias("seg"))
    both = both.withColumn("rendered", F.array_join(F.transform(
        "seg", lambda s: F.concat(s["head"], s["body"], F.lit("\n"))), ""))
    zero = F.struct(F.col("char_start").alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc, s):
        begin = acc["at"] + F.length(s["head"])
        end = begin + F.length(s["body"])
        span = F.concat(begin.cast("string"), F.lit(":"), end.cast("string"))
        return F.struct((end + 1).alias("at"),
                        F.when(s["own"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    both = both.withColumn("spans", F.aggregate("seg", zero, step)["spans"])
    return both.select(
        "conv_id", "participant", "part", "char_start", F.size("seg").cast("long").alias("n_turns"),
        F.size("spans").cast("long").alias("n_masked"), "rendered", F.array_join("spans", ",").alias("mask"))


ORACLE = f"""
WITH t AS (
  SELECT conv_id, coalesce(CAST(floor(turn / {PART}.0) AS BIGINT), {2**62}) AS part, turn, coalesce(role, 'unknown') AS role,
         coalesce(text, '') AS text FROM conversations),
who AS (SELECT DISTINCT conv_id, role AS participant FROM t WHERE role <> 'system'),
s AS (
  SELECT t.conv_id, participant, part, turn, role, text, role = participant AS own,
         '{OPEN}' || CASE WHEN role = participant THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user:' || role END
             || chr(10) AS head, text || '{CLOSE}' AS body
  FROM t JOIN who ON t.conv_id IS NOT DISTINCT FROM who.conv_id),
p AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, participant
             ORDER BY part, turn NULLS LAST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM s)
SELECT conv_id, participant, part, CAST(min(pos) AS BIGINT) AS char_start, count(*) AS n_turns,
       count(*) FILTER (own) AS n_masked,
       string_agg(head || body || chr(10), '' ORDER BY turn NULLS LAST, role, text) AS rendered,
       coalesce(string_agg((CAST(pos AS BIGINT) + length(head)) || ':' || (CAST(pos AS BIGINT) + length(head) + length(body)), ','
                ORDER BY turn NULLS LAST, role, text) FILTER (own), '') AS mask
FROM p GROUP BY conv_id, participant, part"""
