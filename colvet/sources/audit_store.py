"""The audit frame on disk: built once with its derived columns, written in time order
with a manifest, read back by window from the files that hold it.

``build``   frame -> block null count -> frequency maps fitted on the same frame ->
            derived columns, in that order: a derived column never feeds its own map.
``write``   ``data/`` dealt over slices of time, ``maps/`` the fitted levels, ``fitted/``
            rows, levels and a digest per map, ``manifest/`` rows, time range and null
            counts per file.
``read_window``  finds the four window edges as order statistics from the manifest and at
            most four files, then reads only the files that reach into a window.

The manifest has one row per file; the driver reads it and one bound per slice.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DecimalType, IntegralType, NumericType, TimestampNTZType, TimestampType

from ..functions.columns import null_count
from ..operators import derive as DV
from ..operators.windows import Windows, check_windows, nearest_rank
from ..plans.cumulative import order_statistics
from ..policy import AUDIT_HOLDOUT, AUDIT_TRAIN
from ..session import shuffles_dropped

NULL_COUNT = "null_count"
#: Rows that one slice of time aims for, and bytes of rows that a Python worker holds while it packs them.
SLICE_ROWS = 1_000_000
PACK_BYTES = 128 << 20


@dataclass
class Built:
    """A frame with its derived columns, and what the fitted ones learned."""
    frame: DataFrame
    maps: DataFrame | None
    summary: DataFrame | None
    specs: tuple
    bare: DataFrame | None = None      # the frame before ``derive``, where that needs no join
    derive: Callable | None = None
    times: DataFrame | None = None     # the time of every row, stored


def build(frame: DataFrame, specs=(), blocks=(), time: str = "t", again=None) -> Built:
    """``frame`` with ``null_count`` over the ``blocks`` columns that it has and the columns
    of ``specs``; maps are fitted on the frame before any column is derived. ``again``
    gives the same frame with the counts of ``DV.lookups`` added where its tables hold the keys."""
    present = [c for c in blocks if c in frame.columns]
    encoded = DV.frequency_encoded_columns(specs)
    maps = summary = times = None
    if encoded:
        narrow = DV.fitted_columns(frame, encoded, time)
        maps, summary = DV.fit_frequency_maps(frame, encoded, time, narrow=narrow)
        times = narrow.select(time)
        frame = again(DV.lookups(maps, encoded)) if again else frame

    def derive(rows: DataFrame) -> DataFrame:
        return DV.apply_derivations(rows.withColumn(NULL_COUNT, null_count(present).cast("int")), specs, maps, time)

    row_local = all(DV.looked_up(s.inputs[0]) in frame.columns and s.params.get("map_key", s.inputs[0]) == s.inputs[0]
                    for s in specs if s.tool == "frequency_encode")
    return Built(derive(frame), maps, summary, tuple(specs), frame if row_local else None, derive, times)


def map_digests(maps: DataFrame) -> DataFrame:
    """(column, levels, rows, digest) per map. The digest is the sum of 60 bits of each
    level's MD5 with its count, so it does not depend on the order of the levels."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("\t", "level", F.col("n").cast("string"))), 1, 15), 16, 10).cast("decimal(38,0)")
    return maps.groupBy("column").agg(F.count(F.lit(1)).alias("levels"), F.sum("n").cast("long").alias("rows"),
                                      F.sum(bits).cast("decimal(38,0)").cast("string").alias("digest"))


def _number(df: DataFrame, time: str):
    """(a long or double per row that is equal and sorts like ``time``, the smallest such
    number), or None where the type has none."""
    t, c = df.schema[time].dataType, F.col(time)
    if isinstance(t, TimestampNTZType):  # against the zone-less epoch
        c = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{time}`)")
    elif isinstance(t, TimestampType):
        c = F.unix_micros(c)
    elif isinstance(t, DateType):
        c = F.unix_date(c)
    elif not isinstance(t, NumericType) or isinstance(t, DecimalType) and t.precision > 15:
        return None
    elif not isinstance(t, IntegralType):
        return c.cast("double"), float("-inf")
    return c.cast("long"), -(1 << 63)


def _bounds(times: DataFrame, number, least) -> np.ndarray:
    """Values of ``number`` that cut the rows into slices of about ``SLICE_ROWS`` (one value per
    slice); rows without a number come first, as ``least``."""
    whole = isinstance(least, int)
    n = times.agg(F.count(number).alias("known"), F.count(F.when(number.isNull(), 1)).alias("none"), F.min(number).alias("first")).first()
    slices, found = -(-n["known"] // SLICE_ROWS), []
    if slices > 1:
        # sketches are of doubles: whole numbers are taken from the first one, so that they stay exact
        level = F.try_subtract(number, F.lit(n["first"])) if whole else F.when(~F.isnan(number), number)
        found = times.agg(F.percentile_approx(level, [i / slices for i in range(1, slices)], max(10_000, 20 * slices))).first()[0] or []
    shift = n["first"] if whole and found else 0
    return np.array([least] * (n["none"] // SLICE_ROWS) + [x + shift for x in found], dtype="int64" if whole else "float64")


def _pieces(held: list, bounds: np.ndarray, at: str, deal: str) -> pa.RecordBatch:
    """(slice, its rows as a compressed Arrow stream) of the batches ``held``, which is emptied."""
    table = pa.Table.from_batches(held).combine_chunks()
    held.clear()
    value, dealt = table[at].to_numpy(), table[deal].to_numpy()
    first = np.searchsorted(bounds, value, "left")
    # rows of a time that is a bound are dealt over all slices that it reaches into
    piece = first + dealt % (np.searchsorted(bounds, value, "right") - first + 1)
    order, table = np.lexsort((value, piece)), table.drop_columns([at, deal])
    found, starts = np.unique(piece[order], return_index=True)
    texts = [(i, f.name) for i, f in enumerate(table.schema) if pa.types.is_string(f.type) or pa.types.is_large_string(f.type)]
    out = []
    for rows in np.split(order, starts[1:]):
        part = table.take(pa.array(rows))
        for i, name in texts:
            part = part.set_column(i, name, part[name].dictionary_encode())
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_table(part)
        out.append(sink.getvalue().to_pybytes())
    return pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(out, pa.binary())], names=["slice", "rows"])


def _by_time(rows: DataFrame, time: str, times: DataFrame | None) -> DataFrame:
    """``rows`` dealt over ranges of (time, hash of the row's numbers and texts), each sorted by time.

    Where ``times`` holds the time of every row already, slices of time are cut beforehand and
    rows cross the shuffle column by column, packed per slice: less than half of the bytes that
    they take one by one, and the rows need not be made twice to find the ranges.
    """
    plain = [c for c, t in rows.dtypes if not t.startswith(("map", "variant"))]
    spread = F.xxhash64(*[F.col(f"`{c}`") for c in plain])
    number = _number(rows, time)
    if times is None or number is None or any(x in t for _, t in rows.dtypes for x in ("variant", "interval", "void")):
        return rows.repartitionByRange(F.col(time), spread).sortWithinPartitions(F.col(time))
    number, least = number
    bounds = _bounds(times, number, least)
    at, deal = (next(x for x in (n * i for i in range(1, 9)) if x not in rows.columns) for n in ("_at", "_deal"))

    def pack(batches):
        held, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.nbytes
            if size >= PACK_BYTES:
                yield _pieces(held, bounds, at, deal)
                size = 0
        if held:
            yield _pieces(held, bounds, at, deal)

    def unpack(batches):
        for b in batches:
            for piece in b.column(0):
                with pa.ipc.open_stream(piece.as_buffer()) as stream:
                    for x in stream:
                        columns = [c.dictionary_decode() if pa.types.is_dictionary(c.type) else c for c in x.columns]
                        yield pa.RecordBatch.from_arrays(columns, names=x.schema.names)

    packed = rows.select("*", F.coalesce(number, F.lit(least)).alias(at), F.pmod(spread, F.lit(1 << 20)).alias(deal)).mapInArrow(pack, "slice int, rows binary")
    dealt = packed.repartitionById(len(bounds) + 1, "slice").select("rows").mapInArrow(unpack, rows.schema)
    return dealt.sortWithinPartitions(F.col(time))


def write(built: Built, path: str, time: str = "t", rows_per_file: int = 2_000_000) -> str:
    """Write the frame, its maps and the manifest under ``path`` (which must not exist).

    Files hold consecutive times, and one time value that holds many rows still spreads over files.
    """
    frame, spark = built.frame, built.frame.sparkSession
    # what follows from a row alone is derived after the rows have moved
    dealt = _by_time(frame if built.bare is None else built.bare, time, built.times)
    data = dealt if built.bare is None else built.derive(dealt)
    with shuffles_dropped(spark):
        data.write.option("maxRecordsPerFile", rows_per_file).option("compression", "zstd").parquet(f"{path}/data")
    back = spark.read.schema(frame.schema).parquet(f"{path}/data")
    per_file = back.groupBy(F.col("_metadata.file_name").alias("file")).agg(
        F.count(F.lit(1)).alias("rows"), F.count(time).alias("timed_rows"), F.min(time).alias("first"), F.max(time).alias("last"),
        F.array(*[F.struct(F.lit(c).alias("column"), F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias("nulls"))
                  for c in frame.columns]).alias("null_counts"))
    per_file.coalesce(1).write.parquet(f"{path}/manifest")  # one row per file
    if built.maps is not None:
        built.maps.write.parquet(f"{path}/maps")
        map_digests(built.maps).coalesce(1).write.parquet(f"{path}/fitted")
    specs = json.dumps(DV.declarations(built.specs))
    spark.createDataFrame([(specs,)], "value string").coalesce(1).write.text(f"{path}/derivations")
    return path


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/manifest")


def column_nulls(spark: SparkSession, path: str) -> DataFrame:
    """(column, rows, nulls) of the whole frame, from the manifest alone."""
    m = read_manifest(spark, path)
    return (m.select("rows", F.explode("null_counts").alias("c")).groupBy(F.col("c.column").alias("column"))
             .agg(F.sum("rows").alias("rows"), F.sum("c.nulls").alias("nulls")))


def _edges(spark: SparkSession, path: str, files: list, time: str, probs) -> list:
    """Order statistics of ``time``. Files hold consecutive times, so the manifest says which
    file each rank falls in; only those are read."""
    total = sum(f["timed_rows"] for f in files)
    if not total:
        raise ValueError(f"no row of {path} has a time")
    wanted, read = [], {}
    for i, p in enumerate(probs):
        rank = nearest_rank(p, total)
        for f in files:
            if rank < f["timed_rows"]:
                break
            rank -= f["timed_rows"]
        wanted.append((f["file"], i, rank))
        read[f["file"]] = f["timed_rows"]
    one = (spark.read.parquet(*[f"{path}/data/{x}" for x in read]).where(F.col(time).isNotNull())
                .groupBy(F.col("_metadata.file_name").alias("file"), time).agg(F.count(F.lit(1)).alias("n")))
    ranks = spark.createDataFrame(wanted, "file string, i int, rank long")
    got = {r["i"]: r["value"] for r in order_statistics(one, ["file"], time, "n", ranks, max_key_rows=max(read.values())).collect()}
    return [got[i] for i in range(len(probs))]


def read_window(spark: SparkSession, path: str, time: str = "t", train=AUDIT_TRAIN, holdout=AUDIT_HOLDOUT,
                columns=None) -> tuple[DataFrame, Windows, list]:
    """The rows of the two windows tagged ``window``, the windows, and the names of the
    files that were read for them."""
    check_windows(train, holdout)
    files = [f for f in read_manifest(spark, path).select("file", "timed_rows", "first", "last")
             .orderBy("first", "last").collect() if f["timed_rows"]]
    win = Windows(tuple(train), tuple(holdout), tuple(_edges(spark, path, files, time, [*train, *holdout])))

    def reaches(f, lo, hi, closed):
        return f["last"] >= lo and (f["first"] <= hi if closed else f["first"] < hi)

    e = win.edges
    use = [f["file"] for f in files if reaches(f, e[0], e[1], train[1] == 1.0) or reaches(f, e[2], e[3], holdout[1] == 1.0)]
    everything = spark.read.parquet(f"{path}/data")
    rows = spark.read.schema(everything.schema).parquet(*[f"{path}/data/{x}" for x in use])
    kind = everything.schema[time].dataType.simpleString()
    early, late = win.condition(time, "early", kind), win.condition(time, "late", kind)
    if columns is not None:
        rows = rows.select(*dict.fromkeys([*columns, time]))
    return rows.where(early | late).withColumn("window", F.when(early, F.lit("early")).otherwise(F.lit("late"))), win, use
