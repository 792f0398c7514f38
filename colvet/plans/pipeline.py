"""One audit's shared intermediates, built lazily from a frame.

``prepare`` wires frame -> windows -> VALUES -> binning -> CELLS. The four
window edges are computed first (they become literals, so the window filter is
pushed into the Parquet scan).

VALUES is the one reduction whose size follows the data (distinct values per
feature); every audit reads it, so it is written once to the reliable
checkpoint folder (shared storage on a cluster: it survives executor loss, and
later plans start from it instead of from the raw scan and joins). Everything
after it -- the binning, CELLS, WoE -- is bounded by features x bins and is
checkpointed the same way, so plans stay small and each branch reads a table
instead of repeating the lineage.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import binning as B
from ..operators import windows as Wn
from ..operators import woe as W
from ..policy import AUDIT_HOLDOUT, AUDIT_TRAIN
from ..session import cut_lineage, stored
from ..sources.frames import FrameSpec, audit_frame, load_frame
from . import suffstats as S


@dataclass
class Audit:
    spark: SparkSession
    spec: FrameSpec
    frame: DataFrame
    win: Wn.Windows
    bins: int = 10
    max_levels: int = 20
    persist: bool = True
    features: tuple = field(default_factory=tuple)
    store: bool = False  # write the windows' rows once: for audits that read them many times

    @cached_property
    def fw(self) -> DataFrame:
        fw = Wn.with_window(self.frame, self.spec.time, self.win, self.spec.raw_time)
        return stored(fw) if self.store else fw

    @cached_property
    def values(self) -> DataFrame:
        v = S.values_table(self.fw, self.spec, self.features or None)
        return cut_lineage(v) if self.persist else v

    @cached_property
    def binning(self) -> DataFrame:
        b = B.fit(self.values, self.spec, self.features or None, self.bins, self.max_levels)
        return cut_lineage(b) if self.persist else b

    @cached_property
    def cells(self) -> DataFrame:
        c = S.cells_table(self.values, self.binning)
        return cut_lineage(c) if self.persist else c

    @cached_property
    def woe(self) -> DataFrame:
        full = W.complete_cells(self.cells, self.binning, ["early", "late"])
        w = W.woe_table(full)
        return cut_lineage(w) if self.persist else w

    def woe_of(self, window: str) -> DataFrame:
        return self.woe.where(F.col("window") == F.lit(window))

    @cached_property
    def window_sizes(self) -> DataFrame:
        """Rows and positives per window (one row per window)."""
        return (self.fw.groupBy("window")
                       .agg(F.count(F.lit(1)).alias("rows"),
                            F.sum(F.col(self.spec.label)).cast("long").alias("positives")))


_AUDITS: dict = {}


def _data_signature(spark: SparkSession, sf_dir: str) -> tuple:
    """Names, sizes and modification times of the input files as the file system
    behind Spark lists them (local, HDFS or an object store): a cached audit is
    reused only while its inputs are unchanged."""
    jvm, sc = spark._jvm, spark._jsc
    path = jvm.org.apache.hadoop.fs.Path(sf_dir)
    out, todo = [], [path]
    fs = path.getFileSystem(sc.hadoopConfiguration())
    while todo:
        for f in fs.listStatus(todo.pop()):
            if f.isDirectory():
                todo.append(f.getPath())
            else:
                out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def prepare(spark: SparkSession, sf_dir: str, frame: str = "events", bins: int = 10,
            max_levels: int = 20, train=AUDIT_TRAIN, holdout=AUDIT_HOLDOUT,
            persist: bool = True, features=(), store: bool = False) -> Audit:
    """The audit's shared intermediates for one frame.

    One audit run reads the same VALUES, binning and CELLS in every check, so
    the prepared audit is shared within a Spark application for the same
    inputs and parameters (the intermediates live in the checkpoint folder).
    """
    key = (spark.sparkContext.applicationId, sf_dir, frame, bins, max_levels, tuple(train),
           tuple(holdout), persist, tuple(features), store, _data_signature(spark, sf_dir))
    if key in _AUDITS:
        return _AUDITS[key]
    df, spec = load_frame(spark, sf_dir, frame)
    win = Wn.time_windows(df, spec.time, train, holdout)
    a = Audit(spark, spec, df, win, bins, max_levels, persist, tuple(features), store)
    if persist:
        _AUDITS[key] = a
    return a


def prepare_table(df: DataFrame, label: str, time: str, exclude=(), features=None, positive=None, id: str | None = None,
                  segment: str | None = None, entity: str | None = None, bins: int = 10, max_levels: int = 20,
                  train=AUDIT_TRAIN, holdout=AUDIT_HOLDOUT, persist: bool = True) -> Audit:
    """``prepare`` for a table of the user's own: parts are read off its schema
    (``sources.frames.audit_frame``). Keep the returned audit; it is not cached."""
    frame, spec = audit_frame(df, label, time, exclude, features, positive, id, segment, entity)
    return Audit(df.sparkSession, spec, frame, Wn.time_windows(frame, spec.time, train, holdout), bins, max_levels, persist)
