"""Spark session defaults and the shared checkpoint location.

Everything in the package takes a ``SparkSession`` argument; this module only
supplies a session for scripts and tests, and the one place that decides where
lineage is cut.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every audit relies on. UTC because the time axis is integer seconds
# taken from timestamps; AQE so shuffle sizes and skewed joins are re-planned
# from runtime statistics instead of guessed.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "colvet") -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if os.environ.get("COLVET_DRIVER_MEMORY"):
        builder = builder.config("spark.driver.memory", os.environ["COLVET_DRIVER_MEMORY"])
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``colvet`` importable in every Python worker (once per application).

    Pandas UDFs and grouped-map functions refer to package functions by
    module; the package is zipped and handed to ``addPyFile``, which is how
    code reaches executors on a cluster whatever the driver's working folder.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    # Workers start in the driver's folder with its PYTHONPATH: when either
    # already holds the package, shipping it again only adds overhead.
    on_path = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if spark.sparkContext.master.startswith("local") and (os.path.abspath(os.getcwd()) == root or root in on_path):
        _SHIPPED.add(app)
        return
    import zipfile
    out = os.path.join(tempfile.mkdtemp(prefix="colvet-pkg-"), "colvet.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith((".py", ".json")):
                    full = os.path.join(root, f)
                    z.write(full, os.path.join("colvet", os.path.relpath(full, pkg)))
    spark.sparkContext.addPyFile(out)
    _SHIPPED.add(app)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint folder; set a scratch one only when unset.

    On a cluster ``spark.checkpoint.dir`` names a shared, fault-tolerant folder
    and is used as is. Only a session without one (tests, local runs) gets a
    fresh scratch folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="colvet-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    ship_package(spark)
    return d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` to the reliable checkpoint folder.

    Used where one intermediate feeds several branches and must be identical in
    each (for example a table whose bucket bounds were computed from it). A
    reliable checkpoint survives the loss of the executors that produced it.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Shuffle files of what is written inside go as soon as each write has ended.

    Spark keeps them until the driver's garbage is collected, so several large
    writes of one job would hold their files at the same time. For writes only: a
    frame that is collected twice would have to make its shuffles again.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet beside the checkpoints, and read back.

    For wide or long intermediates that several passes read: a few bytes a value
    where a checkpoint keeps whole rows, and a later pass reads only its columns.
    """
    spark = df.sparkSession
    path = os.path.join(ensure_checkpoint_dir(spark), "colvet-out", f"rows-{uuid.uuid4().hex[:12]}")
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
