"""Tables in the cluster's shared folder, which cut lineage and outlive executors."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or, where that is unset and all tasks run in this process (tests),
    one of our own.  A cluster without that setting is refused: its executors don't see a local folder."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="bnspark-"))
        atexit.register(shutil.rmtree, _OWN_DIR[0], ignore_errors=True)
    return "file://" + _OWN_DIR[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/bnspark/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.  The table has no lineage, and
    any executor can read it again after another one is lost."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._bnspark_path = path
    return back


def drop(df: DataFrame | None) -> None:
    """Delete a materialized table that no later plan reads."""
    path = getattr(df, "_bnspark_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of jobs that are over.  Spark deletes them once the driver's JVM has collected
    what stands for them, and a driver with memory to spare may not do so before the disks are full."""
    gc.collect()  # what Python still holds of the JVM's objects
    spark._jvm.System.gc()


def shrink(spark: SparkSession) -> None:
    """release(), and let executors give back what heap a stage before has left them with: a heap that has grown stays
    so, beside all that the next stage's Python workers hold.  As many tasks as there are cores reach each executor."""
    release(spark)
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')")).collect()
