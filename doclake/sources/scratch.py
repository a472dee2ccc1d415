"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import contextlib
import contextvars
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir or the context's checkpoint folder; one of this machine only where neither
    is set and everything runs on this machine, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-doclake-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/doclake-{uuid.uuid4().hex}"


_folder: contextvars.ContextVar[str | None] = contextvars.ContextVar("folder", default=None)


def removed(spark: SparkSession, path: str) -> None:
    """Removes a folder of written tables, which nothing may read any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: The share of its greatest size that the heap of the driver's JVM may take before its garbage is collected.
FULL = 0.5


def tidied(spark: SparkSession) -> bool:
    """Collects the garbage of the driver where its heap has grown: the plans of what was written before. Else the heap
    grows to its greatest size, as nothing makes the JVM give memory back, and a chain of conversions takes it all."""
    jvm = spark.sparkContext._jvm
    now = jvm.Runtime.getRuntime()
    if now.totalMemory() < FULL * now.maxMemory():
        return False
    gc.collect()
    jvm.System.gc()
    return True


@contextlib.contextmanager
def measured_joins(spark: SparkSession):
    """Within, a table is broadcast only by the size that its rows were measured to have, not by that of its files: those of
    many documents alike are small, but the driver would have to hold all their rows."""
    static, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before, known = spark.conf.get(static), spark.conf.get(adaptive, None)
    spark.conf.set(adaptive, known or before)
    spark.conf.set(static, "-1")
    try:
        yield
    finally:
        spark.conf.set(static, before)
        if known:
            spark.conf.set(adaptive, known)
        else:
            spark.conf.unset(adaptive)


@contextlib.contextmanager
def passing(spark: SparkSession):
    """What is stored within goes to one folder, which is removed at the end: results have to be stored by then elsewhere."""
    path = scratch(spark)
    token = _folder.set(path)
    try:
        yield
    finally:
        _folder.reset(token)
        removed(spark, path)


def stored(df: DataFrame, lasting: bool = False, by: str | None = None, rows: int = 0) -> DataFrame:
    """`df` written and read again, for tables that several later steps read: they don't compute it anew. `lasting`: not
    among the tables that passing() removes. by: a column whose values have a folder each, so that who wants one of them
    reads no others. rows: the most that a file holds, where a row is much work for who reads it."""
    folder = None if lasting else _folder.get()
    path = f"{folder}/{uuid.uuid4().hex}" if folder else scratch(df.sparkSession)
    writer = df.write.option("maxRecordsPerFile", rows)
    with measured_joins(df.sparkSession):
        (writer.partitionBy(by) if by else writer).parquet(path)
    tidied(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)
