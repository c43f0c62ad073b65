"""Scratch tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: set[str] = set()


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _forget(spark: SparkSession, path: str) -> None:
    """At the end of the process; a folder that can't be reached any more stays."""
    try:
        _delete(spark, path)
    except Exception:  # noqa: S110
        pass


def folder(spark: SparkSession) -> str:
    """This application's folder under ``spark.checkpoint.dir``; it is removed when the process ends.

    Where a session has no such setting, a local master gets a folder of this
    machine. On a cluster that is an error: executors don't share their disks.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        made = tempfile.mkdtemp(prefix="corvane-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        root = "file://" + made
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/corvane-{spark.sparkContext.applicationId}"
    if path not in _made:
        _made.add(path)
        atexit.register(_forget, spark, path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back: rows are computed once, lineage is cut, lost executors don't matter."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(df: DataFrame) -> None:
    """Deletes the table of a staged ``df`` that nothing will read again; other DataFrames are left alone."""
    if path := getattr(df, "_scratch", None):
        _delete(df.sparkSession, path)


def balanced(rows: DataFrame) -> DataFrame:
    """``rows`` of a scan, dealt out to all cores where the files give fewer tasks than there are cores; other plans stay.

    For work per row that costs more than moving the row. Large inputs have more tasks than cores and are left alone.
    """
    if rows.isStreaming:
        return rows
    cores, plan = rows.sparkSession.sparkContext.defaultParallelism, rows._jdf.queryExecution()
    if "Exchange" in plan.executedPlan().toString() or plan.toRdd().getNumPartitions() >= cores:
        return rows
    return rows.repartition(cores)
