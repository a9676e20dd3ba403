"""Sources and sinks, and tables that outlive the executors that made them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_made: set[str] = set()
#: Whether Spark deletes an execution's shuffle files at its end, not only when the driver next collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder; on a cluster that would be another disk for each executor,
    so it raises ``RuntimeError``.
    """
    got = spark.conf.get("spark.checkpoint.dir", None)
    if got:
        return got.rstrip("/")
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="lodestar-shared-")
    return _own[context.applicationId]


def _file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path in it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _folder(spark: SparkSession) -> str:
    """The application's own folder in the shared one. It goes when the driver ends."""
    path = f"{shared_dir(spark)}/lodestar/{spark.sparkContext.applicationId}"
    if path not in _made:
        fs, where = _file_system(spark, path)
        fs.mkdirs(where)
        fs.deleteOnExit(where)
        _made.add(path)
    return path


def durable(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: made once, and kept if executors are lost.

    What follows no longer depends on the executors that made it: after a loss, tasks start from these files. They stay
    until ``release``, or the end of the application. What was shuffled to make it goes as soon as it is written.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/{uuid.uuid4().hex}"
    writer = df.write.mode("error")
    cleans = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, cleans)
    out = spark.read.schema(df.schema).parquet(path)
    if partition_by:
        out = out.select(*[out[f"`{c}`"] for c in df.columns])
    out.__dict__["_durable_path"] = path
    return out


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the application's folder, for files that aren't Parquet tables."""
    return f"{_folder(spark)}/{uuid.uuid4().hex}-{name}"


def release(*tables: DataFrame) -> None:
    """Deletes the files of tables that ``durable`` returned and that no later plan reads."""
    for df in tables:
        path = df.__dict__.pop("_durable_path", None)
        if path:
            fs, where = _file_system(df.sparkSession, path)
            fs.delete(where, True)
