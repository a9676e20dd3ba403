"""Streams of changes to a vector table. Searches read the table as it stands; there is no other state.

A change is (id, vec, deleted, version). Each micro-batch is written as one more Parquet folder under ``changes``, named by its
batch number, so a batch that is written again after a failure replaces itself. ``current`` is the newest change of each id: of
equal versions that of the later batch, and within a batch that with the higher hash, so that every read agrees. ``compact``
writes what batches amount to as a snapshot; later reads take the newest snapshot and the batches after it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import _file_system

CHANGE = "id long, vec array<float>, deleted boolean, version long"


def follow(changes: DataFrame, path: str, checkpoint: str):
    """Starts a stream that keeps ``changes`` under ``path``; returns the query."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.select("id", "vec", "deleted", "version").write.mode("overwrite").parquet(f"{path}/changes/batch={number}")

    return changes.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).start()


def _numbers(spark: SparkSession, path: str, name: str) -> list[int]:
    """The numbers of finished folders ``name=<number>`` below a path."""
    fs, where = _file_system(spark, path)
    if not fs.exists(where):
        return []
    done = [s.getPath() for s in fs.listStatus(where)]
    done = [p.getName() for p in done if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(m[1]) for m in (re.match(rf"{name}=([0-9]+)\Z", n) for n in done) if m)


def _newest(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(id, vec, deleted, version, batch) of the newest change of each id, and the last batch that counts."""
    snapshots, batches = _numbers(spark, f"{path}/snapshots", "upto"), _numbers(spark, f"{path}/changes", "batch")
    rows = spark.createDataFrame([], CHANGE + ", batch long")
    if snapshots:
        rows = rows.unionByName(spark.read.schema(CHANGE + ", batch long").parquet(f"{path}/snapshots/upto={snapshots[-1]}"))
    later = [b for b in batches if not snapshots or b > snapshots[-1]]
    if later:
        read = spark.read.schema(CHANGE + ", batch long").option("basePath", f"{path}/changes")
        rows = rows.unionByName(read.parquet(*[f"{path}/changes/batch={b}" for b in later]))
    own = F.struct("version", "batch", F.xxhash64("vec", "deleted").alias("tie"), "vec", "deleted")
    last = rows.groupBy("id").agg(F.max_by(own, F.struct("version", "batch", F.xxhash64("vec", "deleted"))).alias("last"))
    return last.select("id", "last.vec", "last.deleted", "last.version", "last.batch"), max([*snapshots, *batches], default=-1)


def compact(spark: SparkSession, path: str) -> int:
    """Writes the state after the last finished batch as a snapshot, removes what it replaces, and returns the batch's number."""
    rows, upto = _newest(spark, path)
    snapshots = _numbers(spark, f"{path}/snapshots", "upto")
    if upto < 0 or (snapshots and snapshots[-1] == upto):
        return upto
    rows.write.mode("overwrite").parquet(f"{path}/snapshots/upto={upto}")
    old = [f"{path}/snapshots/upto={n}" for n in snapshots] + [f"{path}/changes/batch={n}" for n in _numbers(spark, f"{path}/changes", "batch") if n <= upto]
    for folder in old:
        fs, where = _file_system(spark, folder)
        fs.delete(where, True)
    return upto


def current(spark: SparkSession, path: str, base: DataFrame | None = None) -> DataFrame:
    """(id, vec): the newest vector of each id that isn't deleted. ``base`` (id, vec) holds what was there before."""
    rows, _ = _newest(spark, path)
    if base is not None:
        old = base.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<float>").alias("vec"))
        rows = rows.select("id", "vec", "deleted").unionByName(old.join(rows.select("id"), "id", "left_anti").withColumn("deleted", F.lit(False)))
    return rows.where(~F.col("deleted")).select("id", "vec")
