"""Lloyd's k-means over a bounded sample, and the assignment of all rows to their nearest centroid."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...functions import distance, vectors
from .. import sampling

SEED = 2026
UNIFORM, PLUS_PLUS, FIRST = "uniform", "kmeans++", "first"
RESEED, KEEP = "reseed", "keep"


def initial(rows: np.ndarray, count: int, how: str = UNIFORM, seed: int = SEED) -> np.ndarray:
    """Starting centroids: evenly spaced rows, the first rows in turn, or far ones drawn by squared distance."""
    n = len(rows)
    if how == UNIFORM:
        return rows[[c * n // count for c in range(count)]].copy()
    if how == FIRST:
        return rows[[c % n for c in range(count)]].copy()
    if how != PLUS_PLUS:
        raise ValueError(f"unknown initialisation: {how}")
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(n))]
    near = distance.l2_block(rows, rows[chosen])[:, 0]
    for c in range(1, count):
        mass = near.sum()
        pick = int(np.searchsorted(np.cumsum(near), rng.random() * mass)) if mass > 0 else c % n
        chosen.append(min(pick, n - 1))
        near = np.minimum(near, distance.l2_block(rows, rows[chosen[-1:]])[:, 0])
    return rows[chosen].copy()


def nearest(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row; of equal ones the first."""
    out = np.empty(len(rows), np.int64)
    step = max(1, (1 << 21) // max(1, len(centroids)))
    for at in range(0, len(rows), step):
        out[at : at + step] = distance.l2_block(rows[at : at + step], centroids).argmin(1)
    return out


def lloyd(rows: np.ndarray, count: int, iters: int, how: str = UNIFORM, empty: str = RESEED, seed: int = SEED) -> np.ndarray:
    """Centroids after ``iters`` rounds. An empty cluster takes row (c + iteration + 1) of the sample, or keeps its place."""
    if not len(rows):
        raise ValueError("k-means needs rows to train on")
    centroids = initial(rows, count, how, seed)
    for it in range(iters):
        of = nearest(rows, centroids)
        for c in range(count):
            own = rows[of == c]
            if len(own):
                centroids[c] = sampling.fixed_mean(own)
            elif empty == RESEED:
                centroids[c] = rows[(c + it + 1) % len(rows)]
    return centroids


def assign(base: DataFrame, centroids: np.ndarray, name: str = "list_id") -> DataFrame:
    """``base`` with the number of each row's nearest centroid; centroids are broadcast (lists times dimensions)."""
    held = base.sparkSession.sparkContext.broadcast(centroids)
    out = T.StructType([*base.schema.fields, T.StructField(name, T.IntegerType())])
    at = base.columns.index("vec")

    def run(batches):
        for batch in batches:
            of = nearest(vectors.matrix(batch.column(at)), held.value).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of)], names=[*batch.schema.names, name])

    return base.mapInArrow(run, out)


def list_sizes(assigned: DataFrame, lists: int) -> DataFrame:
    """(list_id, rows) of every list, empty ones included."""
    every = assigned.sparkSession.range(lists).select(F.col("id").cast("int").alias("list_id"))
    return every.join(assigned.groupBy("list_id").agg(F.count(F.lit(1)).alias("rows")), "list_id", "left").fillna(0, ["rows"])


def list_stats(assigned: DataFrame, lists: int) -> DataFrame:
    """One row: lists, the least, largest and mean size, and how many are empty."""
    return list_sizes(assigned, lists).agg(
        F.count(F.lit(1)).alias("lists"),
        F.min("rows").alias("min_rows"),
        F.max("rows").alias("max_rows"),
        F.round(F.avg("rows"), 6).alias("avg_rows"),
        F.sum((F.col("rows") == 0).cast("long")).alias("empty_lists"),
    )


def centroid_table(spark, centroids: np.ndarray) -> DataFrame:
    """(list_id, centroid) as a DataFrame."""
    return spark.createDataFrame(pa.table({"list_id": pa.array(np.arange(len(centroids), dtype=np.int32)), "centroid": vectors.listed(centroids, pa.float64())}))
