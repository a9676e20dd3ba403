"""Bounded training samples, taken by position, and the means over them that don't depend on the order of rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors

#: Training rows, at most, unless the caller says otherwise.
TRAIN_SIZE = 10_000


def positions(n: int, size: int) -> list[int]:
    """The rows ``t * n // size`` for t below ``size``."""
    return [t * n // size for t in range(size)]


def training_ids(base: DataFrame, size: int) -> DataFrame:
    """(t, id): the sampled ids. Where ids are row positions (0 to n - 1), those of ``positions``; ids with gaps have no
    positions, and the ones with the lowest hashes are taken."""
    ids = base.select(F.col("id").cast("long").alias("id"))
    n, low, high = ids.agg(F.count(F.lit(1)), F.min("id"), F.max("id")).first()
    size = min(size, n)
    spark = base.sparkSession
    if size and low == 0 and high == n - 1:
        return spark.range(size).select(F.col("id").cast("int").alias("t"), F.expr(f"(id * {n}L) div {size}L").alias("id"))
    lowest = sorted(r[0] for r in ids.orderBy(F.xxhash64("id"), "id").limit(size).collect()) if size else []
    return spark.createDataFrame(list(enumerate(lowest)), "t int, id long")


def training(base: DataFrame, size: int = TRAIN_SIZE) -> np.ndarray:
    """The sampled vectors, in order of t: on the driver, ``size`` of them at most."""
    wanted = training_ids(base, size)
    rows = base.select(F.col("id").cast("long").alias("id"), "vec").join(F.broadcast(wanted), "id").orderBy("t").toArrow()
    if not rows.num_rows:
        return np.empty((0, 0))
    order = np.argsort(rows.column("t").to_numpy(), kind="stable")
    return vectors.matrix(rows.column("vec"))[order]


def fixed_mean(rows: np.ndarray) -> np.ndarray:
    """Means of rows over values fixed to nine decimals, so that the order of rows doesn't matter."""
    return np.floor(rows * 1e9 + 0.5).astype(np.int64).sum(0) / len(rows) / 1e9
