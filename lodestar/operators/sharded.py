"""Shards: who owns a list or a row, search by shard with local top-p, and routing to the nearest shards."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sampling, topk
from .ivf import index as ivf
from .ivf import kmeans
from .queries import QueryBlock, over_blocks

BLOCK, CYCLIC, RANDOM = "block", "cyclic", "random"


def owner(list_id: Column, lists: int, shards: int, how: str = CYCLIC) -> Column:
    """The shard of a list: in turn, or in even runs of which the first ``lists % shards`` are one longer."""
    if shards < 1:
        raise ValueError("there must be a shard at least")
    if how == CYCLIC:
        return F.pmod(list_id, F.lit(shards)).cast("int")
    if how != BLOCK:
        raise ValueError(f"unknown split: {how}")
    small, longer = divmod(lists, shards)
    edge = longer * (small + 1)
    return F.when(list_id < edge, F.floor(list_id / (small + 1))).otherwise(longer + F.floor((list_id - edge) / max(small, 1))).cast("int")


def random_shard(id_col: Column, shards: int, seed: int = kmeans.SEED) -> Column:
    """A shard for each row by a seeded hash: even in expectation, and the same in every run."""
    return F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(shards)).cast("int")


def kmeans_shards(base: DataFrame, shards: int, train_size: int = sampling.TRAIN_SIZE, iters: int = 6) -> tuple[DataFrame, np.ndarray]:
    """(``base`` with ``shard``, centres): shards round centres that start at the first sampled rows; empty ones stay."""
    sample = sampling.training(base, train_size)
    centres = kmeans.lloyd(sample, shards, iters, kmeans.FIRST, kmeans.KEEP)
    return kmeans.assign(base, centres, "shard"), centres


def routed_flat(base: DataFrame, queries: DataFrame, k: int, shards: int, route: int, train_size: int, iters: int) -> DataFrame:
    """Exact search within the ``route`` shards whose centres have the largest inner product with the query."""
    rows, centres = kmeans_shards(base, shards, train_size, iters)
    index = ivf.Index(centres, rows.withColumnRenamed("shard", "list_id"))

    def one(block: QueryBlock) -> DataFrame:
        return topk.merged(ivf.scan_lists(index, block, list(ivf.probe(block, centres, route, "ip")), k), k)

    return over_blocks(queries, one)


def shard_profile(rows: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(shard, rows, share) and, from results that carry their shard, how many each shard returned."""
    sizes = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"))
    total = max(1, rows.count())
    out = sizes.select("shard", "rows", F.round(F.col("rows") / total, 6).alias("share"))
    return out if found is None else out.join(found.groupBy("shard").agg(F.count(F.lit(1)).alias("returned")), "shard", "left").fillna(0, ["returned"])
