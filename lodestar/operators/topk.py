"""The k nearest for each query: kept in bounded buffers within a partition, then merged in one exchange."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Distances are ranked and returned at this many decimals, so that sums taken in another order rank alike.
DECIMALS = 6

#: Distances of a block of rows to all queries that are held at once, about.
BLOCK_CELLS = 1 << 22

NEAREST = "qid long, id long, dist double"


class Nearest:
    """Up to k (distance, id) for each of some queries, by distance, then id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        #: The distance that a row must not exceed to count, by query.
        self.worst = np.full(queries, np.inf)
        self.dist = [np.empty(0) for _ in range(queries)]
        self.ids = [np.empty(0, np.int64) for _ in range(queries)]

    def add(self, query: int, ids: np.ndarray, dist: np.ndarray) -> None:
        kept = self.dist[query]
        if len(kept) >= self.k:
            near = dist <= kept[-1]
            ids, dist = ids[near], dist[near]
        if not len(ids):
            return
        if len(dist) > 4 * self.k:
            edge = np.partition(dist, self.k - 1)[self.k - 1]
            ids, dist = ids[dist <= edge], dist[dist <= edge]
        d, i = np.concatenate([kept, dist]), np.concatenate([self.ids[query], ids])
        order = np.lexsort((i, d))[: self.k]
        self.dist[query], self.ids[query] = d[order], i[order]
        if len(order) == self.k:
            self.worst[query] = self.dist[query][-1]

    def add_block(self, queries: np.ndarray, ids: np.ndarray, dist: np.ndarray) -> None:
        """Rows against ``queries``. Most queries find nothing in a block once their buffers are full: one comparison of
        the whole block tells, and only the others' distances are rounded and sorted."""
        hit = np.flatnonzero((dist <= self.worst[queries] + 10.0**-DECIMALS).any(0))
        near = np.round(dist[:, hit].T, DECIMALS) + 0.0
        for at, query in enumerate(queries[hit]):
            self.add(query, ids, near[at])

    def batch(self, qids: np.ndarray) -> pa.RecordBatch:
        counts = [len(x) for x in self.ids]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(qids, counts)), pa.array(np.concatenate([*self.ids, np.empty(0, np.int64)])), pa.array(np.concatenate([*self.dist, np.empty(0)]))],
            names=["qid", "id", "dist"],
        )


def scan(df: DataFrame, qids: np.ndarray, k: int, start: Callable[[], Callable]) -> DataFrame:
    """(qid, id, dist): for each partition of ``df`` (id first), the k nearest rows to each query.

    ``start()`` runs once a partition and gives a function from a RecordBatch to (positions of queries, positions of rows
    or None, distances by row and query).
    """

    def grouped():
        score = start()
        return lambda part: ((0, *found) for found in score(part))

    return scan_groups(df, qids, k, grouped).drop("shard")


def scan_groups(df: DataFrame, qids: np.ndarray, k: int, start: Callable[[], Callable]) -> DataFrame:
    """(shard, qid, id, dist): as ``scan``, k rows for each shard and query of a partition, in one pass.

    What ``start()`` gives yields (shard, positions of queries, positions of rows or None, distances).
    """
    qids = np.asarray(qids, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near: dict[int, Nearest] = {}
        score = start()
        for batch in batches:
            step = max(64, BLOCK_CELLS // max(1, len(qids)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids = part.column(0).to_numpy()
                for shard, queries, rows, dist in score(part):
                    if shard not in near:
                        near[shard] = Nearest(len(qids), k)
                    near[shard].add_block(np.asarray(queries), ids if rows is None else ids[rows], dist)
        for shard, kept in near.items():
            got = kept.batch(qids)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(got.num_rows, shard, np.int32)), *got.columns], names=["shard", *got.schema.names])

    return df.mapInArrow(run, f"shard int, {NEAREST}")


def ranked(df: DataFrame, k: int, by: tuple[str, ...] = ("qid",), rank: str = "rank") -> DataFrame:
    """``df`` with the 1-based rank within ``by``, by (dist, id), up to ``k``."""
    w = Window.partitionBy(*by).orderBy("dist", "id")
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def merged(df: DataFrame, k: int) -> DataFrame:
    """(qid, rank, id, dist) from the nearest of partitions or shards."""
    return ranked(df, k).select("qid", "rank", "id", "dist")


def result_type() -> T.StructType:
    return T._parse_datatype_string("qid long, rank int, id long, dist double")
