"""Inverted files: rows in lists by their nearest centroid, searched over each query's nearest lists only."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions import distance, vectors
from ...sources import durable
from .. import sampling, topk
from ..queries import QueryBlock, blocks, over_blocks
from . import kmeans


@dataclass(frozen=True)
class Params:
    lists: int = 100
    train_size: int = sampling.TRAIN_SIZE
    iters: int = 6
    init: str = kmeans.UNIFORM
    empty: str = kmeans.RESEED

    def fitted(self, rows: int) -> Params:
        """The same within what ``rows`` allow: as many lists and training rows as rows, at least one iteration."""
        if rows < 1:
            raise ValueError("an inverted file needs rows")
        lists = min(self.lists or 100, rows)
        return Params(lists, min(max(self.train_size, lists), rows), max(1, self.iters), self.init, self.empty)


@dataclass(frozen=True)
class Index:
    """Centroids (on the driver: lists times dimensions) and the rows with their list, as a table in folders by list."""

    centroids: np.ndarray
    rows: DataFrame

    def save(self, path: str) -> None:
        """Rows as Parquet in a folder for each list, centroids beside them."""
        self.rows.write.mode("overwrite").partitionBy("list_id").parquet(f"{path}/rows")
        kmeans.centroid_table(self.rows.sparkSession, self.centroids).write.mode("overwrite").parquet(f"{path}/centroids")


def load(spark, path: str) -> Index:
    got = spark.read.parquet(f"{path}/centroids").orderBy("list_id").toArrow()
    return Index(vectors.matrix(got.column("centroid")), spark.read.parquet(f"{path}/rows"))


def build(base: DataFrame, params: Params = Params()) -> Index:
    own = params.fitted(base.count())
    sample = sampling.training(base, own.train_size)
    centroids = kmeans.lloyd(sample, own.lists, own.iters, own.init, own.empty)
    return Index(centroids, by_lists(kmeans.assign(base, centroids)))


def by_lists(rows: DataFrame) -> DataFrame:
    """Rows with ``list_id``, written in a folder for each list: searches read those that are probed, and nothing is assigned or
    encoded again. A list is brought together in files of a size that suits the session, a crowded one in several."""
    return durable(rows.hint("rebalance", F.col("list_id")), ["list_id"])


def probe(block: QueryBlock, centroids: np.ndarray, probes: int, metric: str = "l2") -> np.ndarray:
    """(queries, probes): each query's nearest lists, of equal ones the first."""
    dist = np.round(distance.metric(metric).block(block.vecs, centroids), topk.DECIMALS)
    return np.argsort(dist, axis=1, kind="stable")[:, : max(1, min(probes, len(centroids)))]


def probes_table(queries: DataFrame, centroids: np.ndarray, probes: int, metric: str = "l2") -> DataFrame:
    """(qid, rank, list_id, dist) of each query's probed lists."""
    spark, out = queries.sparkSession, []
    for b in blocks(queries):
        lists = probe(b, centroids, probes, metric)
        dist = np.round(distance.metric(metric).block(b.vecs, centroids), topk.DECIMALS)
        out += [(int(q), r + 1, int(c), float(dist[i, c])) for i, q in enumerate(b.qids) for r, c in enumerate(lists[i])]
    return spark.createDataFrame(out, "qid long, rank int, list_id int, dist double")


def lists_of(block: QueryBlock, probes: DataFrame) -> list[np.ndarray]:
    """A caller's probes (qid, list_id) by query of a block; only the block's are read."""
    import pyarrow as pa

    got: dict[int, list[int]] = {}
    own = probes.sparkSession.createDataFrame(pa.table({"qid": pa.array(block.qids)}))
    for q, c in probes.select(F.col("qid").cast("long").alias("qid"), "list_id").join(F.broadcast(own), "qid", "left_semi").collect():
        got.setdefault(q, []).append(c)
    return [np.array(sorted(set(got.get(int(q), []))), np.int64) for q in block.qids]


def by_list(lists: list[np.ndarray]) -> dict[int, np.ndarray]:
    """The positions of the queries that probe each list."""
    out: dict[int, list[int]] = {}
    for q, own in enumerate(lists):
        for c in own:
            out.setdefault(int(c), []).append(q)
    return {c: np.array(q) for c, q in out.items()}


def pruned(rows: DataFrame, seekers: dict[int, np.ndarray]) -> DataFrame:
    """Only rows of lists that some query probes: whole folders are skipped where ``list_id`` is a partition column."""
    return rows.where(F.col("list_id").isin([int(c) for c in seekers]))


def scan_lists(index: Index, block: QueryBlock, lists: list[np.ndarray], k: int, metric: str = "ip") -> DataFrame:
    seekers = by_list(lists)
    which = distance.metric(metric)
    held = index.rows.sparkSession.sparkContext.broadcast((block.vecs, seekers))

    def start():
        vecs, of = held.value

        def score(batch):
            own = batch.column(2).to_numpy()
            rows = vectors.matrix(batch.column(1))
            for c in np.unique(own):
                if int(c) in of:
                    at = np.flatnonzero(own == c)
                    yield of[int(c)], at, which.block(rows[at], vecs[of[int(c)]])

        return score

    return topk.scan(pruned(index.rows, seekers).select(F.col("id").cast("long").alias("id"), "vec", "list_id"), block.qids, k, start)


def search(index: Index, queries: DataFrame, k: int, probes: int = 16, metric: str = "ip", given: DataFrame | None = None, local_p: int = 0) -> DataFrame:
    """(qid, rank, id, dist): the k nearest of the rows in the probed lists, or in the lists ``given`` (qid, list_id).

    Each partition passes ``local_p`` rows on (0: k); below k that loses rows.
    """

    def one(block: QueryBlock) -> DataFrame:
        lists = lists_of(block, given) if given is not None else list(probe(block, index.centroids, probes))
        return topk.merged(scan_lists(index, block, lists, local_p or k, metric), k)

    return over_blocks(queries, one)
