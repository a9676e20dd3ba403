"""Exact search: all base rows against a stated query set, in blocks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distance, vectors
from . import topk
from .queries import QueryBlock, over_blocks


#: Said where fewer rows were found than were asked for.
TOO_FEW = "fewer than k rows were found for a query; search more widely, or ask for fewer"


def _scan(base: DataFrame, block: QueryBlock, k: int, which: distance.Metric, exclude_self: bool) -> DataFrame:
    held = base.sparkSession.sparkContext.broadcast((block.qids, block.vecs))

    def start():
        qids, qvecs = held.value

        def score(batch):
            dist = which.block(vectors.matrix(batch.column(1)), qvecs)
            if not exclude_self:
                yield range(len(qids)), None, dist
                return
            # Rows that are queries themselves (ids are sorted in a block) against all but themselves, the others together.
            ids = batch.column(0).to_numpy()
            at = np.minimum(np.searchsorted(qids, ids), max(len(qids) - 1, 0))
            own = qids[at] == ids if len(qids) else np.zeros(len(ids), bool)
            yield range(len(qids)), np.flatnonzero(~own), dist[~own]
            for row in np.flatnonzero(own):
                others = np.flatnonzero(qids != ids[row])
                yield others, np.array([row]), dist[row : row + 1, others]

        return score

    return topk.scan(base.select(F.col("id").cast("long").alias("id"), "vec"), block.qids, k, start)


def by_block(queries: DataFrame, search: Callable[[QueryBlock], DataFrame]) -> DataFrame:
    """The rows of a search over each block of a query set."""
    return over_blocks(queries, search)


def knn(base: DataFrame, queries: DataFrame, k: int, metric: str = "ip", where: Column | str | None = None, exclude_self: bool = False) -> DataFrame:
    """(qid, rank, id, dist): the k base rows nearest to each query, by (dist, id).

    ``where`` filters base rows before they are searched. A base of fewer than k rows gives all of them.
    """
    which = distance.metric(metric)
    own = base if where is None else base.where(where)
    return by_block(queries, lambda b: topk.merged(_scan(own, b, k, which, exclude_self), k))


def knn_local(base: DataFrame, queries: DataFrame, k: int, shard: Column, local_p: int, metric: str = "ip") -> DataFrame:
    """``knn`` by shards: each keeps its ``local_p`` nearest, of which the k nearest stay. Exact if local_p >= k."""
    which = distance.metric(metric)
    own = base.select(F.col("id").cast("long").alias("id"), "vec", shard.cast("int").alias("shard"))

    def search(block: QueryBlock) -> DataFrame:
        held = base.sparkSession.sparkContext.broadcast(block.vecs)

        def start():
            vecs = held.value

            def score(batch):
                dist, of = which.block(vectors.matrix(batch.column(1)), vecs), batch.column(2).to_numpy()
                for s in np.unique(of):
                    at = np.flatnonzero(of == s)
                    yield int(s), range(len(vecs)), at, dist[at]

            return score

        found = topk.scan_groups(own, block.qids, local_p, start)
        return topk.merged(topk.ranked(found, local_p, ("shard", "qid"), "local_rank"), k)

    return by_block(queries, search)


def within(base: DataFrame, queries: DataFrame, epsilon: float, metric: str = "l2", most: int | None = None, least: int = 0) -> DataFrame:
    """(qid, rank, id, dist): all rows within ``epsilon``; with ``most`` the nearest of these, and at least ``least`` rows
    even if they lie beyond."""
    which = distance.metric(metric)

    def search(block: QueryBlock) -> DataFrame:
        held = base.sparkSession.sparkContext.broadcast((block.qids, block.vecs))

        def run(batches):
            qids, qvecs = held.value
            for batch in batches:
                ids = batch.column(0).to_numpy()
                dist = np.round(which.block(vectors.matrix(batch.column(1)), qvecs), topk.DECIMALS) + 0.0
                rows, at = np.nonzero(dist <= epsilon)
                yield pa.RecordBatch.from_arrays([pa.array(qids[at]), pa.array(ids[rows]), pa.array(dist[rows, at])], names=["qid", "id", "dist"])

        own = base.select(F.col("id").cast("long").alias("id"), "vec")
        found = own.mapInArrow(run, topk.NEAREST)
        if least:
            found = found.unionByName(_scan(base, block, least, which, False)).distinct()
        w = Window.partitionBy("qid").orderBy("dist", "id")
        out = found.withColumn("rank", F.row_number().over(w)).where((F.col("dist") <= epsilon) | (F.col("rank") <= least))
        return (out if most is None else out.where(F.col("rank") <= most)).select("qid", "rank", "id", "dist")

    return by_block(queries, search)


def nearest_documents(base: DataFrame, queries: DataFrame, documents: int, metric: str = "l2") -> DataFrame:
    """(qid, rank, id, doc_id, dist): the nearest rows of each query, as long as they are of ``documents`` different
    ``doc_id``, all of a document's rows before the next new one included. Rows without a document are left out.

    A first pass keeps each document's nearest row, at most ``documents + 1`` of them by query and partition; the nearest row of
    one document more than is asked for is the bound. A second pass returns rows below it only: no more rows are ranked
    than are in the result.
    """
    which = distance.metric(metric)
    own = base.select(F.col("id").cast("long").alias("id"), "vec", F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL")
    schema = "qid long, id long, doc_id long, dist double"

    def rows_of(qids, ids, docs, dist, rows, at) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(qids[at]), pa.array(ids[rows]), pa.array(docs[rows]), pa.array(dist[rows, at])], names=["qid", "id", "doc_id", "dist"])

    def search(block: QueryBlock) -> DataFrame:
        context = base.sparkSession.sparkContext
        held = context.broadcast((block.qids, block.vecs))

        def distances(batch):
            return batch.column(0).to_numpy(), batch.column(2).to_numpy(), np.round(which.block(vectors.matrix(batch.column(1)), held.value[1]), topk.DECIMALS) + 0.0

        def firsts(batches):
            qids = held.value[0]
            best: list[tuple] = [(np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64)) for _ in qids]
            for batch in batches:
                ids, docs, dist = distances(batch)
                for j in range(len(qids)):
                    d, i, c = (np.concatenate(x) for x in zip(best[j], (dist[:, j], ids, docs)))
                    order = np.lexsort((i, d))
                    first = order[np.sort(np.unique(c[order], return_index=True)[1])][: documents + 1]
                    best[j] = (d[first], i[first], c[first])
            for q, (d, i, c) in zip(qids, best):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), q)), pa.array(i), pa.array(c), pa.array(d)], names=["qid", "id", "doc_id", "dist"])

        nearest = own.mapInArrow(firsts, schema).groupBy("qid", "doc_id").agg(F.min(F.struct("dist", "id")).alias("near"))
        after = F.row_number().over(Window.partitionBy("qid").orderBy("near"))
        edges = nearest.withColumn("after", after).where(F.col("after") == documents + 1).select("qid", "near.dist", "near.id").toArrow()  # a row for each query of the block
        edge_of = {q: (d, i) for q, d, i in zip(*(c.to_pylist() for c in edges.columns))}
        bound = context.broadcast((np.array([edge_of.get(int(q), (np.inf, 0))[0] for q in block.qids]), np.array([edge_of.get(int(q), (np.inf, 0))[1] for q in block.qids], np.int64)))

        def below(batches):
            qids, (edge, edge_id) = held.value[0], bound.value
            for batch in batches:
                ids, docs, dist = distances(batch)
                rows, at = np.nonzero((dist < edge) | ((dist == edge) & (ids[:, None] < edge_id[None, :])))
                yield rows_of(qids, ids, docs, dist, rows, at)

        found = own.mapInArrow(below, schema)
        rank = F.row_number().over(Window.partitionBy("qid").orderBy("dist", "id"))
        return found.withColumn("rank", rank).select("qid", "rank", "id", "doc_id", "dist")

    return by_block(queries, search)


def without(base: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Base rows that aren't marked as deleted in ``tombstones`` (id)."""
    return base.join(tombstones.select("id").distinct(), "id", "left_anti")


def upsert(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Base rows with those of ``changes`` in place of the ones with their ids. ``changes`` holds an id once."""
    return without(base, changes).unionByName(changes)


def items(base: DataFrame, labels: DataFrame, tombstones: DataFrame | None = None) -> DataFrame:
    """The rows of ``labels`` (id). A label that is missing, or deleted, raises ``KeyError``."""
    own = base if tombstones is None else without(base, tombstones)
    missing = labels.join(own, "id", "left_anti").select("id").take(1)
    if missing:
        raise KeyError(f"no row has the id {missing[0][0]}")
    return own.join(labels.select("id").distinct(), "id", "left_semi")


def exactly_k(found: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``found``, after a check that every query has k rows."""
    short = queries.select("qid").join(found.groupBy("qid").count(), "qid", "left").where(F.coalesce("count", F.lit(0)) < k).take(1)
    if short:
        raise RuntimeError(TOO_FEW)
    return found
