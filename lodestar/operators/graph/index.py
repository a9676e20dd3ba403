"""Proximity graphs as DataFrames: a row for each shard's graph.

``GraphIndex.packed`` has a row for each shard: its number, its graph as one serialized table, and the labels and deletion marks
of its nodes. A search maps over these rows, so nothing is shuffled but what it finds. ``GraphIndex.nodes`` shows the graphs as a
row for each node: shard, node, label, deleted, vec, links (by level), entry.

A shard is built, searched or changed in one task, so shards must be small (``SHARD_ROWS`` by default); more rows make more
shards, and every query visits each shard, or those it is routed to. Results of shards are merged in one exchange by query.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ...functions import vectors
from ...sources import durable
from .. import sampling, topk
from ..ivf import index as ivf
from ..ivf import kmeans
from ..queries import QueryBlock, over_blocks
from ..sharded import random_shard
from . import layout
from .core import Condition, Counts, Graph, Params, Within

SHARD_ROWS = 20_000
#: A beam as wide as any shard: a search finds every node.
EVERY = 1 << 30
PACKED = "shard int, graph binary, labels array<bigint>, deleted array<boolean>"
NODES = "shard int, node int, label long, deleted boolean, vec array<double>, links array<array<int>>, entry boolean"
FOUND = "shard int, qid long, id long, dist double, hops long, distances long"
WALKS = "shard int, node int, place int, count long"


def to_table(shard: int, graph: Graph) -> pa.Table:
    n = len(graph)
    return pa.table(
        {
            "shard": pa.array(np.full(n, shard, np.int32)),
            "node": pa.array(np.arange(n, dtype=np.int32)),
            "label": pa.array(graph.labels, pa.int64()),
            "deleted": pa.array(graph.deleted, pa.bool_()),
            "vec": vectors.listed(graph.vecs[:n], pa.float64()),
            "links": pa.array(graph.links, pa.list_(pa.list_(pa.int32()))),
            "entry": pa.array([i == graph.entry for i in range(n)], pa.bool_()),
        }
    )


def from_table(table: pa.Table, params: Params) -> Graph:
    table = table.take(pa.array(np.argsort(table.column("node").to_numpy(), kind="stable")))
    vecs = vectors.matrix(table.column("vec"))
    graph = Graph(params, vecs.shape[1] if len(vecs) else 0, vecs.copy())
    graph.labels, graph.deleted = table.column("label").to_pylist(), table.column("deleted").to_pylist()
    graph.links = table.column("links").to_pylist()
    entries = np.flatnonzero(table.column("entry").to_numpy(zero_copy_only=False))
    graph.entry = int(entries[0]) if len(entries) else -1
    graph._rng = np.random.default_rng(graph.params.seed + len(graph.labels))
    return graph


def pack(shard: int, graph: Graph) -> pa.RecordBatch:
    """One row of ``PACKED``."""
    table, sink = to_table(shard, graph), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    columns = [pa.array([shard], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([graph.labels], pa.list_(pa.int64())), pa.array([graph.deleted], pa.list_(pa.bool_()))]
    return pa.RecordBatch.from_arrays(columns, names=["shard", "graph", "labels", "deleted"])


def unpack(graph: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(graph)).read_all()


def _placed(packed: DataFrame, shards: int) -> DataFrame:
    """Written with a file for each shard, so that each can be a task of its own."""
    return durable(packed.repartitionById(max(1, shards), F.col("shard")))


@dataclass(frozen=True)
class GraphIndex:
    packed: DataFrame
    params: Params
    shards: int
    #: Shards of each group that queries are routed to, if a group may have several.
    groups: tuple[tuple[int, ...], ...] | None = None

    @property
    def nodes(self) -> DataFrame:
        def run(batches):
            for batch in batches:
                for graph in batch.column(0):
                    yield from unpack(graph.as_py()).to_batches(max_chunksize=4096)

        return self.packed.select("graph").mapInArrow(run, NODES)

    @property
    def labels(self) -> DataFrame:
        """(shard, node, label, deleted), without reading the graphs."""
        rows = self.packed.select("shard", F.posexplode(F.arrays_zip("labels", "deleted")).alias("node", "row"))
        return rows.select("shard", "node", F.col("row.labels").alias("label"), F.col("row.deleted").alias("deleted"))

    def with_ef(self, ef: int) -> GraphIndex:
        return replace(self, params=replace(self.params, ef=ef))

    def save(self, path: str) -> None:
        p = self.params
        self.packed.write.mode("overwrite").parquet(f"{path}/graphs")
        groups = [list(g) for g in self.groups] if self.groups else None
        meta = [(self.shards, p.m, p.ef_construction, p.ef, p.seed, p.metric, groups)]
        self.packed.sparkSession.createDataFrame(meta, "shards int, m int, ef_construction int, ef int, seed int, metric string, groups array<array<int>>").write.mode("overwrite").parquet(f"{path}/meta")


def load(spark, path: str) -> GraphIndex:
    """A saved index, with the ``ef`` that it had."""
    shards, m, efc, ef, seed, metric, groups = spark.read.parquet(f"{path}/meta").first()
    packed = spark.read.schema(PACKED).parquet(f"{path}/graphs")
    return GraphIndex(packed, Params(m, efc, ef, seed, metric), shards, tuple(map(tuple, groups)) if groups else None)


def of_nodes(nodes: DataFrame, params: Params, shards: int) -> GraphIndex:
    """An index from a row for each node."""

    def run(key, group):
        return pa.Table.from_batches([pack(key[0].as_py(), from_table(group, params))])

    return GraphIndex(_placed(nodes.groupBy("shard").applyInArrow(run, PACKED), shards), params, shards)


def shards_for(rows: int) -> int:
    return max(1, -(-rows // SHARD_ROWS))


def build(base: DataFrame, params: Params = Params(), shards: int | None = None, shard: Column | None = None) -> GraphIndex:
    """A graph for each shard, rows inserted by id. ``shard`` names each row's shard; by default a seeded hash."""
    n, d = vectors.dimension(base)
    shards = shards or shards_for(n)
    rows = base.select((shard if shard is not None else random_shard(F.col("id"), shards)).cast("int").alias("shard"), F.col("id").cast("long").alias("id"), "vec")

    def grow(key, group):
        number = key[0].as_py()
        graph = Graph(replace(params, seed=params.seed + number), d)
        ids, vecs = group.column("id").to_numpy(), vectors.matrix(group.column("vec"))
        graph.reserve(len(ids))
        for at in np.argsort(ids, kind="stable"):
            graph.add(int(ids[at]), vecs[at])
        return pa.Table.from_batches([pack(number, graph)])

    return GraphIndex(_placed(rows.groupBy("shard").applyInArrow(grow, PACKED), shards), params, shards)


def _by_shard(index: GraphIndex, work: Callable, schema: str, packed: DataFrame | None = None) -> DataFrame:
    """``work(shard, graph, more)`` for each shard, as a DataFrame without a shuffle. ``packed`` may have a further column, whose
    value for the shard is ``more``."""
    params = index.params
    rows = (packed if packed is not None else index.packed.withColumn("more", F.lit(None).cast("int"))).select("shard", "graph", F.col("more").alias("more"))

    def run(batches):
        for batch in batches:
            for shard, graph, more in zip(*batch.columns):
                out = work(shard.as_py(), from_table(unpack(graph.as_py()), params), more.as_py())
                yield from (out.to_batches(max_chunksize=1 << 16) if isinstance(out, pa.Table) else [out])

    return rows.mapInArrow(run, schema)


def _of_labels(index: GraphIndex, value: Column) -> DataFrame:
    """The packed rows with a column ``more``: the values of an expression over ``label``, in order of the nodes."""
    lists = index.labels.select("shard", F.struct("node", value.alias("value")).alias("own")).groupBy("shard").agg(F.transform(F.sort_array(F.collect_list("own")), lambda x: x["value"]).alias("more"))
    return index.packed.join(lists, "shard")


def _table(rows: list[tuple], kinds: dict) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[]] * len(kinds)
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds.values())], names=list(kinds))


_FOUND = {"shard": pa.int32(), "qid": pa.int64(), "id": pa.int64(), "dist": pa.float64(), "hops": pa.int64(), "distances": pa.int64()}


def scan(index: GraphIndex, block: QueryBlock, k: int, ef: int = 0, allowed: Column | None = None, visit: dict[int, np.ndarray] | None = None, settled: bool = False) -> DataFrame:
    """FOUND: each shard's k nearest to each query that visits it (all, unless ``visit`` says which)."""
    held = index.packed.sparkSession.sparkContext.broadcast((block.qids, block.vecs, visit))
    packed = _of_labels(index, F.coalesce(allowed, F.lit(False))) if allowed is not None else index.packed.withColumn("more", F.lit(None).cast("int"))
    if visit is not None:
        packed = packed.where(F.col("shard").isin([int(s) for s in visit]))

    def work(shard, graph, more):
        qids, qvecs, of = held.value
        ok = None if more is None or all(more) else np.array(more, bool)
        out: list[tuple] = []
        for q in range(len(qids)) if of is None else of.get(shard, []):
            counts = Counts()
            for far, i in graph.search(qvecs[q], k, ef, ok, counts, settled):
                out.append((shard, int(qids[q]), graph.labels[i], round(far, topk.DECIMALS) + 0.0, counts.hops, counts.distances))
        return _table(out, _FOUND)

    return _by_shard(index, work, FOUND, packed)


def search(index: GraphIndex, queries: DataFrame, k: int, ef: int = 0, where: Column | None = None, local_p: int | None = None, settled: bool = False) -> DataFrame:
    """(qid, rank, id, dist): the k nearest over all shards; each shard passes on ``local_p`` (k at least). ``where`` is a
    predicate on ``label``: other nodes are walked through only. With ``settled``, a shard's beam is doubled until what it
    passes on stays the same."""
    own = max(k, local_p or k)
    return over_blocks(queries, lambda b: topk.merged(scan(index, b, own, ef, where, settled=settled), k))


def search_routed(index: GraphIndex, queries: DataFrame, k: int, visit: Callable[[QueryBlock], list[np.ndarray]], ef: int = 0, local_p: int | None = None) -> DataFrame:
    """As ``search``, over the shards that ``visit`` gives for each query of a block: groups of shards if the index has them."""
    own, groups = max(k, local_p or k), index.groups

    def one(block: QueryBlock) -> DataFrame:
        chosen = visit(block)
        if groups:
            chosen = [np.array([s for g in lists for s in groups[int(g)]], np.int64) for lists in chosen]
        return topk.merged(scan(index, block, own, ef, visit=ivf.by_list(chosen)), k)

    return over_blocks(queries, one)


def search_until(index: GraphIndex, queries: DataFrame, condition: Condition, ef: int = 0) -> DataFrame:
    """(shard, qid, id, dist): what a condition of the caller's keeps in each shard; the caller ranks them over all shards."""
    kinds = {"shard": pa.int32(), "qid": pa.int64(), "id": pa.int64(), "dist": pa.float64()}

    def one(block: QueryBlock) -> DataFrame:
        held = index.packed.sparkSession.sparkContext.broadcast((block.qids, block.vecs))

        def work(shard, graph, more):
            return _table([(shard, int(q), graph.labels[i], round(far, topk.DECIMALS) + 0.0) for q, v in zip(*held.value) for far, i in graph.search_until(v, condition, ef)], kinds)

        return _by_shard(index, work, "shard int, qid long, id long, dist double")

    return over_blocks(queries, one)


def search_within(index: GraphIndex, queries: DataFrame, epsilon: float, most: int, least: int = 0, ef: int = 0) -> DataFrame:
    """(qid, rank, id, dist) of nodes within ``epsilon``, the ``most`` nearest of them at most; the ``least`` nearest even beyond."""
    found = topk.merged(search_until(index, queries, Within(epsilon, most, least), ef), most)
    return found.where((F.col("dist") <= epsilon) | (F.col("rank") <= least))


def search_documents(index: GraphIndex, queries: DataFrame, documents: int, doc_of: Column, ef: int = 0) -> DataFrame:
    """(qid, rank, id, doc_id, dist): the nearest nodes, as long as they are of ``documents`` different documents. ``doc_of`` gives a
    document's number from ``label``. What all shards together return holds what one graph would."""
    packed = _of_labels(index, doc_of.cast("long"))
    kinds = {"qid": pa.int64(), "id": pa.int64(), "doc_id": pa.int64(), "dist": pa.float64()}

    def one(block: QueryBlock) -> DataFrame:
        held = index.packed.sparkSession.sparkContext.broadcast((block.qids, block.vecs))

        def work(shard, graph, docs):
            return _table([(int(q), graph.labels[i], docs[i], round(far, topk.DECIMALS) + 0.0) for q, v in zip(*held.value) for far, i in graph.search_documents(v, documents, docs, ef)], kinds)

        found = _by_shard(index, work, "qid long, id long, doc_id long, dist double", packed)
        nearest = found.groupBy("qid", "doc_id").agg(F.min(F.struct("dist", "id")).alias("near"))
        after = F.row_number().over(Window.partitionBy("qid").orderBy("near"))
        edge = nearest.withColumn("after", after).where(F.col("after") == documents + 1).select("qid", F.col("near").alias("edge"))
        below = found.join(edge, "qid", "left").where(F.col("edge").isNull() | (F.struct("dist", "id") < F.col("edge")))
        return topk.ranked(below, 1 << 30).select("qid", "rank", "id", "doc_id", "dist")

    return over_blocks(queries, one)


def statistics(index: GraphIndex, queries: DataFrame, k: int, ef: int = 0) -> DataFrame:
    """(qid, hops, distances): what a search does for each query, over all shards."""
    found = over_blocks(queries, lambda b: scan(index, b, k, ef).groupBy("shard", "qid").agg(F.max("hops").alias("hops"), F.max("distances").alias("distances")))
    return found.groupBy("qid").agg(F.sum("hops").alias("hops"), F.sum("distances").alias("distances"))


def walks(index: GraphIndex, queries: DataFrame, k: int, ef: int = 0) -> DataFrame:
    """WALKS: how often searches walk each link of level 0."""

    def one(block: QueryBlock) -> DataFrame:
        held = index.packed.sparkSession.sparkContext.broadcast(block.vecs)

        def work(shard, graph, more):
            counts = Counts(edges={})
            for v in held.value:
                graph.search(v, k, ef, None, counts)
            return _table([(shard, a, b, c) for (a, b), c in sorted(counts.edges.items())], {"shard": pa.int32(), "node": pa.int32(), "place": pa.int32(), "count": pa.int64()})

        return _by_shard(index, work, WALKS)

    return over_blocks(queries, one).groupBy("shard", "node", "place").agg(F.sum("count").alias("count"))


def reordered(index: GraphIndex, how: str, window: int = 5, profile: DataFrame | None = None) -> GraphIndex:
    """The same graphs with their nodes in another order. ``profile`` (WALKS) is needed for porder."""
    packed = index.packed.withColumn("more", F.lit(None).cast("array<struct<node: int, place: int, count: bigint>>"))
    if profile is not None:  # a shard's links are bounded by its rows
        packed = index.packed.join(profile.groupBy("shard").agg(F.collect_list(F.struct("node", "place", "count")).alias("more")), "shard", "left")

    def work(shard, graph, more):
        walked = {(x["node"], x["place"]): x["count"] for x in more or []}
        return pack(shard, graph.permuted(layout.order(graph, how, window, walked if how == layout.PORDER else None)))

    return replace(index, packed=_placed(_by_shard(index, work, PACKED, packed), index.shards))


def window_scores(index: GraphIndex, window: int = 5) -> DataFrame:
    """(shard, score): links between nodes at most ``window`` places apart."""

    def work(shard, graph, more):
        return pa.table({"shard": pa.array([shard], pa.int32()), "score": pa.array([layout.window_score(graph, window)], pa.int64())})

    return _by_shard(index, work, "shard int, score long")


def faults(index: GraphIndex) -> DataFrame:
    """(shard, fault): no rows if all links are sound."""

    def work(shard, graph, more):
        return _table([(shard, f) for f in graph.faults()], {"shard": pa.int32(), "fault": pa.string()})

    return _by_shard(index, work, "shard int, fault string")


def levels(index: GraphIndex) -> DataFrame:
    """(level, nodes): how many nodes end on each level."""
    return index.nodes.groupBy((F.size("links") - 1).alias("level")).agg(F.count(F.lit(1)).alias("nodes"))


def _known(index: GraphIndex, labels: DataFrame, deleted: bool) -> None:
    state = labels.select(F.col("id").cast("long").alias("label")).join(index.labels.select("label", "deleted"), "label", "left")
    wrong = state.where(F.col("deleted").isNull() | (F.col("deleted") != deleted)).take(1)
    if wrong:
        raise KeyError(f"no node is labelled {wrong[0][0]}" if wrong[0][1] is None else f"node {wrong[0][0]} is {'' if wrong[0][1] else 'not '}marked as deleted")


def _flag(index: GraphIndex, labels: DataFrame, value: bool) -> GraphIndex:
    hit = labels.select(F.col("id").cast("long").alias("label")).distinct().join(index.labels, "label").groupBy("shard").agg(F.collect_set("node").alias("more"))

    def work(shard, graph, more):
        for i in more or []:
            graph.deleted[i] = value
        return pack(shard, graph)

    return replace(index, packed=_placed(_by_shard(index, work, PACKED, index.packed.join(hit, "shard", "left")), index.shards))


def mark_deleted(index: GraphIndex, labels: DataFrame) -> GraphIndex:
    """Labels (id) that searches return no more. An unknown label, or one that is deleted, raises ``KeyError``."""
    _known(index, labels, False)
    return _flag(index, labels, True)


def unmark_deleted(index: GraphIndex, labels: DataFrame) -> GraphIndex:
    _known(index, labels, True)
    return _flag(index, labels, False)


def items(index: GraphIndex, labels: DataFrame) -> DataFrame:
    """(id, vec) of labels (id); one that is unknown or deleted raises ``KeyError``."""
    wanted = labels.select(F.col("id").cast("long").alias("label"))
    missing = wanted.join(index.labels.where(~F.col("deleted")), "label", "left_anti").take(1)
    if missing:
        raise KeyError(f"no node is labelled {missing[0][0]}")
    return index.nodes.where(~F.col("deleted")).join(wanted.distinct(), "label", "left_semi").select(F.col("label").alias("id"), "vec")


def upsert(index: GraphIndex, changes: DataFrame, replace_deleted: bool = False) -> GraphIndex:
    """New rows (id, vec) added, known ones updated in their shard; with ``replace_deleted`` new rows take the places of
    deleted nodes first. Only shards with changes are grown again."""
    params, shards, d = index.params, index.shards, vectors.dimension(changes)[1]
    own = index.labels.select(F.col("shard").alias("at"), F.col("label").alias("id"))
    rows = changes.select(F.col("id").cast("long").alias("id"), "vec").join(own, "id", "left")
    rows = rows.select(F.coalesce("at", random_shard(F.col("id"), shards)).alias("shard"), "id", "vec")

    def work(key, old, new):
        number = key[0].as_py()
        if not new.num_rows:
            return old.select(["shard", "graph", "labels", "deleted"])
        graph = from_table(unpack(old.column("graph")[0].as_py()), params) if old.num_rows else Graph(replace(params, seed=params.seed + number), d)
        if graph.dim != d:
            raise ValueError(f"vectors of {graph.dim} numbers are expected")
        ids, vecs = new.column("id").to_numpy(), vectors.matrix(new.column("vec"))
        for at in np.argsort(ids, kind="stable"):
            (graph.replace if replace_deleted else graph.add)(int(ids[at]), vecs[at])
        return pa.Table.from_batches([pack(number, graph)])

    changed = index.packed.groupBy("shard").cogroup(rows.groupBy("shard")).applyInArrow(work, PACKED)
    return replace(index, packed=_placed(changed, shards))


# --- shards by neighbourhood -----------------------------------------------------------------------------------------


def build_kmeans(base: DataFrame, params: Params, shards: int, train_size: int = sampling.TRAIN_SIZE, iters: int = 6, most: int = SHARD_ROWS) -> tuple[GraphIndex, np.ndarray]:
    """Graphs for the k-means clusters (centres start at the first sampled rows; empty ones stay), and the centres.

    A cluster of over ``most`` rows is dealt by a hash over several graphs, all of which a query that is routed to it visits.
    """
    sample = sampling.training(base, train_size)
    centres = kmeans.lloyd(sample, shards, iters, kmeans.FIRST, kmeans.KEEP)
    rows = durable(kmeans.assign(base, centres, "cluster"))
    sizes = dict(rows.groupBy("cluster").count().collect())  # a row for each cluster
    parts = [max(1, -(-sizes.get(c, 0) // most)) for c in range(shards)]
    first = np.cumsum([0, *parts])
    dealt = F.element_at(F.array(*[F.lit(int(x)) for x in first[:-1]]), F.col("cluster") + 1) + F.pmod(F.xxhash64("id", F.lit(1)), F.element_at(F.array(*[F.lit(x) for x in parts]), F.col("cluster") + 1))
    index = build(rows, params, int(first[-1]), dealt)
    return replace(index, groups=tuple(tuple(range(int(a), int(b))) for a, b in zip(first, first[1:]))), centres


def nearest_lists(centres: np.ndarray, probes: int, metric: str = "l2") -> Callable[[QueryBlock], list[np.ndarray]]:
    """Routing to the ``probes`` nearest centres."""
    return lambda block: list(ivf.probe(block, centres, probes, metric))


def upper_graph(centres: np.ndarray, route: int, m: int = 8, ef_construction: int = 100, ef: int = 16) -> Callable[[QueryBlock], list[np.ndarray]]:
    """Routing by a small graph over the centres, by inner product."""
    graph = Graph(Params(m, ef_construction, ef, metric="ip"), centres.shape[1])
    for c, v in enumerate(centres):
        graph.add(c, v)

    def visit(block: QueryBlock) -> list[np.ndarray]:
        return [np.array(sorted(graph.labels[i] for _, i in graph.search(v, min(route, len(centres)), ef))) for v in block.vecs]

    return visit
