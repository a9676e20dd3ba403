"""An experiment from files to a row of results: load and check, build, search, measure, append.

    python -m lodestar.plans.workflow --method ivf --data-dir data --nlist 64 --output results
    python -m lodestar.plans.workflow @files/experiment.conf
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import evaluate, exact, sharded
from ..operators.graph import index as graphs
from ..operators.graph import layout
from ..operators.graph.core import Params as GraphParams
from ..operators.ivf import index as ivf
from ..operators.ivf import pq_index
from ..operators.quant import pq, sq
from ..sources import matrix
from .config import Config, from_file, parse, usage

#: Shards of the distributed methods, in the place of processes.
SHARDS = 4


@dataclass(frozen=True)
class Dataset:
    base: DataFrame
    queries: DataFrame
    truth: DataFrame
    base_count: int
    query_count: int
    dimension: int
    truth_width: int


def checked(config: Config, base: DataFrame, queries: DataFrame, truth: DataFrame) -> Dataset:
    """The three tables, (id, vec), (qid, qvec) and (qid, gt), after the checks that an experiment needs."""
    n, d = vectors.dimension(base)
    q, dq = vectors.dimension(queries, "qvec")
    rows, width = truth.agg(F.count(F.lit(1)), F.min(F.size("gt"))).first()
    if d != dq:
        raise ValueError("base/query dimensions do not match")
    if rows < q:
        raise ValueError("ground truth has fewer rows than the query set")
    if config.k > (width or 0):
        raise ValueError("k exceeds the ground-truth width")
    count = min(q, config.queries)
    if config.hnsw_layout == "porder" and config.porder_profile_queries + config.warmup_queries >= count:
        raise ValueError("profile and warm-up queries must leave a query to evaluate")
    if config.evaluation_query_offset >= count:
        raise ValueError("evaluation-query-offset must be smaller than the loaded query count")
    return Dataset(base, queries.where(F.col("qid") < count), truth, n, count, d, width)


def load(spark: SparkSession, config: Config) -> Dataset:
    at = lambda name: f"{config.data_dir.rstrip('/')}/{name}"
    base = matrix.read(spark, at(config.base_file), "fbin")
    queries = matrix.read(spark, at(config.query_file), "fbin").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    truth = matrix.read(spark, at(config.ground_truth_file), "i32bin").select(F.col("id").alias("qid"), F.col("vec").alias("gt"))
    return checked(config, base, queries, truth)


def _lists(c: Config) -> ivf.Params:
    return ivf.Params(c.nlist, c.train_size, c.kmeans_iters)


def _codes(c: Config) -> pq.Params:
    return pq.Params(c.m, c.ks, c.train_size, c.kmeans_iters)


def _graph(c: Config, metric: str = "ip") -> GraphParams:
    return GraphParams(c.hnsw_m, c.ef_construction, c.ef_search, metric=metric)


def prepare(config: Config, data: Dataset):
    """Builds what the method needs and returns a function from queries to (qid, rank, id, dist)."""
    c, base, k, p = config, data.base, config.k, config.rerank_p
    if c.method in ("flat", "flat-scalar"):
        if c.parallel == "list":
            return lambda q: exact.knn_local(base, q, k, F.pmod(F.col("id"), F.lit(c.threads)), k)
        return lambda q: exact.knn(base, q, k)
    if c.method == "sq":
        return lambda q: sq.search(base, q, k, p)
    if c.method == "sq-int8":
        return lambda q: sq.search_signed(base, q, k, p)
    if c.method == "pq":
        index = pq.build(base, _codes(c))
        if c.parallel == "list":
            return lambda q: pq.search_local(index, q, k, p, c.local_p, c.threads)
        return lambda q: pq.search(index, q, k, p)
    if c.method == "ivf":
        index = ivf.build(base, _lists(c))
        return lambda q: ivf.search(index, q, k, c.nprobe)
    if c.method.startswith("ivfpq-"):
        build = pq_index.build_local if "local" in c.method else pq_index.build_global
        index = build(base, _lists(c), _codes(c), c.rotation_rounds)
        return lambda q: pq_index.search(index, q, k, c.nprobe, p)
    if c.method == "mpi-ivfpq":
        index = pq_index.build_local(base, _lists(c), _codes(c))
        shard = sharded.owner(F.col("list_id"), len(index.centroids), SHARDS, c.split)
        return lambda q: pq_index.search_shards(index, q, k, c.nprobe, p, c.local_p, shard)
    if c.method in ("hnsw", "mpi-random-hnsw"):
        index = graphs.build(base, _graph(c), SHARDS if c.method.startswith("mpi") else None)
        if c.hnsw_layout != layout.ORIGINAL:
            first = data.queries.where(F.col("qid") < c.porder_profile_queries)
            profile = graphs.walks(index, first, k) if c.hnsw_layout == layout.PORDER else None
            index = graphs.reordered(index, c.hnsw_layout, c.gorder_window, profile)
        return lambda q: graphs.search(index, q, k, local_p=c.local_p)
    shards = c.nlist if c.method == "mpi-ivf-hnsw" else SHARDS
    index, centres = graphs.build_kmeans(base, _graph(c), min(shards, data.base_count), c.train_size, c.kmeans_iters)
    if c.method == "mpi-kmeans-hnsw":
        return lambda q: graphs.search(index, q, k, local_p=c.local_p)
    if c.method == "mpi-ivf-hnsw":
        return lambda q: graphs.search_routed(index, q, k, graphs.nearest_lists(centres, c.nprobe), local_p=c.local_p)
    if c.hnsw_layout != layout.ORIGINAL:
        first = data.queries.where(F.col("qid") < c.porder_profile_queries)
        profile = graphs.walks(index, first, k) if c.hnsw_layout == layout.PORDER else None
        index = graphs.reordered(index, c.hnsw_layout, c.gorder_window, profile)
    return lambda q: graphs.search_routed(index, q, k, graphs.upper_graph(centres, c.route_p), local_p=c.local_p)


def evaluated(config: Config, data: Dataset) -> DataFrame:
    """The queries that count: after the offset, or after those that the profile and the warm-up take."""
    skip = config.evaluation_query_offset
    if config.hnsw_layout == layout.PORDER:
        skip = max(skip, config.porder_profile_queries + config.warmup_queries)
    return evaluate.evaluated(data.queries, skip)


COLUMNS = (
    "method string, parallel string, threads int, queries bigint, base_count bigint, dimension int, k int, nlist int, nprobe int, m int, ks int, "
    "opq_iters int, rerank_p int, local_p int, recall double, build_ms double, average_latency_us double"
)


def run(spark: SparkSession, config: Config, data: Dataset | None = None) -> DataFrame:
    """One row of results; appended as CSV with a header to the folder ``output``, if there is one."""
    data = data or load(spark, config)
    q, c = evaluated(config, data), config
    held: list = []
    got = evaluate.measure(lambda: held[0](q), evaluate.truth_rows(data.truth), q, c.k, lambda: held.append(prepare(c, data)))
    row = (c.label, c.parallel, c.threads, got["queries"], data.base_count, data.dimension, c.k, c.nlist, c.nprobe, c.m, c.ks, c.rotation_rounds, c.rerank_p, c.local_p, got["recall"], got["build_ms"], got["average_latency_us"])
    out = spark.createDataFrame([row], COLUMNS)
    if c.output:
        out.coalesce(1).write.mode("append").option("header", True).csv(c.output)
    return out


def main(arguments: list[str] | None = None) -> int:
    from ..session import local_session

    given = sys.argv[1:] if arguments is None else arguments
    if "--help" in given or "-h" in given:
        print(usage())
        return 0
    try:
        if len(given) == 1 and given[0].startswith("@"):
            given = from_file(given[0][1:])
        config = parse(given)
        spark = SparkSession.getActiveSession() or local_session()
        data = load(spark, config)
        print(f"method {config.label}, base/query/dim {data.base_count}/{data.query_count}/{data.dimension}, k {config.k}")
        if config.dry_run:
            print("data validation: OK")
        else:
            run(spark, config, data).show(truncate=False)
        return 0
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
