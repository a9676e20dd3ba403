"""Recall, latency and parameter sweeps."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exact


def recall_by_query(found: DataFrame, truth: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, recall): the share of the first k true ids that were found, 0 for a query without any."""
    right = truth.where(F.col("rank") <= k).select("qid", "id")
    hits = found.select("qid", "id").distinct().join(right, ["qid", "id"], "left_semi").groupBy("qid").agg(F.count(F.lit(1)).alias("hits"))
    return queries.select("qid").join(hits, "qid", "left").select("qid", F.round(F.coalesce("hits", F.lit(0)) / k, 6).alias("recall"))


def mean_recall(found: DataFrame, truth: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """One row: queries and their mean recall."""
    return recall_by_query(found, truth, queries, k).agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("recall"), 6).alias("recall"))


def ground_truth(base: DataFrame, queries: DataFrame, width: int, metric: str = "ip") -> DataFrame:
    """(qid, gt): the ids of the ``width`` nearest rows, in order."""
    near = exact.knn(base, queries, width, metric)
    return near.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("gt"))


def truth_rows(truth: DataFrame) -> DataFrame:
    """(qid, rank, id) from (qid, gt)."""
    return truth.select("qid", F.posexplode("gt").alias("at", "id")).select("qid", (F.col("at") + 1).alias("rank"), F.col("id").cast("long").alias("id"))


def evaluated(queries: DataFrame, offset: int = 0, count: int | None = None) -> DataFrame:
    """The queries from ``offset`` on, ``count`` of them at most: those before are for profiles and for warming up."""
    out = queries.where(F.col("qid") >= offset)
    return out if count is None else out.where(F.col("qid") < offset + count)


def measure(search: Callable[[], DataFrame], truth: DataFrame, queries: DataFrame, k: int, build: Callable[[], None] | None = None) -> dict:
    """Mean recall, milliseconds of building, and microseconds a query (wall time over queries)."""
    start = time.perf_counter()
    if build:
        build()
    built = time.perf_counter()
    found = search()
    rows = found.select("qid", "rank", "id", "dist").toArrow()
    done = time.perf_counter()
    got = mean_recall(queries.sparkSession.createDataFrame(rows), truth, queries, k).first()
    return {"queries": got["queries"], "recall": got["recall"], "build_ms": (built - start) * 1e3, "average_latency_us": (done - built) * 1e6 / max(1, got["queries"])}


def sweep(values: Iterable[int], search: Callable[[int], DataFrame], truth: DataFrame, queries: DataFrame, k: int, name: str = "value") -> DataFrame:
    """(name, queries, recall): mean recall for each value of a parameter."""
    out = None
    for v in values:
        row = mean_recall(search(v), truth, queries, k).select(F.lit(v).alias(name), "queries", "recall")
        out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("a sweep needs values")
    return out


def sweep_times(values: Iterable[int], search: Callable[[int], DataFrame], truth: DataFrame, queries: DataFrame, k: int, name: str = "value") -> DataFrame:
    """(name, queries, recall, average_latency_us): as ``sweep``, each value run on its own, with wall time over queries."""
    rows = []
    for v in values:
        got = measure(lambda: search(v), truth, queries, k)
        rows.append((v, got["queries"], got["recall"], got["average_latency_us"]))
    if not rows:
        raise ValueError("a sweep needs values")
    return queries.sparkSession.createDataFrame(rows, f"{name} int, queries long, recall double, average_latency_us double")
