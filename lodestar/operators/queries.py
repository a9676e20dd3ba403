"""Query sets: held by the driver in blocks of a bounded size, one after the other, and broadcast to a scan each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..sources import durable

#: Bytes of query vectors in one block: what a scan broadcasts.
BLOCK_BYTES = 32 << 20


class QueryBlock:
    """Ids and vectors of some queries, by id."""

    def __init__(self, qids: np.ndarray, vecs: np.ndarray):
        order = np.argsort(qids, kind="stable")
        self.qids, self.vecs = qids[order].astype(np.int64), vecs[order]

    def __len__(self) -> int:
        return len(self.qids)


def blocks(queries: DataFrame, qid: str = "qid", vec: str = "qvec", most: int = BLOCK_BYTES) -> Iterator[QueryBlock]:
    """All queries, dealt by a hash into blocks of about ``most`` bytes. A set that fits is one block."""
    own = queries.select(F.col(qid).cast("long").alias("qid"), F.col(vec).alias("qvec"))
    n, d = vectors.dimension(own, "qvec")
    count = max(1, -(-n * d * 8 // most))
    for b in range(count):
        part = own if count == 1 else own.where(F.pmod(F.xxhash64("qid"), F.lit(count)) == b)
        got = part.toArrow()
        yield QueryBlock(got.column("qid").to_numpy(), vectors.matrix(got.column("qvec")) if got.num_rows else np.empty((0, d)))


def over_blocks(queries: DataFrame, search: Callable[[QueryBlock], DataFrame], qid: str = "qid", vec: str = "qvec", most: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``search`` for all blocks of a query set.

    One block is searched when the result is asked for. Of several, each is searched at once and its rows are written, before
    the next is read: the driver holds one block at a time, and the result is one scan of what was written.
    """
    done: list[DataFrame] = []
    last: QueryBlock | None = None
    for block in blocks(queries, qid, vec, most):
        if last is not None:
            done.append(durable(search(last)))
        last = block
    if not done:
        return search(last)
    done.append(durable(search(last)))
    paths = [d.__dict__["_durable_path"] for d in done]
    return queries.sparkSession.read.schema(done[0].schema).parquet(*paths)


def of_table(base: DataFrame, every: int = 100) -> DataFrame:
    """The stated query set of a table: the rows whose id is divisible by ``every``."""
    return base.where(F.col("id") % every == 0).select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))


def vector_table(df: DataFrame, id_col: str, vec_col: str, *more: str) -> DataFrame:
    """(id long, vec) and further columns."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), *more)


def from_numpy(spark, rows: np.ndarray, ids: np.ndarray | None = None, id_name: str = "id", vec_name: str = "vec") -> DataFrame:
    """A DataFrame of a 1-D or 2-D array of numbers; ids are row positions unless given."""
    rows = np.asarray(rows)
    if rows.ndim not in (1, 2):
        raise ValueError("vectors must come as one row or as a matrix of rows")
    rows = np.atleast_2d(rows).astype(np.float32)
    ids = np.arange(len(rows)) if ids is None else np.atleast_1d(np.asarray(ids)).astype(np.int64)
    if ids.ndim != 1 or len(ids) != len(rows):
        raise ValueError("The number of labels and of vectors differ")
    return spark.createDataFrame(pa.table({id_name: pa.array(ids), vec_name: vectors.listed(rows, pa.float32())}))
