"""Product quantization: codebooks per subspace, codes, lookup tables and two-phase search."""

from __future__ import annotations

import time
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...functions import vectors
from ...sources import durable
from .. import rerank, sampling, topk
from ..ivf import kmeans
from ..queries import QueryBlock, blocks, over_blocks


@dataclass(frozen=True)
class Params:
    parts: int = 16
    codes: int = 256
    train_size: int = sampling.TRAIN_SIZE
    iters: int = 6
    init: str = kmeans.UNIFORM

    def fitted(self, dimension: int, rows: int, strict: bool = False) -> Params:
        """The same within what the data allow. Parts that don't divide the dimension become 12, else 1, or raise."""
        parts = self.parts
        if parts < 1 or dimension % parts:
            if strict:
                raise ValueError("parts must cut the dimension evenly")
            parts = 12 if dimension % 12 == 0 else 1
        codes = min(max(2, self.codes), 256)
        return Params(parts, codes, min(max(self.train_size, codes), rows), max(1, self.iters), self.init)


def split(rows: np.ndarray, parts: int) -> list[np.ndarray]:
    return np.split(rows, parts, axis=1)


def train(sample: np.ndarray, params: Params) -> np.ndarray:
    """(parts, codes, width) centroids; each subspace on its own, from its own seed."""
    return np.stack([kmeans.lloyd(part, params.codes, params.iters, params.init, seed=kmeans.SEED + m) for m, part in enumerate(split(sample, params.parts))])


def encoded(rows: np.ndarray, codebooks: np.ndarray) -> np.ndarray:
    """(rows, parts) codes: the nearest centroid of each subspace, of equal ones the first."""
    return np.stack([kmeans.nearest(part, book) for part, book in zip(split(rows, len(codebooks)), codebooks)], axis=1).astype(np.uint8)


def decoded(codes: np.ndarray, codebooks: np.ndarray) -> np.ndarray:
    return np.concatenate([book[codes[:, m]] for m, book in enumerate(codebooks)], axis=1)


def tables(queries: np.ndarray, codebooks: np.ndarray) -> np.ndarray:
    """(queries, parts, codes): the inner product of each part of a query with each centroid."""
    return np.stack([part @ book.T for part, book in zip(split(queries, len(codebooks)), codebooks)], axis=1)


def whole_numbers(lut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tables as 16-bit whole numbers, and the scale of each query: 32767 over its largest absolute entry, or 1."""
    top = np.abs(lut).max((1, 2), initial=0)
    scale = np.where(top > 0, 32767 / np.where(top > 0, top, 1), 1.0)
    scaled = lut * scale[:, None, None]
    return np.clip(np.sign(scaled) * np.floor(np.abs(scaled) + 0.5), -32768, 32767).astype(np.int32), scale


def scores(lut: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """(rows, queries): the sum of the entries that each row's codes pick from each query's table."""
    out = np.zeros((len(codes), len(lut)), lut.dtype)
    for m in range(codes.shape[1]):
        out += lut[:, m, :].T[codes[:, m]]
    return out


def encode(base: DataFrame, codebooks: np.ndarray, rotation: np.ndarray | None = None) -> DataFrame:
    """``base`` with ``code``, one byte for each part; codebooks are broadcast (codes times dimensions)."""
    held = base.sparkSession.sparkContext.broadcast((codebooks, rotation))
    out = T.StructType([*base.schema.fields, T.StructField("code", T.BinaryType())])
    at = base.columns.index("vec")

    def run(batches):
        books, turn = held.value
        for batch in batches:
            rows = vectors.matrix(batch.column(at))
            codes = encoded(rows if turn is None else rows @ turn.T, books) if len(rows) else np.empty((0, len(books)), np.uint8)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary())], names=[*batch.schema.names, "code"])

    return base.mapInArrow(run, out)


def code_matrix(column: pa.Array, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, parts)


@dataclass(frozen=True)
class Index:
    """Codebooks (on the driver) and a table of the rows with their codes, written once: a scan of codes reads no vectors, and the
    exact phase reads vectors without encoding them again."""

    codebooks: np.ndarray
    rows: DataFrame

    @property
    def parts(self) -> int:
        return len(self.codebooks)


def build(base: DataFrame, params: Params = Params()) -> Index:
    n, d = vectors.dimension(base)
    own = params.fitted(d, n)
    books = train(sampling.training(base, own.train_size), own)
    return Index(books, durable(encode(base, books)))


def candidates(index: Index, block: QueryBlock, p: int, shard: Column | None = None) -> DataFrame:
    """(shard, qid, id, dist): each partition's p best rows for each query by 16-bit tables, by shard (one, unless ``shard``
    says which); ``dist`` is the negated sum."""
    held = index.rows.sparkSession.sparkContext.broadcast(whole_numbers(tables(block.vecs, index.codebooks))[0])
    parts = index.parts

    def start():
        lut = held.value

        def score(batch):
            dist, of = -scores(lut, code_matrix(batch.column(1), parts)).astype(np.float64), batch.column(2).to_numpy()
            for s in np.unique(of):
                at = np.flatnonzero(of == s)
                yield int(s), range(len(lut)), at, dist[at]

        return score

    rows = index.rows.select(F.col("id").cast("long").alias("id"), "code", (shard if shard is not None else F.lit(0)).cast("int").alias("shard"))
    return topk.scan_groups(rows, block.qids, p, start)


def approximate(index: Index, queries: DataFrame, p: int) -> DataFrame:
    """(qid, rank, id, dist) of the p best rows by codes."""
    return over_blocks(queries, lambda b: topk.merged(candidates(index, b, p), p))


def search(index: Index, queries: DataFrame, k: int, p: int = 200) -> DataFrame:
    """(qid, rank, id, dist): the k nearest by true distance of the p best by codes; p is k at least."""
    p = max(p, k)
    return rerank.exact(approximate(index, queries, p), index.rows, queries, k, expected=queries.count() * p)


def search_local(index: Index, queries: DataFrame, k: int, p: int, local_p: int, shards: int) -> DataFrame:
    """As ``search``, but each of ``shards`` (by id) keeps ``local_p`` approximate candidates (0: p): lossy below p."""
    p = max(p, k)
    keep, shard = local_p or p, F.pmod(F.col("id"), F.lit(shards))
    best = over_blocks(queries, lambda b: topk.merged(topk.ranked(candidates(index, b, keep, shard), keep, ("shard", "qid")).select("qid", "id", "dist"), p))
    return rerank.exact(best, index.rows, queries, k, expected=queries.count() * p)


def phase_counts(index: Index, queries: DataFrame, k: int, p: int) -> DataFrame:
    """(phase, rows): how many rows each phase of a search handles."""
    return profile(index, queries, k, p).select("phase", "rows")


def profile(index: Index, queries: DataFrame, k: int, p: int) -> DataFrame:
    """(phase, rows, seconds): what each phase of a search handles and how long it takes, run one after the other: the tables of the
    queries, the scan of all codes down to the candidates, and the exact ranking of those."""
    p, n, spark = max(p, k), index.rows.count(), queries.sparkSession
    start = time.perf_counter()
    sizes = [tables(b.vecs, index.codebooks).size for b in blocks(queries)]
    made = time.perf_counter()
    found = durable(approximate(index, queries, p))
    candidates_n = found.count()
    scanned = time.perf_counter()
    out = rerank.exact(found, index.rows, queries, k, expected=candidates_n).count()
    done = time.perf_counter()
    q = queries.count()
    rows = [("tables", sum(sizes), made - start), ("scan", q * n, scanned - made), ("candidates", candidates_n, scanned - made), ("output", out, done - scanned)]
    return spark.createDataFrame(rows, "phase string, rows long, seconds double")
