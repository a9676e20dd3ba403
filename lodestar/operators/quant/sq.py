"""Scalar quantization to 8 bits, unsigned over the value range and signed round zero. Built-in expressions only."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions import distance, vectors
from .. import rerank, topk
from ..queries import QueryBlock, over_blocks


def _half_away(x: Column) -> Column:
    """Rounded to a whole number, halves away from zero."""
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


def train(base: DataFrame) -> DataFrame:
    """One row: the least and the largest of all values, and the step of 255 parts of that range (1 if it is empty)."""
    low = F.min(F.array_min(distance.doubles(F.col("vec"))))
    high = F.max(F.array_max(distance.doubles(F.col("vec"))))
    return base.agg(low.alias("low"), high.alias("high")).withColumn("step", F.when(F.col("high") > F.col("low"), (F.col("high") - F.col("low")) / 255).otherwise(1.0))


def encode(base: DataFrame, model: DataFrame, vec: str = "vec") -> DataFrame:
    """``base`` with ``code`` (0 to 255) and ``code_sum``. ``model`` is one row; its numbers become part of the expressions."""
    low, high, _ = model.first()
    scale = 255 / (high - low) if low is not None and high > low else 1.0
    code = F.transform(distance.doubles(F.col(vec)), lambda x: F.greatest(F.lit(0.0), F.least(F.lit(255.0), _half_away((x - F.lit(low)) * F.lit(scale)))).cast("smallint"))
    return base.withColumn("code", code).withColumn("code_sum", distance.element_sum(F.col("code")))


def train_signed(base: DataFrame) -> DataFrame:
    """One row: the largest absolute value, and the step of 127 parts of it."""
    return base.agg(F.max(F.array_max(F.transform(distance.doubles(F.col("vec")), F.abs))).alias("max_abs")).withColumn("step", F.when(F.col("max_abs") > 0, F.col("max_abs") / 127).otherwise(1.0))


def encode_signed(base: DataFrame, model: DataFrame, vec: str = "vec") -> DataFrame:
    """``base`` with ``code`` (-127 to 127)."""
    step = model.first()["step"]
    code = F.transform(distance.doubles(F.col(vec)), lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), _half_away(x / F.lit(step)))).cast("tinyint"))
    return base.withColumn("code", code)


def _codes_scan(codes: DataFrame, block: QueryBlock, p: int, score) -> DataFrame:
    """The p rows of ``codes`` (id, code, code_sum) of least score for each query."""
    held = codes.sparkSession.sparkContext.broadcast(block.vecs)

    def start():
        own = held.value

        def run(batch):
            base = vectors.matrix(batch.column(1))
            sums = batch.column(2).to_numpy().astype(np.float64)
            yield range(len(own)), None, score(base, sums, own)

        return run

    return topk.scan(codes.select(F.col("id").cast("long").alias("id"), "code", "code_sum"), block.qids, p, start)


def approximate(codes: DataFrame, query_codes: DataFrame, model: DataFrame, p: int) -> DataFrame:
    """(qid, rank, id, dist): the p codes of the highest affine score. ``dist`` is the negated score.

    The score of codes a, b over d dimensions is step² <a, b> + step low (sum a + sum b) + d low², the inner product of
    the values that they stand for.
    """
    low, _, step = model.first()

    def score(base, sums, own):
        return -(step * step * (base @ own.T) + step * low * (sums[:, None] + own.sum(1)[None, :]) + base.shape[1] * low * low)

    return over_blocks(query_codes, lambda b: topk.merged(_codes_scan(codes, b, p, score), p))


def approximate_signed(codes: DataFrame, query_codes: DataFrame, p: int) -> DataFrame:
    """The p codes of the largest whole-number inner product; ``dist`` is negated."""
    return over_blocks(query_codes, lambda b: topk.merged(_codes_scan(codes.withColumn("code_sum", F.lit(0)), b, p, lambda base, _, own: -(base @ own.T)), p))


def _query_codes(queries: DataFrame, model: DataFrame, coder) -> DataFrame:
    return coder(queries, model, "qvec").select("qid", F.col("code").alias("qvec"))


def search(base: DataFrame, queries: DataFrame, k: int, p: int) -> DataFrame:
    """(qid, rank, id, dist): the k nearest by true distance of the p best by unsigned codes; p is k at least."""
    model = train(base)
    found = approximate(encode(base, model), _query_codes(queries, model, encode), model, max(p, k))
    return rerank.exact(found, base, queries, k)


def search_signed(base: DataFrame, queries: DataFrame, k: int, p: int) -> DataFrame:
    """As ``search``, by signed codes."""
    model = train_signed(base)
    found = approximate_signed(encode_signed(base, model), _query_codes(queries, model, encode_signed), max(p, k))
    return rerank.exact(found, base, queries, k)
