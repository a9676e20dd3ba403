"""Connected components of a graph of links, by star contraction in DataFrames.

Each round points every node's larger neighbours at its smallest (large star), then its smaller ones (small star). A
node's smallest neighbour is an aggregate, so the links of a node with very many of them never meet in one task; the
join that brings it back is salted. Rounds grow with the
logarithm of the longest path. Each ends in a table in the shared folder; the one before goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


SALTS = 8


def salted(rows: DataFrame, few: DataFrame, key: str, spread: str) -> DataFrame:
    """The join of ``rows`` with ``few`` (a row for each key), in which a key with very many rows has ``SALTS`` places.

    ``few`` is repeated for each salt. Both sides are dealt anew, so that adaptive execution can split what is still hot.
    """
    left = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    right = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [key, "__salt"]).drop("__salt")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (a, b) with a > b, distinct."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    out = salted(both, least, "u", "v")
    if large:
        out = out.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = out.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a > b").distinct()


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): for every node of a link, the smallest node that links reach. Null ends and loops are left out."""
    now = common.cut(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .distinct()
    )
    while True:
        # A forest of stars: no node has two parents, and no parent has one.
        twice = now.groupBy("a").count().where("count > 1").limit(1)
        inner = now.join(now.select(F.col("a").alias("b")), "b", "left_semi").limit(1)
        if not twice.take(1) and not inner.take(1):
            break
        last, now = now, common.cut(_star(_star(now, True), False))
        common.release(last)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
