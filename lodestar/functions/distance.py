"""Distances between vectors, as Column expressions and as numpy kernels over blocks.

The smaller, the nearer. ``ip`` is one minus the inner product, ``l2`` the squared Euclidean distance without a root, and
``cosine`` is ``ip`` of vectors divided by their length (plus 1e-30). All arithmetic is in double precision.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-30


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def inner_product(a: Column, b: Column) -> Column:
    return 1 - dot(a, b)


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def integer_dot(a: Column, b: Column) -> Column:
    """The exact inner product of two arrays of codes."""
    return F.aggregate(F.zip_with(a.cast("array<bigint>"), b.cast("array<bigint>"), lambda x, y: x * y), F.lit(0).cast("bigint"), lambda s, x: s + x)


def integer_l2(a: Column, b: Column) -> Column:
    """The exact squared distance of two arrays of codes."""
    return F.aggregate(F.zip_with(a.cast("array<bigint>"), b.cast("array<bigint>"), lambda x, y: (x - y) * (x - y)), F.lit(0).cast("bigint"), lambda s, x: s + x)


def element_sum(v: Column) -> Column:
    return F.aggregate(v.cast("array<bigint>"), F.lit(0).cast("bigint"), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    length = F.sqrt(dot(v, v)) + TINY
    return F.transform(doubles(v), lambda x: x / length)


def cosine(a: Column, b: Column) -> Column:
    return inner_product(normalised(a), normalised(b))


def rotated(rows: Column, v: Column) -> Column:
    """``out[i] = <rows[i], v>`` for a matrix given as an array of rows."""
    return F.transform(rows, lambda r: dot(r, v))


def unit(x: np.ndarray) -> np.ndarray:
    return x / (np.sqrt((x * x).sum(1, keepdims=True)) + TINY)


def ip_block(base: np.ndarray, queries: np.ndarray) -> np.ndarray:
    return 1 - base @ queries.T


def l2_block(base: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Differences are squared, not expanded: no digits cancel. In strips, so that no large cube is made."""
    out = np.empty((len(base), len(queries)))
    step = max(1, (1 << 21) // max(1, base.size))
    for at in range(0, len(queries), step):
        d = base[:, None, :] - queries[None, at : at + step, :]
        out[:, at : at + step] = np.einsum("ijk,ijk->ij", d, d)
    return out


def cosine_block(base: np.ndarray, queries: np.ndarray) -> np.ndarray:
    return ip_block(unit(base), unit(queries))


@dataclass(frozen=True)
class Metric:
    """A distance by name: as a Column of two array columns, and of two blocks of rows."""

    name: str
    column: Callable[[Column, Column], Column]
    block: Callable[[np.ndarray, np.ndarray], np.ndarray]


METRICS = {m.name: m for m in (Metric("ip", inner_product, ip_block), Metric("l2", squared_l2, l2_block), Metric("cosine", cosine, cosine_block))}


def metric(which: str | Metric) -> Metric:
    """A registered metric, or one of the caller's own."""
    if isinstance(which, Metric):
        return which
    if which not in METRICS:
        raise ValueError(f"Space name must be one of {', '.join(METRICS)}, not {which}")
    return METRICS[which]


def register(own: Metric) -> None:
    """Adds a metric to those that are known by name (on the driver; kernels carry their metric with them)."""
    METRICS[own.name] = own
