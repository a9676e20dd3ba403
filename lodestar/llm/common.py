"""What the operators of this package share: Arrow maps over whole texts, durable cuts of the lineage, and workers that rest small."""

from __future__ import annotations

import ctypes
import gc
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import durable, release  # noqa: F401

#: Inner names under which an operator carries the caller's columns, so that no extra column can clash with them.
ID, TEXT = "__id", "__text"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder; the path may lie in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` written in the shared folder and read again: see ``durable``."""
    return durable(df, partition_by)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that begin with ``names`` and that ``df`` doesn't have, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the program itself as a DataFrame whose plan is an expression: no Python and no RDD in it."""
    names = T._parse_datatype_string(schema).names
    text = json.dumps([dict(zip(names, r)) for r in rows], ensure_ascii=False)
    parsed = F.from_json(F.lit(text), F.lit(f"array<struct<{', '.join(f'{f.name}: {f.dataType.simpleString()}' for f in T._parse_datatype_string(schema).fields)}>>"))
    return spark.range(0, 1, 1, 1).select(F.inline(parsed))


def own_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows that the driver has worked out as a DataFrame, by Arrow: rows given as tuples would start a second set of Python
    workers on the executors, only to be read."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)
    columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow), kind)


#: What a worker process keeps between tasks of one operator goes by calling these.
KEPT: list[Callable[[], None]] = []
_held = False


def keeps() -> None:
    """Says that this worker process now holds what ``KEPT`` frees."""
    global _held
    _held = True


def forget() -> None:
    """Frees what tasks of another operator have kept in this worker process."""
    global _held
    if _held:
        for free in KEPT:
            free()
        _held = False
        gc.collect()


def trim() -> None:
    """Gives freed memory back to the machine. Idle workers hold it otherwise, beside whatever an executor does next."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if give_back:
        give_back(0)


def resting(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keep: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, in workers that rest small: each task ends with ``trim`` and, unless ``keep``, begins with ``forget``."""

    def task(batches):
        keeps() if keep else forget()
        try:
            yield from run(batches)
        finally:
            trim()

    return task


#: Bytes of texts that go to a Python worker at once, and the setting of the session that says so.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches hold ``BATCH_BYTES`` at most (or one row): ten thousand long texts at once
    would take hundreds of megabytes of an executor outside its heap. A smaller setting of the caller's stays."""
    conf = df.sparkSession.conf
    now = conf.get(_BATCH, None)
    if now is None or df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) not in range(1, BATCH_BYTES):
        conf.set(_BATCH, str(BATCH_BYTES))
    return df


def narrowed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text (null: empty), under the inner names."""
    return df.select(F.col(id_col).alias(ID), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(TEXT))


def map_texts(
    df: DataFrame,
    id_col: str,
    text_col: str,
    schema: T.StructType,
    start: Callable[[], Callable[[list[bytes]], list]],
    keep: bool = False,
) -> DataFrame:
    """One row per row of ``df``: its id, then the columns of ``schema``.

    ``start`` runs once in each task and returns a function from a list of UTF-8 texts to the columns' values
    (sequences as long as the list, or Arrow arrays). Texts come whole; a batch holds few of them if they are long. With
    ``keep``, a worker keeps its memory of ``KEPT`` for later tasks.
    """
    ids = narrowed(df, id_col, text_col)
    out = T.StructType([T.StructField(id_col, ids.schema[ID].dataType), *schema.fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = start()
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for at in slices(texts):
                part = texts.slice(*at).to_pylist()
                values = columns(part)
                arrays = [batch.column(0).slice(*at).cast(arrow.field(0).type)]
                arrays += [v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v, arrow.field(i + 1).type) for i, v in enumerate(values)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return bounded(ids).mapInArrow(resting(run, keep), out)


def slices(texts: pa.Array, most: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of texts with about ``most`` bytes each; a longer text has a run of its own."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield start, i - start
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes) - start


def field(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind)
