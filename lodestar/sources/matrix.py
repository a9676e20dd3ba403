"""Binary matrix files as a Spark data source, split by rows: ``spark.read.format("matrix")`` after ``register(spark)``.

``kind`` is one of

* ``fbin``, ``u8bin``, ``i32bin``: two little-endian uint32 (rows, columns), then float32, uint8 or int32 values by row;
* ``fvecs``, ``bvecs``, ``ivecs``: for each row an int32 with its dimension, then its values;
* ``raw``: values only; ``dim`` says how many make a row, and ``dtype`` (float32, uint8 or int32) what they are.

Rows come as (id long, vec array); ids are positions in the file. Paths are local, or URIs of a file system that Arrow
knows. Files are read by ranges of rows, so a large file has many tasks and none holds more than ``ROWS_BYTES``.
Writing makes a file of the kind for each task, with its rows in the order in which the task has them; ``write_file`` makes one
file, in order of the ids.
"""

from __future__ import annotations

import struct
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

ROWS_BYTES = 32 << 20
_DTYPES = {"fbin": "<f4", "u8bin": "u1", "i32bin": "<i4", "fvecs": "<f4", "bvecs": "u1", "ivecs": "<i4"}
_RAW = {"float32": "<f4", "uint8": "u1", "int32": "<i4"}
_SQL = {"<f4": "float", "u1": "smallint", "<i4": "int"}
_ARROW = {"<f4": pa.float32(), "u1": pa.int16(), "<i4": pa.int32()}


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


@dataclass(frozen=True)
class Form:
    """How rows lie in a file."""

    rows: int
    dim: int
    dtype: str
    start: int
    before: int  #: bytes of a row before its values

    @property
    def stride(self) -> int:
        return self.before + self.dim * np.dtype(self.dtype).itemsize


def form_of(path: str, kind: str, dim: int = 0, dtype: str = "float32") -> Form:
    """Reads and checks a file's header."""
    if kind not in _DTYPES and kind != "raw":
        raise ValueError(f"unknown matrix kind: {kind}")
    fs, name = _open(path)
    info = fs.get_file_info(name)
    if info.type != pafs.FileType.File:
        raise FileNotFoundError(f"cannot open data file: {path}")
    if kind == "raw":
        code = _RAW[dtype]
        stride = dim * np.dtype(code).itemsize
        if dim < 1 or not info.size or info.size % stride:
            raise ValueError(f"truncated matrix payload: {path}")
        return Form(info.size // stride, dim, code, 0, 0)
    with fs.open_input_file(name) as f:
        head = f.read_at(8, 0)
    code = _DTYPES[kind]
    if kind.endswith("bin"):
        rows, dim = struct.unpack("<II", head) if len(head) == 8 else (0, 0)
        if not rows or not dim:
            raise ValueError(f"invalid matrix header: {path}")
        form = Form(rows, dim, code, 8, 0)
        if info.size < 8 + rows * form.stride:
            raise ValueError(f"truncated matrix payload: {path}")
        return form
    dim = struct.unpack("<i", head[:4])[0] if len(head) >= 4 else 0
    if dim < 1:
        raise ValueError(f"invalid matrix header: {path}")
    form = Form(0, dim, code, 0, 4)
    if info.size % form.stride:
        raise ValueError(f"truncated matrix payload: {path}")
    return Form(info.size // form.stride, dim, code, 0, 4)


def read_rows(path: str, form: Form, first: int, count: int) -> np.ndarray:
    fs, name = _open(path)
    with fs.open_input_file(name) as f:
        data = f.read_at(count * form.stride, form.start + first * form.stride)
    if len(data) < count * form.stride:
        raise ValueError(f"truncated matrix payload: {path}")
    rows = np.frombuffer(data, np.uint8).reshape(count, form.stride)
    if form.before and (rows[:, :4].copy().view("<i4") != form.dim).any():
        raise ValueError(f"rows of different dimensions: {path}")
    return np.ascontiguousarray(rows[:, form.before :]).view(form.dtype)


@dataclass
class _Range(InputPartition):
    path: str
    form: Form
    first: int
    count: int
    id_from: int


class MatrixReader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        out, ids = [], 0
        for path, form in _files(self.options):
            step = max(1, ROWS_BYTES // form.stride)
            out += [_Range(path, form, at, min(step, form.rows - at), ids + at) for at in range(0, form.rows, step)]
            ids += form.rows
        return out

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        rows = read_rows(partition.path, partition.form, partition.first, partition.count)
        kind = _ARROW[partition.form.dtype]
        for at in range(0, len(rows), 10_000):
            part = rows[at : at + 10_000]
            ends = pa.array(np.arange(len(part) + 1, dtype=np.int32) * part.shape[1])
            vec = pa.ListArray.from_arrays(ends, pa.array(part.reshape(-1)).cast(kind))
            ids = pa.array(np.arange(len(part), dtype=np.int64) + partition.id_from + at)
            yield pa.RecordBatch.from_arrays([ids, vec], names=["id", "vec"])


def _files(options) -> list[tuple[str, Form]]:
    """The file of ``path``, or all files of a folder, by name."""
    path, kind = options["path"], options.get("kind", "fbin")
    fs, name = _open(path)
    paths = [path]
    if fs.get_file_info(name).type == pafs.FileType.Directory:
        found = fs.get_file_info(pafs.FileSelector(name))
        paths = sorted(f"{path.rstrip('/')}/{i.base_name}" for i in found if i.type == pafs.FileType.File and not i.base_name.startswith(("_", ".")))
    return [(p, form_of(p, kind, int(options.get("dim", 0)), options.get("dtype", "float32"))) for p in paths]


@dataclass
class _Written(WriterCommitMessage):
    name: str
    rows: int


class MatrixWriter(DataSourceWriter):
    """A file for each task that has rows, in their order, under a name of its own.

    Tasks write to a staging folder; the job moves the files of its committed tasks and deletes the folder, so those of lost
    or doubled attempts never count. Values are spooled to the task's disk until their number is known for the header.
    """

    SPOOL_BYTES = 32 << 20

    def __init__(self, options):
        self.path, self.kind = options["path"].rstrip("/"), options.get("kind", "fbin")
        self.job = uuid.uuid4().hex[:8]
        if self.kind not in ("fbin", "u8bin", "i32bin"):
            raise ValueError(f"can't write matrix kind: {self.kind}")

    @property
    def staging(self) -> str:
        return f"{self.path}/_staging-{self.job}"

    def write(self, rows) -> _Written:
        from pyspark import TaskContext

        count = dim = 0
        with tempfile.SpooledTemporaryFile(self.SPOOL_BYTES) as spool:
            for r in rows:
                values = np.asarray(r.vec, _DTYPES[self.kind])
                if count and len(values) != dim:
                    raise ValueError("wrong dimensionality of the vectors")
                dim = len(values)
                spool.write(values.tobytes())
                count += 1
            if not count:
                return _Written("", 0)
            task = TaskContext.get()
            name = f"part-{task.partitionId():05d}-{self.job}-{task.taskAttemptId()}.{self.kind}"
            fs, where = _open(f"{self.staging}/{name}")
            fs.create_dir(where.rsplit("/", 1)[0], recursive=True)
            spool.seek(0)
            with fs.open_output_stream(where) as f:
                f.write(struct.pack("<II", count, dim))
                while block := spool.read(1 << 20):
                    f.write(block)
        return _Written(name, count)

    def _clear(self) -> None:
        fs, where = _open(self.staging)
        if fs.get_file_info(where).type == pafs.FileType.Directory:
            fs.delete_dir(where)

    def commit(self, messages) -> None:
        for m in messages:
            if m and m.name:
                fs, where = _open(f"{self.staging}/{m.name}")
                fs.move(where, _open(f"{self.path}/{m.name}")[1])
        self._clear()

    def abort(self, messages) -> None:
        self._clear()


class MatrixSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "matrix"

    def schema(self) -> str:
        kind = self.options.get("kind", "fbin")
        code = _RAW[self.options.get("dtype", "float32")] if kind == "raw" else _DTYPES.get(kind, "<f4")
        return f"id bigint, vec array<{_SQL[code]}>"

    def reader(self, schema):
        return MatrixReader(dict(self.options))

    def writer(self, schema, overwrite):
        return MatrixWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MatrixSource)


def read(spark: SparkSession, path: str, kind: str = "fbin", **options) -> DataFrame:
    """(id, vec) of a matrix file or of a folder of them. What is wrong with a header is raised here, before any task."""
    _files({"path": path, "kind": kind, **{k: str(v) for k, v in options.items()}})
    register(spark)
    reader = spark.read.format("matrix").option("kind", kind)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load(path)


def write_file(df: DataFrame, path: str, kind: str = "fbin") -> tuple[int, int]:
    """One file in order of ``id``, streamed through the driver a partition at a time; returns (rows, columns)."""
    code = _DTYPES[kind]
    fs, name = _open(path)
    rows = dim = 0
    with fs.open_output_stream(name) as f:
        total = df.count()
        for r in df.select("id", "vec").orderBy("id").toLocalIterator(prefetchPartitions=True):
            if not rows:
                dim = len(r.vec)
                if kind.endswith("bin"):
                    f.write(struct.pack("<II", total, dim))
            if len(r.vec) != dim:
                raise ValueError("wrong dimensionality of the vectors")
            if not kind.endswith("bin"):
                f.write(struct.pack("<i", dim))
            f.write(np.asarray(r.vec, code).tobytes())
            rows += 1
    return rows, dim


def synthetic(spark: SparkSession, rows: int, dim: int, seed: int = 2026, ids: str = "id", name: str = "vec") -> DataFrame:
    """(id, vec): seeded unit vectors, each made from (seed, id) alone."""

    def run(batches):
        for batch in batches:
            own = batch.column(0).to_numpy()
            x = np.stack([np.random.default_rng((seed, int(i))).uniform(-1, 1, dim) for i in own]) if len(own) else np.empty((0, dim))
            x = (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * dim)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(x.reshape(-1)))], names=[ids, name])

    return spark.range(rows).mapInArrow(run, f"{ids} bigint, {name} array<float>")
