import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators.queries import from_numpy
from lodestar.sources import durable, matrix, release


def test_round_trip(spark, tmp_path):
    rows = np.random.default_rng(1).normal(size=(57, 5)).astype(np.float32)
    df = from_numpy(spark, rows).repartition(4)
    for kind in ("fbin", "fvecs"):
        path = str(tmp_path / f"x.{kind}")
        assert matrix.write_file(df, path, kind) == (57, 5)
        got = sorted(matrix.read(spark, path, kind).collect())
        assert [r.id for r in got] == list(range(57)) and np.array([r.vec for r in got], np.float32).tolist() == rows.tolist()
    small = spark.createDataFrame([(i, [i, 2 * i, 255]) for i in range(9)], "id long, vec array<int>")
    for kind in ("u8bin", "bvecs", "i32bin", "ivecs"):
        path = str(tmp_path / f"y.{kind}")
        matrix.write_file(small, path, kind)
        assert [r.vec for r in sorted(matrix.read(spark, path, kind).collect())] == [[i, 2 * i, 255] for i in range(9)]


def test_raw(spark, tmp_path):
    path = tmp_path / "r.bin"
    path.write_bytes(np.arange(12, dtype="<f4").tobytes())
    assert [r.vec for r in sorted(matrix.read(spark, str(path), "raw", dim=4).collect())] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10, 11]]
    with pytest.raises(ValueError):
        matrix.read(spark, str(path), "raw", dim=5)


def test_split_by_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(matrix, "ROWS_BYTES", 64)
    path = str(tmp_path / "s.fbin")
    matrix.write_file(from_numpy(spark, np.arange(100.0).reshape(50, 2)), path)
    assert len(matrix.MatrixReader({"path": path, "kind": "fbin"}).partitions()) == 7
    assert matrix.read(spark, path).agg(F.sum("id"), F.count("id")).first() == (1225, 50)


def test_folders(spark, tmp_path):
    df = from_numpy(spark, np.arange(60.0).reshape(20, 3))
    matrix.register(spark)
    path = str(tmp_path / "parts")
    df.repartition(3).write.format("matrix").option("kind", "fbin").mode("append").save(path)
    got = matrix.read(spark, path)
    assert got.count() == 20 and sorted(r.id for r in got.collect()) == list(range(20))
    assert sorted(r.vec for r in got.collect()) == [[3.0 * i, 3.0 * i + 1, 3.0 * i + 2] for i in range(20)]


@pytest.mark.parametrize("content, error", [(b"", "header"), (struct.pack("<II", 0, 4), "header"), (struct.pack("<II", 2, 0), "header"), (struct.pack("<II", 2, 4) + b"\0" * 31, "truncated")])
def test_bad_files(spark, tmp_path, content, error):
    path = tmp_path / "bad.fbin"
    path.write_bytes(content)
    with pytest.raises(ValueError, match=error):
        matrix.read(spark, str(path))


def test_missing_and_mixed(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        matrix.read(spark, str(tmp_path / "none.fbin"))
    with pytest.raises(ValueError):
        matrix.read(spark, str(tmp_path / "none.fbin"), "parquet")
    path = tmp_path / "mixed.fvecs"
    path.write_bytes(struct.pack("<iff", 2, 1, 2) + struct.pack("<iff", 3, 1, 2))
    with pytest.raises(Exception, match="different dimensions"):
        matrix.read(spark, str(path), "fvecs").collect()


def test_synthetic_vectors(spark):
    a, b = matrix.synthetic(spark, 40, 8).collect(), matrix.synthetic(spark, 80, 8).repartition(3).collect()
    assert {r.id: r.vec for r in a}.items() <= {r.id: r.vec for r in b}.items()
    assert all(abs(sum(x * x for x in r.vec) - 1) < 1e-5 for r in a)


def test_durable(spark):
    df = spark.range(10).withColumn("x", F.rand())
    kept = durable(df)
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, kept.collect())) and kept.columns == df.columns


def test_lost_attempts_leave_no_rows(spark, tmp_path):
    """Files of attempts that were not committed stay in the staging folder, which goes with the job."""
    from types import SimpleNamespace

    import pyspark

    path = str(tmp_path / "staged")
    writer = matrix.MatrixWriter({"path": path, "kind": "fbin"})
    rows = [SimpleNamespace(id=i, vec=[float(i), 1.0]) for i in range(5)]
    context, number = SimpleNamespace(partitionId=lambda: 0, taskAttemptId=lambda: next(numbers)), None
    numbers = iter(range(10))
    old = pyspark.TaskContext.get
    pyspark.TaskContext.get = classmethod(lambda cls: context)
    try:
        writer.write(iter(rows))  # an attempt that is lost
        done = writer.write(iter(rows))
    finally:
        pyspark.TaskContext.get = old
    writer.commit([done, None, matrix._Written("", 0)])
    assert sorted(p.name for p in (tmp_path / "staged").iterdir()) == [done.name]
    assert [r.vec for r in sorted(matrix.read(spark, path).collect())] == [[float(i), 1.0] for i in range(5)]
    matrix.MatrixWriter({"path": path, "kind": "fbin"}).abort([])


def test_tables_are_released(spark):
    import os

    df = durable(spark.range(5), None)
    path = df.__dict__["_durable_path"].removeprefix("file:")
    assert os.path.exists(path)
    release(df)
    release(df)
    assert not os.path.exists(path)
    parts = durable(spark.range(6).selectExpr("cast(id % 2 as int) AS list_id", "id"), ["list_id"])
    assert parts.columns == ["list_id", "id"] and sorted(map(tuple, parts.collect())) == sorted((i % 2, i) for i in range(6))


def test_durable_leaves_no_shuffle_files(spark):
    """What was shuffled to make a table goes with its making; the caller's setting stays."""
    held = lambda: {f for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    key, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", held()
    was = spark.conf.get(key, "false")
    out = durable(spark.range(10_000).repartition(3, "id").groupBy((F.col("id") % 100).alias("k")).count())
    until = time.time() + 3
    while held() - before and time.time() < until:
        time.sleep(0.2)
    assert not held() - before and out.count() == 100 and spark.conf.get(key, "false") == was
