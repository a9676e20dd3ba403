from lodestar.operators import exact
from lodestar.operators.queries import from_numpy
from lodestar.streaming import upsert

import numpy as np


def test_changes_reach_searches(spark, tmp_path):
    incoming, store = str(tmp_path / "in"), str(tmp_path / "store")
    batch = lambda rows: spark.createDataFrame(rows, upsert.CHANGE).coalesce(1).write.mode("append").parquet(incoming)
    base = from_numpy(spark, np.array([[0.0, 1.0], [9.0, 9.0]]))
    batch([(0, [5.0, 5.0], False, 1), (2, [1.0, 0.0], False, 1)])
    query = upsert.follow(spark.readStream.schema(upsert.CHANGE).parquet(incoming), store, str(tmp_path / "check"))
    query.processAllAvailable()
    batch([(0, [0.0, 2.0], False, 3), (1, [9.0, 9.0], True, 2)])
    batch([(0, [7.0, 7.0], False, 2)])  # late: an older version
    query.processAllAvailable()
    query.stop()
    now = upsert.current(spark, store, base)
    assert sorted((r.id, r.vec) for r in now.collect()) == [(0, [0.0, 2.0]), (2, [1.0, 0.0])]
    q = from_numpy(spark, np.array([[0.0, 2.0]]), id_name="qid", vec_name="qvec")
    assert [r.id for r in exact.knn(now, q, 5, "l2").orderBy("rank").collect()] == [0, 2]


def test_compaction_and_ties(spark, tmp_path):
    """A snapshot reads as the batches it replaces; of equal versions the later batch counts, whatever the order of reading."""
    store = str(tmp_path / "store")
    keep = lambda n, rows: spark.createDataFrame(rows, upsert.CHANGE).write.mode("overwrite").parquet(f"{store}/changes/batch={n}")
    assert upsert.compact(spark, store) == -1 and upsert.current(spark, store).count() == 0
    keep(0, [(1, [1.0], False, 5), (2, [2.0], False, 1), (3, [3.0], False, 1)])
    keep(1, [(1, [9.0], False, 5), (2, [2.5], True, 2), (4, [4.0], False, 1), (4, [4.5], False, 1)])
    before = sorted(map(tuple, upsert.current(spark, store).collect()))
    assert [i for i, _ in before] == [1, 3, 4] and before[0][1] == [9.0]
    assert upsert.compact(spark, store) == 1 and upsert.compact(spark, store) == 1
    assert sorted(map(tuple, upsert.current(spark, store).collect())) == before
    keep(2, [(2, [7.0], False, 3), (3, [0.0], True, 1), (1, [0.0], False, 4)])
    now = sorted(map(tuple, upsert.current(spark, store, from_numpy(spark, np.array([[6.0], [5.0]]), np.array([3, 50]))).collect()))
    assert [i for i, _ in now] == [1, 2, 4, 50] and now[0][1] == [9.0] and now[1][1] == [7.0]
