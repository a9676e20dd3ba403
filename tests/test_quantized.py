import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import evaluate, exact, sampling, sharded
from lodestar.operators.ivf import index as ivf
from lodestar.operators.ivf import kmeans, pq_index
from lodestar.operators.quant import opq, pq, sq
from lodestar.operators.queries import from_numpy

K = 10


@pytest.fixture(scope="module")
def pair(spark):
    r = np.random.default_rng(8)
    centres = r.normal(size=(12, 16))
    rows = centres[r.integers(0, 12, 900)] + 0.4 * r.normal(size=(900, 16))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    base = from_numpy(spark, rows)
    q = base.where("id % 50 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    return rows.astype(np.float32).astype(float), base, q, exact.knn(base, q, K).cache()


def recall(found, truth, q):
    return evaluate.mean_recall(found, truth, q, K).first().recall


def test_scalar_codes(pair):
    rows, base, q, truth = pair
    low, high, step = sq.train(base).first()
    assert (low, high) == (rows.min(), rows.max()) and abs(step - (high - low) / 255) < 1e-12
    for r in sq.encode(base, sq.train(base)).limit(50).collect():
        assert np.abs(np.array(r.code) * step + low - rows[r.id]).max() <= step / 2 + 1e-9 and r.code_sum == sum(r.code)
    assert recall(sq.search(base, q, K, 60), truth, q) > 0.98
    assert recall(sq.search_signed(base, q, K, 60), truth, q) > 0.98


def test_constant_values(spark):
    flat = from_numpy(spark, np.zeros((5, 3)))
    assert sq.train(flat).first().step == 1.0 and sq.train_signed(flat).first().step == 1.0
    assert sq.encode(flat, sq.train(flat)).first().code == [0, 0, 0]


def test_kmeans_policies():
    rows = np.array([[0.0], [0.1], [10.0], [10.1]])
    assert kmeans.lloyd(rows, 2, 3).ravel().tolist() == [0.05, 10.05]
    same = np.ones((6, 2))
    assert kmeans.lloyd(same, 3, 2, kmeans.FIRST, kmeans.KEEP).tolist() == same[:3].tolist()
    assert kmeans.lloyd(same, 3, 2).shape == (3, 2)
    spread = kmeans.initial(np.arange(100.0)[:, None], 4, kmeans.PLUS_PLUS)
    assert len(np.unique(spread)) == 4 and (spread == kmeans.initial(np.arange(100.0)[:, None], 4, kmeans.PLUS_PLUS)).all()
    assert kmeans.nearest(np.array([[1.0]]), np.array([[0.0], [2.0]])).tolist() == [0]  # of equal ones the first
    with pytest.raises(ValueError):
        kmeans.lloyd(rows[:0], 2, 1)


def test_sample_positions(spark, pair):
    assert sampling.positions(10, 4) == [0, 2, 5, 7]
    rows, base, _, _ = pair
    assert (sampling.training(base, 90) == rows[[t * 900 // 90 for t in range(90)]]).all()
    gaps = base.where("id % 2 = 1")
    assert len(sampling.training(gaps, 50)) == 50 and (sampling.training(gaps, 50) == sampling.training(gaps.repartition(3), 50)).all()


def test_inverted_file(spark, pair, tmp_path):
    rows, base, q, truth = pair
    index = ivf.build(base, ivf.Params(16, 300, 4))
    assert index.rows.count() == 900
    assert recall(ivf.search(index, q, K, 16), truth, q) == 1.0
    by_probes = [recall(ivf.search(index, q, K, n), truth, q) for n in (1, 4, 8)]
    assert by_probes == sorted(by_probes) and by_probes[-1] > 0.9
    stats = kmeans.list_stats(index.rows, 16).first()
    assert stats.lists == 16 and abs(stats.avg_rows - 900 / 16) < 1e-6
    index.save(str(tmp_path / "ivf"))
    again = ivf.load(spark, str(tmp_path / "ivf"))
    assert sorted(map(tuple, ivf.search(again, q, K, 4).collect())) == sorted(map(tuple, ivf.search(index, q, K, 4).collect()))
    plan = ivf.search(again, q.limit(1), K, 1)._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "list_id" in plan.split("PartitionFilters: [")[1][:200]


def test_parameters():
    assert ivf.Params(0, 5, 0).fitted(50) == ivf.Params(50, 50, 1)
    assert pq.Params(5, 1000, 10, 0).fitted(24, 400) == pq.Params(12, 256, 256, 1)
    assert pq.Params(5).fitted(7, 400).parts == 1
    with pytest.raises(ValueError):
        pq.Params(5).fitted(24, 400, strict=True)
    with pytest.raises(ValueError):
        ivf.Params().fitted(0)


def test_product_codes(pair):
    rows, base, q, truth = pair
    index = pq.build(base, pq.Params(8, 16, 300, 4))
    for r in index.rows.limit(30).collect():
        code = np.frombuffer(bytes(r.code), np.uint8)
        for m, (part, book) in enumerate(zip(np.split(rows[r.id], 8), index.codebooks)):
            d = ((book - part) ** 2).sum(1)
            assert d[code[m]] <= d.min() + 1e-12
    by_p = [recall(pq.search(index, q, K, p), truth, q) for p in (10, 60, 900)]
    assert by_p == sorted(by_p) and by_p[-1] == 1.0
    assert recall(pq.search_local(index, q, K, 200, 0, 3), truth, q) >= recall(pq.search_local(index, q, K, 200, 5, 3), truth, q)


def test_tables_as_whole_numbers():
    lut = np.array([[[0.5, -1.0], [0.25, 0.0]], [[0.0, 0.0], [0.0, 0.0]]])
    got, scale = pq.whole_numbers(lut)
    assert got[0].tolist() == [[16384, -32767], [8192, 0]] and scale.tolist() == [32767.0, 1.0] and not got[1].any()


def test_rotation(pair):
    rows, base, q, truth = pair
    sample = sampling.training(base, 300)
    rotation, errors = opq.train(sample, pq.Params(4, 8, 300, 3), 3)
    assert opq.error(rotation) < opq.WORST and errors[-1] <= errors[0] * 1.05
    turn = np.linalg.qr(np.random.default_rng(1).normal(size=(16, 16)))[0]
    assert np.allclose(opq.procrustes(sample, sample @ turn.T), turn, atol=1e-8)


def test_cross_covariance(spark, pair):
    rows, base, _, _ = pair
    pairs = base.select(F.col("vec").alias("a"), F.reverse("vec").alias("b")).repartition(4)
    assert np.allclose(opq.cross_covariance(pairs, "a", "b"), rows[:, ::-1].T @ rows, atol=1e-6)


@pytest.mark.parametrize("local", [False, True])
@pytest.mark.parametrize("rounds", [0, 2])
def test_lists_of_codes(spark, pair, tmp_path, local, rounds):
    rows, base, q, truth = pair
    build = pq_index.build_local if local else pq_index.build_global
    index = build(base, ivf.Params(8, 300, 3), pq.Params(8, 16, 300, 3), rounds)
    assert index.uses_rotation == bool(rounds) and index.describe()["orthogonality_error"] < opq.WORST
    assert recall(pq_index.search(index, q, K, 8, 900), truth, q) == 1.0
    assert recall(pq_index.search(index, q, K, 6, 200), truth, q) > 0.9
    candidates = pq_index.candidates(index, q, 2, 20).groupBy("qid").count().collect()
    assert all(r["count"] <= 20 for r in candidates)
    index.save(str(tmp_path / "pq"))
    again = pq_index.load(spark, str(tmp_path / "pq"))
    assert sorted(map(tuple, pq_index.search(again, q, K, 3, 50).collect())) == sorted(map(tuple, pq_index.search(index, q, K, 3, 50).collect()))


def test_small_lists(spark):
    rows = np.eye(6, 8)
    index = pq_index.build_local(from_numpy(spark, rows), ivf.Params(4, 6, 2), pq.Params(2, 16, 6, 2))
    assert index.rows.count() == 6 and all(b.shape == (2, 16, 4) for b in index.codebooks.values())


def test_owners(spark):
    for lists, shards in ((100, 8), (5, 8), (16, 4)):
        df = spark.range(lists).select(F.col("id").cast("int").alias("l"))
        for how in (sharded.BLOCK, sharded.CYCLIC):
            got = df.select("l", sharded.owner(F.col("l"), lists, shards, how).alias("s")).collect()
            counts = np.bincount([r.s for r in got], minlength=shards)
            assert counts.sum() == lists and counts.max() - counts.min() <= 1
        runs = [r.s for r in sorted(df.select("l", sharded.owner(F.col("l"), lists, shards, sharded.BLOCK).alias("s")).collect())]
        assert runs == sorted(runs)
    with pytest.raises(ValueError):
        sharded.owner(F.col("l"), 4, 0)


def test_sharded_equals_unsharded(pair):
    rows, base, q, truth = pair
    index = pq_index.build_global(base, ivf.Params(8, 300, 3), pq.Params(8, 16, 300, 3))
    shard = sharded.owner(F.col("list_id"), 8, 3)
    assert recall(pq_index.search_shards(index, q, K, 8, 900, 50, shard), truth, q) == 1.0
    narrow = recall(pq_index.search_shards(index, q, K, 8, 20, K, shard, thread_p=3), truth, q)
    assert narrow <= recall(pq_index.search_shards(index, q, K, 8, 200, 50, shard), truth, q)


def test_recall(spark):
    q = spark.createDataFrame([(0,), (1,), (2,)], "qid long")
    truth = spark.createDataFrame([(i, r, 10 * i + r) for i in range(3) for r in (1, 2, 3)], "qid long, rank int, id long")
    found = spark.createDataFrame([(0, 1), (0, 2), (0, 2), (1, 13)], "qid long, id long")
    got = {r.qid: r.recall for r in evaluate.recall_by_query(found, truth, q, 2).collect()}
    assert got == {0: 1.0, 1: 0.0, 2: 0.0}
    assert [r.qid for r in evaluate.evaluated(q, 1, 1).collect()] == [1]
    with pytest.raises(ValueError):
        evaluate.sweep([], lambda v: found, truth, q, 2)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_searches_encode_nothing(pair):
    """Codes are made once, at build: a search has one kernel over the codes, and its vectors come from the table."""
    rows, base, q, truth = pair
    flat = pq.build(base, pq.Params(8, 16, 300, 2))
    lists = pq_index.build_local(base, ivf.Params(8, 300, 2), pq.Params(8, 16, 300, 2))
    for found in (pq.search(flat, q, K, 60), pq_index.search(lists, q, K, 3, 60)):
        plan = plan_of(found)
        assert plan.count("MapInArrow") == 1 and "code" in plan
    assert "PartitionFilters: [" in plan_of(pq_index.search(lists, q.limit(1), K, 2, 60))


def test_blocks_one_after_the_other(spark, pair, monkeypatch):
    """Several blocks of a query set give what one gives."""
    from lodestar.operators import queries

    rows, base, q, truth = pair
    index = pq.build(base, pq.Params(8, 16, 300, 2))
    one = [sorted(map(tuple, f.collect())) for f in (exact.knn(base, q, K), pq.search(index, q, K, 60))]
    small = queries.over_blocks
    monkeypatch.setattr(exact, "over_blocks", lambda q, f: small(q, f, most=300))
    monkeypatch.setattr(pq, "over_blocks", lambda q, f: small(q, f, most=300))
    assert [sorted(map(tuple, f.collect())) for f in (exact.knn(base, q, K), pq.search(index, q, K, 60))] == one


def test_profiles(pair):
    rows, base, q, truth = pair
    got = {r.phase: r for r in pq.profile(pq.build(base, pq.Params(8, 16, 300, 2)), q, K, 60).collect()}
    assert {p: r.rows for p, r in got.items()} == {"tables": 18 * 8 * 16, "scan": 18 * 900, "candidates": 18 * 60, "output": 18 * K}
    assert all(r.seconds > 0 for r in got.values())
    index = pq_index.build_global(base, ivf.Params(8, 300, 2), pq.Params(8, 16, 300, 2))
    shards = pq_index.profile_shards(index, q, K, 8, 60, 20, sharded.owner(F.col("list_id"), 8, 3)).collect()
    assert sum(r.scanned for r in shards) == 18 * 900 and sum(r.returned for r in shards) == 18 * K
    assert all(r.returned <= r.passed <= 18 * 20 and r.passed <= r.candidates <= 18 * 60 for r in shards)


def test_sweep_with_times(pair):
    rows, base, q, truth = pair
    index = ivf.build(base, ivf.Params(8, 300, 2))
    got = evaluate.sweep_times((1, 8), lambda n: ivf.search(index, q, K, n), truth, q, K, "nprobe").collect()
    assert [r.nprobe for r in got] == [1, 8] and got[1].recall == 1.0 and all(r.average_latency_us > 0 for r in got)
