import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.functions import distance, vectors
from lodestar.operators import exact, topk
from lodestar.operators.queries import blocks, from_numpy


def brute(base, queries, k, metric="ip"):
    dist = np.round(distance.metric(metric).block(base, queries), 6) + 0.0
    return {q: [(int(i), float(dist[i, q])) for i in np.lexsort((np.arange(len(base)), dist[:, q]))[:k]] for q in range(len(queries))}


def found(df):
    out = {}
    for r in df.orderBy("qid", "rank").collect():
        out.setdefault(r.qid, []).append((r.id, r.dist))
    return out


@pytest.fixture(scope="module")
def pair(spark):
    r = np.random.default_rng(5)
    base = r.normal(size=(700, 13)).astype(np.float32)
    base[600:650] = base[:50]  # ties
    queries = base[::70].copy()
    return base, queries, from_numpy(spark, base).repartition(5), from_numpy(spark, queries, id_name="qid", vec_name="qvec")


@pytest.mark.parametrize("metric", ["ip", "l2", "cosine"])
@pytest.mark.parametrize("k", [1, 10, 1000])
def test_equals_brute_force(pair, metric, k):
    base, queries, b, q = pair
    assert found(exact.knn(b, q, k, metric)) == brute(base.astype(float), queries.astype(float), k, metric)


def test_ties_go_to_the_smaller_id(pair):
    _, queries, b, q = pair
    got = found(exact.knn(b, q, 2, "l2"))
    assert got[0] == [(0, 0.0), (600, 0.0)]


def test_queries_in_blocks_change_nothing(pair):
    base, queries, b, q = pair
    many = list(blocks(q, most=3 * 13 * 8))
    assert len(many) > 2 and sum(map(len, many)) == len(queries)


def test_filter_before_search(pair):
    base, queries, b, q = pair
    got = found(exact.knn(b, q, 10, where=F.col("id") % 2 == 0))
    assert all(i % 2 == 0 for rows in got.values() for i, _ in rows) and all(len(rows) == 10 for rows in got.values())
    assert exact.knn(b, q, 10, where=F.lit(False)).count() == 0


def test_local_search_is_exact_if_it_passes_k_on(pair):
    base, queries, b, q = pair
    assert found(exact.knn_local(b, q, 10, F.col("id") % 7, 10)) == brute(base.astype(float), queries.astype(float), 10)


def test_range_search(pair):
    base, queries, b, q = pair
    dist = np.round(distance.l2_block(base.astype(float), queries.astype(float)), 6)
    got = found(exact.within(b, q, 9.0))
    assert {k: len(v) for k, v in got.items()} == {j: int((dist[:, j] <= 9).sum()) for j in range(len(queries))}
    assert all(v[0][1] == 0 for v in got.values())
    assert all(len(v) <= 3 for v in found(exact.within(b, q, 9.0, most=3)).values())
    assert all(len(v) == 4 for v in found(exact.within(b, q, -1.0, least=4)).values())


def test_documents(pair):
    base, queries, b, q = pair
    got = exact.nearest_documents(b.withColumn("doc_id", F.col("id") % 20), q, 5).collect()
    dist = np.round(distance.l2_block(base.astype(float), queries.astype(float)), 6)
    for j in range(len(queries)):
        rows = sorted((r.rank, r.id) for r in got if r.qid == j)
        want, docs = [], set()
        for i in np.lexsort((np.arange(len(base)), dist[:, j])):
            if i % 20 not in docs and len(docs) == 5:
                break
            docs.add(i % 20)
            want.append(int(i))
        assert [i for _, i in rows] == want


def test_changes(pair):
    base, queries, b, q = pair
    gone = exact.without(b, b.where("id < 10"))
    assert gone.count() == 690
    changed = exact.upsert(b, from_numpy(b.sparkSession, np.zeros((2, 13)), np.array([3, 9999])))
    assert changed.count() == 701 and changed.where("id = 3").first().vec == [0.0] * 13
    labels = b.sparkSession.createDataFrame([(1,), (2,)], "id long")
    assert exact.items(b, labels).count() == 2
    with pytest.raises(KeyError):
        exact.items(b, labels, b.where("id = 2").select("id"))
    with pytest.raises(RuntimeError):
        exact.exactly_k(exact.knn(b, q, 3, where=F.col("id") < 2), q, 3)


def test_bad_vectors(spark):
    for rows in ([(1, [1.0, 2.0]), (2, [1.0])], [(1, None)], [(1, [1.0, None])]):
        df = spark.createDataFrame(rows, "id long, vec array<float>")
        with pytest.raises(ValueError):
            vectors.dimension(df)
    assert vectors.dimension(spark.createDataFrame([], "id long, vec array<float>")) == (0, 0)
    with pytest.raises(ValueError):
        from_numpy(spark, np.zeros((2, 2, 2)))
    with pytest.raises(ValueError):
        from_numpy(spark, np.zeros((2, 2)), np.arange(3))
    with pytest.raises(ValueError):
        distance.metric("hamming")


def test_empty_base(spark, pair):
    none = spark.createDataFrame([], "id long, vec array<float>")
    assert exact.knn(none, pair[3], 5).count() == 0


def test_own_metric(spark, pair):
    base, queries, b, q = pair
    own = distance.Metric("l1", None, lambda x, y: np.abs(x[:, None, :] - y[None]).sum(2))
    got = found(exact.knn(b, q, 3, own))
    dist = np.round(np.abs(base[:, None, :].astype(float) - queries[None].astype(float)).sum(2), 6)
    assert got[1] == [(int(i), float(dist[i, 1])) for i in np.lexsort((np.arange(len(base)), dist[:, 1]))[:3]]


def test_columns_equal_blocks(spark, pair):
    base, queries, b, q = pair
    for name in ("ip", "l2", "cosine"):
        m = distance.metric(name)
        row = b.join(q, b.id == q.qid * 70).select("qid", m.column(F.col("qvec"), F.col("vec")).alias("d")).collect()
        want = m.block(base[::70].astype(float), queries.astype(float)).diagonal()
        assert np.allclose([r.d for r in sorted(row)], want, atol=1e-12)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(-3, 3)), max_size=60), st.integers(1, 8), st.integers(1, 9))
def test_bounded_buffers(rows, k, step):
    """Whatever the batches, the buffer holds the k least by (distance, id)."""
    near = topk.Nearest(1, k)
    for at in range(0, len(rows), step):
        part = rows[at : at + step]
        near.add(0, np.array([i for i, _ in part], np.int64), np.array([float(d) for _, d in part]))
    assert list(zip(near.dist[0], near.ids[0])) == sorted((float(d), i) for i, d in rows)[:k]
