"""Queries with SQL equal it on tables of more rows than the small ones, where parameters that follow the rows once took over."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lodestar.operators import exact
from lodestar.operators import queries as query_sets
from lodestar.operators.ivf import index as ivf
from lodestar.operators.ivf import pq_index
from lodestar.operators.quant import pq as codes
from lodestar.plans import catalogue

from .test_oracle import QUERIES, SQL, canonical

ROWS = 4_500


@pytest.fixture(scope="module")
def larger(tmp_path_factory):
    """Random unit vectors, more than ``SMALL`` of them, every tenth near another."""
    rng = np.random.default_rng(5)
    rows = rng.standard_normal((ROWS, 64))
    rows[9::10] = rows[::10] + 0.05 * rng.standard_normal((ROWS // 10, 64))
    rows = (rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.float32)
    folder = tmp_path_factory.mktemp("larger")
    vecs = pa.FixedSizeListArray.from_arrays(rows.reshape(-1), 64).cast(pa.list_(pa.float32()))
    pq.write_table(pa.table({"vec_id": np.arange(ROWS), "embedding": vecs, "label": (np.arange(ROWS) % 10).astype(np.int32)}), folder / "embeddings.parquet")
    return str(folder)


def equals_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet')")
    got, cursor = QUERIES[name](spark, folder), con.execute(SQL[name])
    return canonical(got.collect(), got.columns) == canonical(cursor.fetchall(), [c[0] for c in cursor.description])


def test_sample_beyond_small_tables(spark, larger):
    assert ROWS > catalogue.SMALL and equals_sql(spark, larger, "train_sample_ids")


@pytest.mark.parametrize("name", ["ivf_assign", "ivf_given_probes", "ivf_list_stats", "ivf_local_p", "ivf_probe", "ivf_search", "kmeans_centroids", "recall_by_nprobe"])
def test_lists_beyond_small_tables(spark, larger, name):
    assert equals_sql(spark, larger, name)


@pytest.mark.parametrize("name", ["ivfpq_candidates", "ivfpq_global_search", "mpi_ivfpq_search", "pq_encode_uniform", "pq_search", "pq_topp"])
def test_codes_beyond_small_tables(spark, larger, name):
    assert equals_sql(spark, larger, name)


@pytest.mark.parametrize("name", ["pq_sized_search", "ivfpq_sized_search"])
def test_parameters_that_follow_the_rows(spark, larger, name):
    """The indexes without SQL keep a recall of 0.9."""
    right = {(r.qid, r.id) for r in QUERIES["flat_ip"](spark, larger).collect()}
    found = {(r.qid, r.id) for r in QUERIES[name](spark, larger).collect()}
    assert len(found) == len(right) and len(found & right) >= 0.9 * len(right)


@pytest.mark.parametrize("name", ["hoh_search", "ivf_hnsw_search", "hnsw_search"])
def test_graphs_beyond_small_tables(spark, larger, name):
    assert equals_sql(spark, larger, name)


def test_codes_leave_no_neighbour_out(spark, larger):
    """The search by lists and codes finds each query's true nearest: a recall of 1, beyond small tables too."""
    right = {(r.qid, r.rank, r.id) for r in QUERIES["flat_ip"](spark, larger).collect()}
    assert {(r.qid, r.rank, r.id) for r in QUERIES["ivfpq_global_search"](spark, larger).collect()} == right


@pytest.mark.parametrize("rounds", [0, 1])
def test_bounds_of_lists_and_codes(spark, rounds):
    """Vectors of very unequal lengths, many of them copies, in tight clusters: bounds prune, and ties go by the id."""
    rng = np.random.default_rng(3)
    rows = np.repeat(rng.standard_normal((40, 8)), 30, axis=0) * rng.choice([0.1, 1, 9], (1200, 1)) + 1e-3 * rng.standard_normal((1200, 8))
    rows[1::4] = rows[::4]
    base = query_sets.from_numpy(spark, rows)
    index = pq_index.build_global(base, ivf.Params(lists=8, train_size=128, iters=2), codes.Params(parts=4, codes=16, train_size=128, iters=1), rounds)
    q = query_sets.of_table(base, 20)
    got = {tuple(r) for r in pq_index.search_all(index, q, 10).collect()}
    assert got == {tuple(r) for r in exact.knn(base, q, 10).collect()}
    few = base.where("id < 7")
    assert pq_index.search_all(pq_index.build_global(few, ivf.Params(2), codes.Params(4, 4)), query_sets.of_table(few, 2), 10).count() == 4 * 7
