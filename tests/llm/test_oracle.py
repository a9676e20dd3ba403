"""The SQL of this package's queries gives their rows, on the driver's tables and on odd ones."""

import random

import duckdb
import pytest

from lodestar.llm import registry

from .conftest import prose

DATA = "/root/testdata/sf0.001"
TABLES = "documents pages labels conversations".split()


def same(spark, name, folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')" if folder != DATA else f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = registry.queries()[name](spark, str(folder))
    cursor = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(got.columns)
    want = sorted((tuple(r[columns.index(c)] for c in got.columns) for r in cursor.fetchall()), key=repr)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    return len(want)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, name):
    assert same(spark, name, DATA) > 0


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory, docs):
    """Documents with nulls, long lines and license texts; pages and labels with every odd case."""
    from lodestar.llm import licenses

    from .test_urls import ODD

    folder, r = tmp_path_factory.mktemp("odd"), random.Random(5)
    weights = [1 / (rank + 2.7) for rank in range(6_000)]
    more = [(200 + n, " ".join(f"w{i}" for i in r.choices(range(6_000), weights, k=n)), "en", "s", 0) for n in (499, 500, 501, 1000, 1001, 9_000)]
    more += [(300 + n, " ".join(r.choices(["a", "b", "c", "|", "x!!"], k=n)), "en", "s", 0) for n in (11, 700)]
    more += [(400 + i, prose(i, 40) + "\n" + t + "\nHome | Suche\ncliquez ici\n", "en", "s", 0) for i, (_, t) in enumerate(licenses.default_templates())]
    everything = docs.where("doc_id IS NOT NULL").unionByName(spark.createDataFrame(more, docs.schema)).dropDuplicates(["doc_id"])
    everything.write.parquet(f"{folder}/documents.parquet")
    hosts = [f"h{i}.example.{t}" for i in range(4) for t in ("com", "net")]
    urls = [*ODD, *(f"http://{r.choice(hosts)}/{'/'.join(r.choice(['a', 'b', 'c', '', '12', 'x9y8z7w6', 'k.html']) for _ in range(r.randint(0, 11)))}/{i}" for i in range(400))]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{folder}/pages.parquet")
    labels = [(i, r.choice([0, 1, 1, 1, None]), r.choice([0, 0, 0, 1, None])) for i in range(450) if i % 3]
    spark.createDataFrame(labels + labels[:9], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    turns = [(i % 7 if i % 11 else None, i, r.choice(["user", "assistant", "a:b", None]), r.choice([None, "", "x\\y", "### </turn> :", "é"])) for i in range(90)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql_on_odd_tables(spark, odd, name):
    assert same(spark, name, odd) > 0
