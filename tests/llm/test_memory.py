"""What workers hold beside an executor's heap."""

import os

from lodestar.llm import bpe, common, simhash


def test_no_second_workers_for_the_drivers_rows(spark):
    """Rows of the driver are read by Spark itself: as tuples they come out of an RDD that Python workers of their own unpickle."""
    rows = [("a", 1, [1, 2], None), ("b", 2, [], 0.5)]
    df = common.own_rows(spark, rows, "key string, block int, shards array<int>, rest double")
    assert [tuple(r) for r in df.collect()] == rows
    assert df.dtypes == [("key", "string"), ("block", "int"), ("shards", "array<int>"), ("rest", "double")]
    assert common.own_rows(spark, [], "tree int, shard int, salts int").collect() == []
    assert "ExistingRDD" not in df._jdf.queryExecution().toString()
    points = spark.createDataFrame([(bytes([i]) * 8,) for i in range(64)], "point binary")
    points = common.cut(points)
    assert "ExistingRDD" not in simhash.links(points)._jdf.queryExecution().toString()


def test_words_go_with_another_operators_task():
    """A process remembers words from task to task of the encoder only, and encodes alike afterwards."""
    with open(bpe.default_vocabulary(), encoding="utf-8") as f:
        source = f.read()
    text = "some words to keep 12,345 \u00e9"

    def encode(batches):
        for _ in batches:
            yield bpe.codec(source).encode(text)

    seen = lambda keep: list(common.resting(lambda batches: [bpe.codec.cache_info().currsize for _ in batches], keep)(iter([0])))
    want = list(common.resting(encode, keep=True)(iter([0, 1])))
    assert seen(True) == [1] and seen(False) == [0] and seen(False) == [0]
    assert list(common.resting(encode, keep=True)(iter([0, 1]))) == want and want[0]
    common.forget()


def test_a_worker_that_forgets_gives_its_memory_back():
    """Words remembered are held by their codec in cycles: they go at once, and their pages with them."""
    held = lambda: int(open("/proc/self/statm").read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6
    with open(bpe.default_vocabulary(), encoding="utf-8") as f:
        source = f.read()
    common.keeps()
    before, codec = held(), bpe.codec(source)
    for i in range(150_000):
        codec.encode(f"a{i}b word{i}")
    grown = held() - before
    del codec
    common.forget()
    common.trim()
    assert not bpe.codec.cache_info().currsize and grown > 30 and held() - before < grown / 2, (grown, held() - before)
