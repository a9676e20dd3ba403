import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from lodestar.llm import mix

from .conftest import prose


def count(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_targets():
    assert mix.targets([10, 10, 10], [5, 2, 1]) == [18.75, 7.5, 3.75]
    out = mix.targets([1, 100, 99], [5, 2, 1])  # the first stops at three times its size
    assert out[0] == 3 and abs(sum(out) - 200) < 1e-9 and abs(out[1] / out[2] - 2) < 1e-9
    assert mix.targets([0, 0], [5, 2]) == [0, 0] and mix.targets([], []) == []
    assert sum(mix.targets([5, 0], [5, 2])) == 5


def test_splitting_tree_is_exact_and_even():
    rng = np.random.default_rng(1)
    quotas = np.array([100, 37, 0, 5])
    for shards in (1, 3, 8, 200):
        got = mix.split(quotas, shards, rng)
        assert (got.sum(0) == quotas).all() and (got >= 0).all()
        assert got.sum(1).max() - got.sum(1).min() <= 1


def test_splitting_tree_is_hypergeometric():
    """The first of two shards has, over many draws, the mean and the variance of a draw without replacement."""
    rng = np.random.default_rng(2)
    first = np.array([mix.split(np.array([60, 40]), 2, rng)[0][0] for _ in range(4000)])
    n, k, m = 100, 60, 50
    assert abs(first.mean() - m * k / n) < 0.3
    assert abs(first.var() - m * k / n * (1 - k / n) * (n - m) / (n - 1)) < 0.6


def test_blocks_of_a_pass_are_disjoint():
    s = mix.Source("a", 1000, 2300.0, words={b: 10 for b in range(100)})
    mix.draw(s, np.random.default_rng(0))
    assert sorted(s.draws[:100]) == list(range(100)) == sorted(s.draws[100:200])
    rest = s.draws[200:-1]
    assert len(set(rest)) == len(rest) and not set(rest) & set(s.pool)
    assert sum(s.words[b] for b in rest) + s.rest_words == 300


def levels(sizes, weights, cap=3):
    """Targets by another way: one level for all, at which min(cap * size, level * weight) sum up to the sizes' sum."""
    total = sum(sizes)
    low, high = 0.0, 1.0 + max([cap * s / w for s, w in zip(sizes, weights)], default=0)
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(cap * s, level * w) for s, w in zip(sizes, weights)) < total else (low, level)
    return [min(cap * s, high * w) for s, w in zip(sizes, weights)]


def test_targets_are_levels():
    import random

    r = random.Random(3)
    for _ in range(300):
        sizes = [r.choice((0, 1, 5, 100, r.randint(1, 10**6))) for _ in range(r.randint(1, 12))]
        weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
        assert np.allclose(mix.targets(sizes, weights), levels(sizes, weights), rtol=1e-9, atol=1e-6)


def check(got, rows):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += count(r[1])
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, levels([sizes[n] for n in names], [(5, 2, 1)[i % 3] for i in range(len(names))])))
    assert sum(r["size"] for r in got) == sum(sizes.values())
    assert all(r.taken <= 3 * r["size"] and r.taken == r["size"] * len(r.shards) for r in got)
    return sizes, want


def test_shares(docs, rows, empty, clashing):
    for df in (docs, clashing):
        got = mix.shares(df).collect()
        assert len(got) == len(rows)
        sizes, want = check(got, rows)
        assert sorted(((r.doc_id, r["size"]) for r in got), key=repr) == sorted(((r[0], count(r[1])) for r in rows), key=repr)
        assert {(r.source_size, round(r.target, 3)) for r in got} == {(sizes[s], round(want[s], 3)) for s in sizes}
    again = mix.shares(docs).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again)) or sorted((repr(r.doc_id), r.taken) for r in again) == sorted((repr(r.doc_id), r.taken) for r in got)
    assert mix.shares(empty).count() == 0


def test_taken_words_come_near_targets(spark):
    rows = [(i, prose(i, 20 + i % 50), f"s{0 if i % 3 else i % 7}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix.shares(df, shard_words=1000).join(df.select("doc_id", "source"), "doc_id")
    for r in got.groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).collect():
        assert abs(r.taken - r.target) <= 0.01 * r.target
    load = got.select(F.explode("shards").alias("s"), "size").groupBy("s").agg(F.sum("size").alias("n")).collect()
    words = [r.n for r in load]
    assert len(words) > 20 and max(words) < 2 * np.mean(words) and min(words) > 0.4 * np.mean(words)


def test_mixed_rows_are_the_shares(docs, clashing):
    want = {(r.doc_id, r["size"]): len(r.shards) for r in mix.shares(docs).collect() if r.doc_id != 104}
    got = defaultdict(int)
    for r in mix.mix(docs).collect():
        if r.doc_id != 104:
            got[r.doc_id, count(r.text)] += 1
    assert dict(got) == {k: v for k, v in want.items() if v}
    assert mix.mix(clashing).columns == clashing.columns


def test_columns_of_any_name(docs, rows):
    """Whatever the caller's columns are called, they come back as they were."""
    names = ("own", "copy", "shard", "shards", "known", "given", "few", "hash", "key", "fine", "block", "rest", "places", "source_size", "__taken", "__copy", "__shards", "a.b", "OWN_")
    odd = docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    got = mix.mix(odd, shard_words=500)
    assert got.columns == odd.columns and all(tuple(r)[-len(names) :] == tuple(range(len(names))) for r in got.collect())
    assert sorted(map(repr, mix.shares(odd).collect())) == sorted(map(repr, mix.shares(docs).collect()))
    renamed = docs.select(F.col("doc_id").alias("own"), F.col("text").alias("key"), F.col("source").alias("given.x"))
    assert mix.mix(renamed, "own", "given.x", "key").columns == renamed.columns


def test_joined_and_broadcast_parts_agree(spark, monkeypatch):
    rows = [(i, prose(i, 20 + i % 50), f"s{i % 3}") for i in range(400)] + [(7, prose(1, 900), "s1")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    few = sorted(map(repr, mix.shares(df).collect()))
    monkeypatch.setattr(mix, "BROADCAST_ROWS", 0)
    assert sorted(map(repr, mix.shares(df).collect())) == few
    assert mix.mix(df).count() == sum(len(r.shards) for r in mix.shares(df).collect())
