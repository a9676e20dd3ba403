"""Each stage held to what its operator says of each row alone, and the whole to its promises."""

from collections import Counter

import pytest

import corpus_pipeline
from lodestar.llm import bpe, common, mix, pii, quality, simhash

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The rows before the first stage and after each."""
    docs = [common.table(spark, DATA, "documents")]
    for _, stage in corpus_pipeline.STAGES:
        docs.append(common.cut(stage(spark, docs[-1], DATA)))
    return [d.collect() for d in docs]


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "pii", "mix", "bpe"]
    columns = list(stages[0][0].asDict())
    assert all(list(s[0].asDict()) == columns for s in stages[1:-1])


def test_quality(stages):
    want = {}
    for r in stages[0]:
        verdict = quality.judge((r.text or "").encode())
        if verdict[6]:
            want[r.doc_id] = verdict[8].decode()
    assert {r.doc_id: r.text for r in stages[1]} == want


def test_near_duplicates_keep_one_of_each(stages):
    before, after = {r.doc_id: r.text for r in stages[1]}, {r.doc_id: r.text for r in stages[2]}
    assert set(after) <= set(before) and all(before[i] == t for i, t in after.items())
    assert len(set(after.values())) == len(after)  # no exact copies left
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))}
    kept = [shingles(t) for t in after.values()]
    for i in set(before) - set(after):  # and nothing went without a like
        own = shingles(before[i])
        assert max(len(own & k) / len(own | k) for k in kept) > 0.5


def test_near_copies_of_eight_tenths_go(spark):
    """Of all pairs with a similarity of 0.8 and more in the cleaned texts, found by brute force, at least 0.99 are linked."""
    docs = corpus_pipeline.clean(spark, common.table(spark, "/root/testdata/sf0.1", "documents"), "")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    grams, holders = {}, {}
    for i, t in rows:
        w = t.lower().split()
        grams[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    for i in sorted(grams):
        for g in grams[i]:
            holders.setdefault(g, []).append(i)
    pairs = set()
    for i, own in grams.items():  # a pair at 0.8 shares one of the rarest fifth and one more of either's shingles
        rare = sorted(own, key=lambda g: (len(holders[g]), g))[: len(own) // 5 + 1]
        for j in {j for g in rare for j in holders[g] if j < i}:
            if 10 * len(own & grams[j]) >= 8 * len(own | grams[j]):
                pairs.add((j, i))
    got = {r.doc_id: r.component for r in simhash.similar(docs).collect()}
    assert len(pairs) > 500 and sum(got[a] == got[b] for a, b in pairs) >= 0.99 * len(pairs)


def test_pii_is_masked(stages):
    weights = pii.train()
    assert {r.doc_id: r.text for r in stages[3]} == {r.doc_id: pii.masked(r.text, pii.find(r.text, weights)[1]) for r in stages[2]}


def test_mix_repeats_rows(spark, stages):
    docs = spark.createDataFrame(stages[3])
    want = {r.doc_id: len(r.shards) for r in mix.shares(docs).collect()}
    assert Counter(r.doc_id for r in stages[4]) == Counter({i: n for i, n in want.items() if n})


def test_tokens(stages):
    with open(bpe.default_vocabulary(), encoding="utf-8") as f:
        codec = bpe.Codec(f.read())
    texts = {r.doc_id: r.text for r in stages[3]}
    assert len(stages[5]) == len(stages[4])
    for r in stages[5]:
        assert codec.decode(r.ids) == texts[r.doc_id] and r.n_tokens == len(r.ids)


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, DATA)
    assert sorted((r.doc_id, r.ids_sha256) for r in got.collect()) == sorted((r.doc_id, r.ids_sha256) for r in stages[5])
