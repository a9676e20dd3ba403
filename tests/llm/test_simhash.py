import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestar.llm import components, simhash

from .conftest import prose


def brute_fingerprint(text, width=4):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    grams = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reachable(values, radius):
    """Components by brute force: the class of each position."""
    n, of = len(values), list(range(len(values)))

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for i in range(n):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                of[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_fingerprints_equal_brute_force(docs, rows, empty, clashing):
    want = sorted(((r[0], brute_fingerprint(r[1])) for r in rows), key=repr)
    for df in (docs, clashing):
        got = [(r.doc_id, int.from_bytes(r.fp, "big")) for r in simhash.fingerprints(df).collect()]
        assert sorted(got, key=repr) == want
    assert simhash.fingerprints(empty).count() == 0


def test_components_equal_brute_force(docs, rows, empty):
    got = {(r.doc_id, bytes(r.fp)): r.component for r in simhash.near_duplicates(docs).collect()}
    values = [brute_fingerprint(r[1]) for r in rows]
    classes = reachable(values, 4)
    for r, v, c in zip(rows, values, classes):
        ids = [x[0] for x, y in zip(rows, classes) if y == c and x[0] is not None]
        assert got[r[0], v.to_bytes(8, "big")] == (min(ids) if ids else None)
    assert simhash.near_duplicates(docs).count() == len(rows)
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("shard", [None, 64, 3])
def test_no_link_is_lost_in_any_sharding(spark, shard):
    """Random points, a dense cluster and chains; small shards force boundaries, visits and salts."""
    r = random.Random(4)
    points = {r.getrandbits(64) for _ in range(300)}
    centre = r.getrandbits(64)
    points |= {centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))) for _ in range(200)}
    at = r.getrandbits(64)
    for b in range(0, 60, 3):
        points.add(at)
        at ^= 0b111 << b
    values = sorted(points)
    df = spark.createDataFrame([(v.to_bytes(8, "big"),) for v in values], "point binary")
    edges = simhash.links(df, 4, shard=shard)
    for e in edges.collect():
        assert (int.from_bytes(e.a, "big") ^ int.from_bytes(e.b, "big")).bit_count() <= 64
    roots = {int.from_bytes(x.node, "big"): int.from_bytes(x.root, "big") for x in components.connected(edges, "a", "b").collect()}
    classes = reachable(values, 4)
    first = {}
    for v, c in zip(values, classes):
        first.setdefault(c, v)
    assert all(roots.get(v, v) == first[c] for v, c in zip(values, classes))


def test_cells_of_a_crowded_shard_are_bounded(spark):
    """Points that agree in a part can't be cut by its tree: a grid deals them, and no cell holds more than a few shares."""
    r = random.Random(6)
    values = sorted({r.getrandbits(43) for _ in range(600)})  # equal in the last of three parts
    df = spark.createDataFrame([(v.to_bytes(8, "big"),) for v in values], "point binary")
    plan = simhash.links(df, 4, shard=10)
    roots = {int.from_bytes(x.node, "big"): int.from_bytes(x.root, "big") for x in components.connected(plan, "a", "b").collect()}
    classes, first = reachable(values, 4), {}
    for v, c in zip(values, classes):
        first.setdefault(c, v)
    assert all(roots.get(v, v) == first[c] for v, c in zip(values, classes))


def test_forest_between_homes_and_seekers():
    """The four cells of a grid of two link what one shard links."""
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 2**64, 40, dtype=np.uint64)
    points = np.unique(np.concatenate([centre, centre ^ np.uint64(1), centre ^ np.uint64(6)]))[:, None]
    part, everyone = simhash.parts_of(1, 3, 1)[0], np.ones(len(points), bool)
    classes = lambda pairs: reachable_by(len(points), pairs)
    whole = list(zip(*simhash.forest(points, everyone, part, 4)))
    own = np.arange(len(points)) % 2
    cells = [pair for i in (0, 1) for j in (0, 1) for pair in zip(*simhash.forest(points, own == i, part, 4, seek=own == j))]
    assert classes(whole) == classes(cells)


def reachable_by(n, pairs):
    of = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            of[a] = of[b] = min(of[a], of[b])
    return of


def test_filter_holds_all_tags(spark):
    r = random.Random(1)
    tags = [r.getrandbits(64) - 2**63 for _ in range(5000)]
    held = simhash._filter_of(spark.createDataFrame([(t,) for t in tags], "tag long"))
    test = lambda t: held[(t % (8 * len(held))) >> 3] >> ((t % (8 * len(held))) & 7) & 1
    assert all(test(t) for t in tags) and sum(test(r.getrandbits(64) - 2**63) for _ in range(5000)) < 1000
    assert not simhash._filter_of(spark.createDataFrame([], "tag long")).any()


def test_triangle_bounds_prune():
    rng = np.random.default_rng(3)
    points = rng.integers(0, 2**64, (4000, 1), dtype=np.uint64)
    part = simhash.parts_of(1, 3, 1)[0]
    tree = simhash.grow(points[:1000], part, 64, [0])
    out = []
    simhash.route(tree, points, np.arange(len(points)), np.ones(len(points), bool), part, out)
    homes = sum(int(h.sum()) for _, _, h in out)
    visits = sum(len(a) for _, a, _ in out)
    assert homes == len(points) and visits < 0.5 * len(points) * len(out)


def test_near_copies_from_a_similarity_of_eight_tenths(spark):
    r = random.Random(9)
    rows, pairs = [], []
    for i in range(60):
        words = prose(1000 + i, 300).split()
        rows.append((2 * i, " ".join(words)))
        changed = list(words)
        for at in r.sample(range(len(words)), 4):
            changed[at] = "other"
        rows.append((2 * i + 1, " ".join(changed)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.component for x in simhash.similar(df).collect()}
    caught = sum(got[2 * i] == got[2 * i + 1] for i in range(60))
    assert caught >= 0.9 * 60
    assert len(set(got.values())) >= 60  # and nothing else is linked


def test_every_link_has_a_similarity_of_eight_tenths(spark):
    """A family of one template at about 0.7 stays whole; a copy of a member at 0.8 and more goes."""
    r = random.Random(21)
    base = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(80):
        words = list(base)
        for at in range(5 + i % 5, 300, 27):
            words[at] = f"own{i}x{at}"
        rows.append((i, " ".join(words)))
    for i in range(0, 80, 4):
        words = rows[i][1].split()
        for at in r.sample(range(300), 3):
            words[at] = f"copy{i}x{at}"
        rows.append((1000 + i, " ".join(words)))
    shingles = {i: {tuple(w[k : k + 5]) for w in [t.split()] for k in range(len(w) - 4)} for i, t in rows}
    alike = lambda i, j: len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j])
    got = {x.doc_id: x.component for x in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for c in set(got.values()):
        members = {i for i in got if got[i] == c}
        reached, front = {c}, {c}
        while front:
            front = {j for j in members - reached if any(alike(i, j) for i in front)}
            reached |= front
        assert reached == members
    assert all(got[i] == i for i in range(80))
    assert sum(got[1000 + i] == i for i in range(0, 80, 4)) >= 19


def test_keep_one(spark, docs, rows, empty, clashing):
    kept = simhash.keep_one(docs).collect()
    component = {}
    for r in simhash.similar(docs.withColumn("row", F.struct("doc_id", "text")), "row").collect():
        component[r.row.doc_id, r.row.text] = r.component
    assert sorted(Counter(component[r.doc_id, r.text] for r in kept).values()) == [1] * len(set(component.values()))
    ids = [r.doc_id for r in kept]
    assert 100 in ids and 101 not in ids and 102 not in ids  # all without a word are copies of one another
    assert ids.count(None) == 1 and ids.count(3) == 1 and ids.count(104) == 0  # a null id of its own stays, a copy goes
    assert simhash.keep_one(clashing).columns == clashing.columns
    two = spark.createDataFrame([(None, prose(1, 60)), (None, prose(2, 60)), (None, prose(2, 60)), (5, prose(1, 60))], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.text) for r in simhash.keep_one(two).collect()) == sorted([(5, prose(1, 60)), (-1, prose(2, 60))])
    assert simhash.keep_one(empty).count() == 0
    odd = docs.select(F.col("doc_id").alias("key"), F.col("text").alias("own"), *[F.lit(i).alias(n) for i, n in enumerate(("__key", "__keep", "keep", "fp", "a.b"))])
    out = simhash.keep_one(odd, "key", "own")
    assert out.columns == odd.columns and out.count() == len(kept)


def test_heavy_fingerprints_are_dealt(spark, docs, rows, monkeypatch):
    """A fingerprint of many rows is joined in several places, with the same result."""
    more = docs.unionByName(docs.where("doc_id = 3").crossJoin(spark.range(100)).drop("id"))
    want = sorted(map(repr, simhash.near_duplicates(more).collect()))
    monkeypatch.setattr(simhash, "HEAVY_ROWS", 3)
    assert sorted(map(repr, simhash.near_duplicates(more).collect())) == want and len(want) == len(rows) + 100


def test_components_of_long_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(200)]
    star = [(1000, 1001 + i) for i in range(300)]
    df = spark.createDataFrame(path + star + [(7, 7), (None, 3)], "a long, b long")
    got = dict(map(tuple, components.connected(df, "a", "b").collect()))
    assert all(got[i] == 0 for i in range(201)) and all(got[1000 + i] == 1000 for i in range(301))
    none = spark.createDataFrame([], "a long, b long")
    assert components.connected(none, "a", "b").count() == 0


def test_no_link_of_eight_tenths_is_lost(spark, monkeypatch):
    """Texts of five and of four shingles, just 0.8 alike, whose fingerprints often differ in over 80 bits, among texts that share a frequent passage."""
    monkeypatch.setattr(simhash, "ORDER_TEXTS", 64, raising=False)
    rows = []
    for i in range(200):
        words = [f"w{i}x{k}" for k in range(9)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[1:]))]
    passage = [f"often{k}" for k in range(12)]
    rows += [(1000 + i, " ".join([*passage, *[f"own{i}x{k}" for k in range(8)]])) for i in range(100)]
    got = {x.doc_id: x.component for x in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[2 * i] == got[2 * i + 1] == 2 * i for i in range(200))
    assert all(got[1000 + i] == 1000 + i for i in range(100))


def test_prefixes_meet():
    """Of any two sets with 80 percent in common, the prefixes share a shingle, whatever the counts; the order is rare ones first."""
    rng = np.random.default_rng(8)
    for n in (1, 2, 5, 9, 40, 300):
        for _ in range(50):
            own = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            out = int(rng.integers(0, n // 9 + 1))
            other = np.unique(np.concatenate([own[rng.permutation(len(own))[out:]], rng.integers(0, 2**64, out, dtype=np.uint64)]))
            if 100 * len(np.intersect1d(own, other)) < 80 * len(np.union1d(own, other)):
                continue
            known = np.unique(rng.choice(own.view(np.int64), max(1, n // 2)))
            counts = rng.integers(2, 9, len(known))
            a, b = (simhash.prefix(x, known, counts, 80) for x in (own, other))
            assert a[0] == len(own) and np.intersect1d(a[1:], b[1:]).size
            assert len(a) - 1 == len(own) - -(-80 * len(own) // 100) + 1
    assert len(simhash.prefix(np.empty(0, np.uint64), known, counts, 80)) == 1


def test_shingles_of_one_text_are_not_joined(spark):
    """Of the prefixes, almost only what several texts share is left for the join, with its place; no shared shingle goes."""
    rows = [(i, f"own{i} " + prose(i, 200)) for i in range(100)]
    rows += [(1000 + i, " ".join([*(f"both{i}x{k}" for k in range(40)), f"end{j}"])) for i in range(10) for j in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    points = simhash.marked(df, "doc_id", "text", 5, 6).select(F.col("fp").alias("point"), "tag")
    every, by_tag = np.empty(0, np.int64), {}
    for _, text in rows:
        own = np.unique(simhash.shingles(text.encode(), 5)).view(np.int64)
        by_tag[simhash._tag(text.encode())] = own
        every = np.concatenate([every, own])
    values, counts = np.unique(every, return_counts=True)
    order = (values[counts > 1], counts[counts > 1])
    firsts = {tag: simhash.prefix(own, *order, 80) for tag, own in by_tag.items()}
    held = Counter(int(x) for first in firsts.values() for x in first[1:])
    want = {(tag, int(first[0]), at, int(x)) for tag, first in firsts.items() for at, x in enumerate(first[1:]) if held[int(x)] > 1}
    got = {tuple(r) for r in simhash.meeting(df, "text", points, 5, 80).select("tag", "size", "place", "shingle").collect()}
    assert want and want <= got <= {(tag, int(first[0]), at, int(x)) for tag, first in firsts.items() for at, x in enumerate(first[1:])}
    assert len(got) - len(want) < 0.2 * (sum(held.values()) - len(want))


def test_bitmaps_bound_what_sets_share():
    """Sets with 80 percent in common always could have it, whatever their sizes; unrelated ones of any size could not."""
    rng = np.random.default_rng(11)
    draw = lambda n: np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
    assert simhash.could_hold(simhash.sketch(draw(0)), simhash.sketch(draw(0)), 80)
    for n in (1, 2, 5, 9, 40, 63, 64, 65, 300, 5000):
        for _ in range(20):
            own = draw(n)
            kept = own[rng.permutation(n)[: n - int(rng.integers(0, n // 5 + 1))]]
            other = np.unique(np.concatenate([kept, draw(int(rng.integers(0, n // 9 + 1)))]))
            share = 100 * len(np.intersect1d(own, other)) >= 80 * len(np.union1d(own, other))
            assert not share or simhash.could_hold(simhash.sketch(own), simhash.sketch(other), 80)
        if n >= 40:
            assert not any(simhash.could_hold(simhash.sketch(draw(n)), simhash.sketch(draw(n)), 80) for _ in range(20))


def test_sets_are_fetched_only_where_bounds_leave_them(spark, monkeypatch):
    """Texts that share a passage by chance are not compared in full, of any length; those of 0.8 and more are, and are linked."""
    monkeypatch.setattr(simhash, "ORDER_TEXTS", 1)
    rows, fetched = [], []
    for i in range(60):
        long = 2500 if i % 6 == 0 else 300
        passage = [f"both{i}x{k}" for k in range(30)]
        rows += [(2 * i + j, " ".join([*passage, *(f"own{i}x{j}x{k}" for k in range(long))])) for j in range(2)]
    for i in range(40):
        words = [f"near{i}x{k}" for k in range(9)]
        rows += [(1000 + 2 * i, " ".join(words)), (1001 + 2 * i, " ".join(words[1:]))]
    compare = simhash.alike
    monkeypatch.setattr(simhash, "alike", lambda edges, sets, percent: fetched.append(edges.count()) or compare(edges, sets, percent))
    got = {x.doc_id: x.component for x in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == i for i in range(120))
    assert all(got[1000 + 2 * i] == got[1001 + 2 * i] == 1000 + 2 * i for i in range(40))
    assert sum(fetched) <= 45
