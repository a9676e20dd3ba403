import hashlib
import random
import re
import time

from lodestar.llm import pii

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def brute(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if kind == 1 and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == 2 and not (14 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == 3 and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_spans_equal_the_patterns():
    r = random.Random(2)
    pieces = ["a", "b.c", "@", "@d.e", ".", "-", "_", " ", "+", "(", ")", "1", "23", "4111 1111 1111 1111", "+1 (555) 123-4567", "1.2.3.4", "256", "0", "é", "\n", "٣"]
    for _ in range(20_000):
        text = "".join(r.choice(pieces) for _ in range(r.randint(0, 12)))
        assert pii.base_spans(text) == brute(text), repr(text)


def test_long_runs_are_linear():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" * 100_000, "a@" * 100_000, "1 " * 100_000):
        pii.find(text, pii.train())


def test_labelled_sentences_held_out():
    weights = pii.train()
    hit = wrong = missed = 0
    for text, spans in pii.sentences(300, seed=99):
        got, want = set(pii.best(text, pii.tokens(text, 0, len(text)), weights)), set(spans)
        hit, wrong, missed = hit + len(got & want), wrong + len(got - want), missed + len(want - got)
    assert hit / (hit + wrong) > 0.95 and hit / (hit + missed) > 0.95


def test_the_field_adds_what_patterns_miss():
    weights = pii.train()
    for text, kind, piece in (
        ("write to jane.doe (at) example (dot) org today", 0, "jane.doe (at) example (dot) org"),
        ("cards 7536784127813050 4845168114407329 here", 2, "4845168114407329"),
        ("call (415) 555-1234 now", 3, "(415) 555-1234"),
    ):
        base, spans = pii.find(text, weights)
        assert (text.index(piece), text.index(piece) + len(piece), kind) in spans, text
        assert set(base) <= set(spans)
    for text in ("built on 2024-01-02 at 12:30", "order 12345 version 1.2.3", "plain words only", "the 1500 birds"):
        assert pii.find(text, weights)[1] == [], text


def test_local_search_equals_search_over_the_whole_text():
    """The stretches round marks give what dynamic programming over all tokens gives."""
    weights, r = pii.train(), random.Random(8)
    for _ in range(60):
        parts = [s for s, _ in pii.sentences(3, seed=r.randint(0, 10**6))]
        text = (" " + "word " * r.randint(0, 60)).join(parts)
        base = pii.base_spans(text)
        whole = [s for s in pii.best(text, pii.tokens(text, 0, len(text)), weights) if not any(a < s[1] and s[0] < b for a, b, _ in base)]
        assert pii.find(text, weights)[1] == sorted(base + whole, key=lambda s: (s[0], s[2]))


def test_texts_without_spaces(spark):
    """As above, in texts of long words, other scripts and marks; and in time that grows no faster than the text."""
    weights, r = pii.train(), random.Random(4)
    pieces = ["字" * 30, "漢字、", "ab", "x" * 130, "12", "3", "-", "@", ".", "(at)", "[dot]", "+1", "٣", "_", " ", "mail", "4111111111111111", "415-555-1234", "card"]
    for _ in range(400):
        text = "".join(r.choice(pieces) for _ in range(r.randint(1, 25)))
        base = pii.base_spans(text)
        whole = [s for s in pii.best(text, pii.tokens(text, 0, len(text)), weights) if not any(a < s[1] and s[0] < b for a, b, _ in base)]
        assert pii.find(text, weights)[1] == sorted(base + whole, key=lambda s: (s[0], s[2])), text
        ends = [x for a, b in pii.stretches(text) for x in (a, b)]
        assert ends == sorted(set(ends))  # no two of them meet
    took = []
    for n in (1000, 4000):
        text = ("字" * 39 + "1") * n
        start = time.process_time()
        pii.find(text, weights)
        took.append(time.process_time() - start)
    assert took[1] < 8 * took[0] + 0.2


def segmentations(n, by_end, j):
    """Every way to cut the first j tokens into candidates and single tokens."""
    if j == 0:
        yield []
    for i, kind, features in by_end[j]:
        for rest in segmentations(n, by_end, i):
            yield [*rest, (i, j, kind, features)]


def test_best_of_all_segmentations():
    """Dynamic programming finds the greatest score there is, by enumeration of all segmentations."""
    r, texts = random.Random(12), ["4111 1111 1111 1111", "a (at) b.c", "1.2.3.4 5", "x +1 415 555 1234", "card 4111111111111111 12"]
    texts += ["".join(r.choice(["1.2", "34", " ", "-", "a", "@b.c", "+4", "5555555"]) for _ in range(5)) for _ in range(150)]
    for text in texts:
        weights = dict(pii.train()) if r.random() < 0.5 else {f: r.uniform(-2, 2) for f in pii.train()}
        toks = pii.tokens(text, 0, len(text))
        by_end = pii._lattice(text, toks)

        def score(cut):
            kinds = [pii.OUT, *(k for _, _, k, _ in cut)]
            return sum(pii._score(weights, f) + weights.get(pii._move(a, k), 0.0) for a, (_, _, k, f) in zip(kinds, cut))

        if len(toks) > 12:
            continue
        every = list(segmentations(len(toks), by_end, len(toks)))
        top = max(map(score, every))
        got = {(a, b, k) for a, b, k in pii.best(text, toks, weights)}
        same = [c for c in every if {(toks[i][0], toks[j - 1][1], k) for i, j, k, _ in c if k != pii.OUT} == got]
        if all(k == pii.OUT for ends in by_end for _, k, _ in ends):
            assert not got
        else:
            assert same and max(map(score, same)) >= top - 1e-9, text


def test_every_row(docs, rows, empty, clashing, spark):
    extra = spark.createDataFrame([(500, "mail a.b@c.org or 10.0.0.1, card 4111-1111-1111-1111, tel +1 (555) 123-4567", "en", "s", 0)], docs.schema)
    got = {r.doc_id: r for r in pii.scan(docs.unionByName(extra)).collect()}
    assert [got[500][f"n_{k}"] for k in pii.KINDS] == [1, 1, 1, 1]
    base = brute(extra.first().text)
    assert got[500].base_sha256 == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, b, k in base).encode()).hexdigest()
    assert got[100].spans == "" and got[101].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.scan(clashing).count() == len(rows) and pii.scan(empty).count() == 0
    masked = {r.doc_id: r.text for r in pii.mask(docs.unionByName(extra)).collect()}
    assert masked[500] == "mail [EMAIL] or [IP], card [CARD], tel [PHONE]" and masked[100] is None and masked[101] == ""
    assert pii.mask(clashing).columns == clashing.columns


def test_masks_of_overlapping_spans():
    assert pii.masked("x +4111 1111 1111 1111 y", [(2, 22, 3), (3, 22, 2)]) == "x [PHONE] y"
