import random
import re
from collections import Counter

from lodestar.llm import quality

from .conftest import prose

WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    words = re.findall(WORD, text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_counts_equal_brute_force():
    r = random.Random(1)
    pieces = ["a", "b", "cc", " ", " ", "\n", "\t", "é", "|", "#", "\x1c", " ", "👍"]
    for _ in range(3000):
        text = "".join(r.choice(pieces) for _ in range(r.randint(0, 60)))
        assert quality.judge(text.encode())[:6] == brute(text), repr(text)


def test_repeated_words_with_many_different_words():
    words = [f"w{i}".encode() for i in range(9000)]
    assert quality.repeated_words(words + words[:7]) == 14


def test_every_row_has_a_verdict(docs, rows, empty, clashing):
    for df in (docs, clashing):
        got = sorted(map(tuple, quality.assess(df).drop("clean_text").collect()), key=repr)
        want = sorted(((r[0], *quality.judge((r[1] or "").encode())[:8]) for r in rows), key=repr)
        assert got == want
    assert quality.assess(empty).count() == 0


def test_line_rules():
    good = "The quiet river runs under old stone bridges, and slow boats carry grain."
    for bad in ("AND!! THE!! BOATS!! WENT!! AWAY!!", "one### two$$$ three%%% four&&&", "Home | About | Contact | Login", "menu", "All rights reserved.", "so so so so so so so so so so so so"):
        assert quality.line_fails(bad.encode(), bad.encode().split(), quality.Rules()), bad
    assert not quality.line_fails(good.encode(), good.encode().split(), quality.Rules())
    more = "Harbor towns wake early when morning mist lifts from the fields around them."
    out = quality.judge(f"{good}\nHome | About | Contact | Login\n\n{more}".encode())
    assert out[6] and out[8].decode() == f"{good}\n\n{more}"


def test_long_lines_of_natural_words_stay():
    r = random.Random(12)
    weights = [1 / (rank + 2.7) for rank in range(6_000)]
    for n in (9_000, 20_000):
        words = [f"w{i}" for i in r.choices(range(6_000), weights, k=n)]
        assert 100 * len(set(words)) < 30 * n  # the share over the whole line says nothing
        out = quality.judge(" ".join(words).encode())
        assert not out[5] and out[6] and out[7] == 0
        junk = " ".join(r.choices(words[:60], k=n))
        assert quality.judge(junk.encode())[7] == len(junk.replace(" ", ""))


def test_clean_rows_stay_and_lose_only_lines(docs, rows, empty, clashing):
    good = prose(900, 80)
    df = docs.unionByName(docs.sparkSession.createDataFrame([(7000, good + "\nmenu", "en", "s", 0)], docs.schema))
    kept = {r.doc_id: r for r in quality.keep_clean(df).collect()}
    assert kept[7000].text == good and kept[7000].n_chars == len(good)
    assert quality.keep_clean(clashing).columns == clashing.columns
    assert quality.keep_clean(empty).count() == 0


def test_labelled_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.assess(docs, with_text=False).join(labels, "doc_id").where("NOT base_failed").groupBy("quality", "kept").count().collect()
    right = sum(r["count"] for r in got if bool(r.quality) == r.kept)
    assert right >= 0.97 * sum(r["count"] for r in got)
