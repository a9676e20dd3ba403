import os
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestar.llm import licenses

from .conftest import prose


def brute(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places = []
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in places}))


def test_words_of_bytes():
    r = random.Random(4)
    for _ in range(3000):
        text = "".join(chr(r.choice([*range(0, 128), 0xE9, 0x130, 0x212A, 0x1F600])) for _ in range(30))
        assert len(licenses.words_of(text.encode())) == brute(text)[0]


def test_places_equal_brute_force(spark, docs, rows, empty, clashing):
    r = random.Random(7)
    words = ["gnu", "General", "PUBLIC", "license", "apache", "mit", "cc", "by", "x", "-", "cc-by", "License,"]
    more = [(1000 + i, " ".join(r.choice(words) for _ in range(40)), "en", "s", 0) for i in range(150)]
    more += [(2000, prose(1, 3000) + " Released under the MIT License.", "en", "s", 0), (2001, "mit license " * 5000, "en", "s", 0)]
    more += [more[0], (1000, "apache license", "en", "s", 0)]
    df = docs.unionByName(spark.createDataFrame(more, docs.schema))
    got = sorted(((x.doc_id, x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) for x in licenses.scan(df).collect()), key=repr)
    assert got == sorted(((x[0], *brute(x[1])) for x in rows + more), key=repr)
    assert licenses.scan(clashing).count() == len(rows) and licenses.scan(empty).count() == 0


def labels_of(text, templates, slack=3, share=0.9):
    """Labels and the best score, by comparing words with words: no hashes, no votes table."""
    words, out = licenses.words_of((text or "").encode()), {}
    k = licenses.K
    for label, t in templates:
        own = licenses.words_of(t.encode())
        m, places = len(own), {}
        for p in range(len(words) - k + 1):
            for q in range(m - k + 1):
                if words[p : p + k] == own[q : q + k]:
                    places.setdefault(p - q, set()).add((p, q))
        groups, apart = [], min(max(slack, m // 20), m // 2)
        for d in sorted(places):
            if not groups or d - groups[-1][-1] > apart:
                groups.append([])
            groups[-1].append(d)
        for g in groups:
            for run in [g, *(g[i : i + n] for i in range(len(g)) for n in range(1, licenses.JOINED + 1))]:
                hits = set().union(*(places[d] for d in run))
                held = {q + i for _, q in hits for i in range(k)}
                long = max(p for p, _ in hits) + k - min(p for p, _ in hits)
                score = 2 * min(len(held), long) / (m + long)
                if score >= share and (m >= licenses.EXACT or score == 1):
                    out[label] = max(out.get(label, 0), score)
    return out


def scanned(spark, texts, **how):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r for r in sorted(licenses.scan(df, **how).collect(), key=lambda r: r.doc_id)]


def test_spans_by_votes(spark):
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    edited = notice.replace("hereby granted", "hereby now granted").replace("any person", "every person")
    cases = {1: ("mit-text", notice), 2: ("mit-text", edited), 3: ("apache-2.0,apache", "Licensed under the Apache License, Version 2.0."), 4: ("", "permission to copy a person's software"), 5: ("cc-by,cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."), 6: ("gpl,gpl-3.0", "This work is licensed under the GNU General Public License, version 3.")}
    df = spark.createDataFrame([(k, prose(k, 50) + " " + v + " " + prose(k + 50, 30)) for k, (_, v) in cases.items()], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    for k, (labels, _) in cases.items():
        assert set(got[k].labels.split(",")) == set(labels.split(",")), (k, got[k])
        assert 0 <= got[k].score <= 1
    assert got[2].score < 1 and got[4].score == 0


def test_repeated_grams_count_once(spark):
    """However often a template's k-gram stands in a text, it is one; words in between lower the score."""
    texts = ["under the " * 30 + "the license", "released under the " * 20, "under the mit " * 9, "Released under the MIT License. " * 3, "released under the mit license " + "under the " * 40]
    got = scanned(spark, texts)
    assert [r.labels for r in got] == ["", "", "", "mit,mit-notice", "mit,mit-notice"] and [r.score for r in got] == [0.0, 0.0, 0.0, 1.0, 1.0]


def test_labels_equal_brute_force(spark):
    """Edited, shuffled and repeated templates, in whole and in part."""
    r, templates = random.Random(9), licenses.default_templates()
    texts = [None, "", "the"]
    for label, t in templates:
        words = licenses.words_of(t.encode())
        words = [w.decode() for w in words]
        for edits in (0, 1, 3, 8):
            own = list(words)
            for _ in range(edits):
                at = r.randrange(len(own))
                own[at : at + r.choice((0, 1, 2))] = r.choice(([], ["new"], ["some", "more"], own[:2]))
            cut = r.randrange(0, max(1, len(own) // 3))
            texts.append(" ".join(["x", *own[cut:], "y", *own[: r.randrange(len(own))]]))
    got = scanned(spark, texts)
    for text, row in zip(texts, got):
        want = labels_of(text, templates)
        bases = brute(text)[4].split(",") if brute(text)[4] else []
        assert row.labels == ",".join(sorted({*want, *bases})), (text, row, want)
        assert abs(row.score - max([0.0, *want.values(), *([1.0] if bases else [])])) < 1e-12


def test_templates_of_the_caller(spark):
    """Any number of texts of any length, such as whole licenses; odd rows are no templates."""
    own = [("long", prose(5, 2000)), ("short", "alpha beta gamma"), ("two", "alpha beta"), (None, "alpha beta gamma"), ("none", None), ("short", "alpha beta gamma")]
    table = spark.createDataFrame(own, "label string, text string").withColumn("t_hash", F.lit(1))
    words = prose(5, 2000).split()
    words[700:702] = ["changed"]
    got = scanned(spark, ["x " + " ".join(words) + " y", "Alpha, beta; GAMMA!", "alpha beta", "mit license"], templates=table)
    assert [r.labels for r in got] == ["long", "short", "", "mit"] and 0.99 < got[0].score < 1
    assert [r.labels for r in scanned(spark, ["alpha beta gamma"], templates=table.limit(0))] == [""]


@pytest.mark.skipif(not os.path.exists("/usr/share/common-licenses/GPL-3"), reason="needs the system's license texts")
def test_whole_license_texts(spark):
    names = [n for n in ("Apache-2.0", "GPL-2", "GPL-3", "LGPL-2.1", "LGPL-3", "MPL-1.1", "MPL-2.0", "BSD") if os.path.exists(f"/usr/share/common-licenses/{n}")]
    texts = {}
    for n in names:
        with open(f"/usr/share/common-licenses/{n}", encoding="utf-8", errors="replace") as f:
            texts[n] = f.read()
    table = spark.createDataFrame(list(texts.items()), "label string, text string")
    got = scanned(spark, [prose(i, 300) + "\n" + t + "\n" + prose(i + 9, 200) for i, t in enumerate(texts.values())], templates=table)
    for name, row in zip(texts, got):
        assert name in row.labels.split(",") and row.score == 1.0
