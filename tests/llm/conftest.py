import pytest

WORDS = "the river runs under old stone bridges while quiet birds watch slow boats carry grain toward distant harbor towns every autumn morning".split()


def prose(seed: int, n: int) -> str:
    """Made-up sentences of n words in lines."""
    import random

    r = random.Random(seed)
    out = []
    for i in range(n):
        word = r.choice(WORDS) + r.choice(("", "", "ly", "s", str(seed)[:1]))
        out.append(word.capitalize() if i % 12 == 0 else word)
        if i % 12 == 11:
            out[-1] += ".\n" if i % 36 == 35 else "."
    return " ".join(out).replace("\n ", "\n")


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text, lang, source, n_chars) with every odd case: nulls, empty and long texts, repeated rows."""
    out = [(i, prose(i, 40 + 7 * i), "en", f"src{i % 3}") for i in range(12)]
    out += [
        (100, None, None, None),
        (101, "", "en", "src0"),
        (102, " \t\n\x0b\x0c\r ", "en", ""),
        (103, prose(5, 30_000), "fr", "src1"),
        (104, prose(3, 61), "en", "src2"),
        (104, prose(3, 61), "en", "src2"),
        (None, prose(77, 50), "de", "src0"),
        (None, None, "de", None),
        (105, "é ü 👍🏽   x\x1cy İSTANBUL \x00 ﬁ", "tr", "src1"),
    ]
    return [(*r, None if r[1] is None else len(r[1])) for r in out]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same with columns named like what operators return or use inside."""
    from pyspark.sql import functions as F

    names = ("size", "fp", "component", "point", "shard", "n_words", "kept", "label", "host", "path", "template", "spans", "ids", "n_tokens", "words", "value", "before", "turns", "segments", "media", "feature", "target", "taken", "id", "pos")
    return docs.select("*", *[F.lit(1).alias(n) for n in names])
