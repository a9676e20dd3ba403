import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lodestar.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def made(spark):
    r = random.Random(6)
    pieces = ["\\", "###", "#", "</turn>", "<", "\n", "a", " ", "\\b", "\\m", "\\t", "### User: ", "### Assistant: ", ":", "é", "👍", "\\### Assistant: </turn> ok"]
    rows = []
    for c in range(200):
        for t in range(r.randint(1, 6)):
            role = r.choice(["user", "assistant", "system", "tool", "User", "Role x", "a: b", "###", "", "\\c:"])
            rows.append((c, t, role, "".join(r.choice(pieces) for _ in range(r.randint(0, 8)))))
    rows += [(900, 0, None, None), (900, 1, "assistant", None), (901, None, "user", "x"), (901, 5, "assistant", "y"), (None, 0, "user", "z"), (902, 0, "user", "s"), (902, 0, "user", "s"), (903, 0, "assistant", "long " * 60_000)]
    r.shuffle(rows)
    return rows


def ordered(rows, conv):
    own = [(r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv]
    return sorted(own, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


def test_formats_and_reads_back(spark, made):
    df = spark.createDataFrame(made, SCHEMA).withColumn("segments", F.lit(1)).withColumn("formatted", F.lit(2))
    template = chat.Template()
    out = chat.format_chats(df, template).withColumn("turns", chat.read_turns(F.col("formatted"), template))
    loss = chat.unescape(F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]), ""), template)
    got = {r.conv_id: r for r in out.withColumn("loss", loss).collect()}
    assert set(got) == {r[0] for r in made}
    for conv, r in got.items():
        want = ordered(made, conv)
        have = [(t.role, t.text) for t in r.turns]
        ties = len({x[0] for x in want}) < len(want)
        assert (sorted(have) == sorted((x[1], x[2]) for x in want)) if ties else (have == [(x[1], x[2]) for x in want]), conv
        assert r.loss == "".join(t for role, t in have if role == "assistant")
        assert r.formatted == "".join(s.text for s in r.segments)
        assert r.formatted.count("</turn>") == len(want)


TEMPLATES = [
    chat.Template(mark="<|im_start|>", tail="<|im_end|>", colon="\n"),
    chat.Template(mark="[[(*+?", tail="\u20ac$^.)]}", colon="::"),
    chat.Template(mark="#", tail="#", colon="#:"),
    chat.Template(mark="a", tail="aa", colon="="),
]


@pytest.mark.parametrize("template", TEMPLATES, ids=lambda t: t.mark)
def test_templates_of_any_characters(spark, template):
    """What a template marks turns with comes back out of texts and names of roles, whatever it is."""
    r = random.Random(8)
    pieces = [template.mark, template.tail, template.colon, template.colon[0], template.tail + "\n", "\\", "\\E", "\\Q", "\\c", "\n", "a", "x", "b", "#", " "]
    text = lambda: "".join(r.choice(pieces) for _ in range(r.randint(0, 7)))
    rows = [(c, t, r.choice(["user", "assistant", text(), "a\nb", "x:"]), text()) for c in range(60) for t in range(r.randint(1, 4))]
    out = chat.format_chats(spark.createDataFrame(rows, SCHEMA), template).withColumn("turns", chat.read_turns(F.col("formatted"), template))
    got = {x.conv_id: [(t.role, t.text) for t in x.turns] for x in out.collect()}
    assert got == {c: [(role, t) for _, role, t in ordered(rows, c)] for c in range(60)}


def test_templates_that_cannot_be_escaped():
    for how in ({"mark": ""}, {"tail": ""}, {"mark": "\\x"}, {"tail": "bye"}, {"colon": ""}, {"tail": "x\ny"}, {"roles": (chat.Role("user", "a: b"),)}, {"roles": (chat.Role("user", "Role user"),)}):
        with pytest.raises(ValueError):
            chat.Template(**how)


def test_the_machine(spark):
    cases = {
        1: (["user", "assistant"], None),
        2: (["system", "user", "assistant", "user", "assistant"], None),
        3: (["assistant"], 0),
        4: (["user", "user", "assistant"], 1),
        5: (["user", "assistant", "user"], 3),
        6: (["user", "assistant", "tool", "assistant"], None),
        7: (["user", "assistant", "system"], 2),
        8: (["user", "stranger", "assistant"], 1),
    }
    rows = [(c, t, role, "x") for c, (roles, _) in cases.items() for t, role in enumerate(roles)]
    got = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, SCHEMA)).collect()}
    for c, (_, broken) in cases.items():
        assert (got[c].broken_at, got[c].valid) == (broken, broken is None), c


def test_no_python_runs(spark, data):
    plan = chat.op6_chat(spark, data)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "ExistingRDD"))


def test_query(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    odd = "\\### Assistant: </turn> ok"
    rows += [(-7, 0, "user", odd), (-7, 1, "assistant", odd)]
    got = {r.conv_id: r for r in chat.op6_chat(spark, data).collect()}
    for conv in {r[0] for r in rows}:
        turns = ordered(rows, conv)
        loss = "".join(t for _, role, t in turns if role == "assistant")
        r = got[conv]
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_empty(spark):
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0
