import hashlib
import random

import numpy as np
import pytest

from lodestar.llm import bpe

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def codec():
    with open(bpe.default_vocabulary(), encoding="utf-8") as f:
        return bpe.Codec(f.read())


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(bpe.default_vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def ids(codec, text):
    return np.frombuffer(codec.encode(text), "<u4").tolist()


def test_equals_the_library(codec, library):
    r = random.Random(3)
    pieces = [" ", "  ", "\n", " \n", "a", "the", "'s", " 't", "1", "12", "é", "<|endoftext|>", "<|endof", "!", "..", "\t", "\u00a0", "\u2003", "\u3000", "世界", "👍🏽", "\x1c", "\x85", "_", "'", "\r\n", "aaaaaaaaaaaaaaaaaaaaaaaaa", "of.\nThis", "\x00"]
    for _ in range(5000):
        text = "".join(r.choice(pieces) for _ in range(r.randint(0, 14)))
        got = ids(codec, text)
        assert got == library.encode(text, add_special_tokens=False).ids, repr(text)
        assert codec.decode(got) == library.decode(got, skip_special_tokens=False)


def test_every_character(codec, library):
    for start in range(0, 0x110000, 64):
        chars = [chr(c) for c in range(start, start + 64) if not 0xD800 <= c < 0xE000]
        text = "".join(f"a{c}b {c}1{c} {c}{c}!x {c} " for c in chars)
        assert ids(codec, text) == library.encode(text, add_special_tokens=False).ids, hex(start)


def test_long_words_take_n_log_n(codec, library):
    r = random.Random(5)
    for text in ("ab" * 40_000, "".join(r.choice("etaoin") for _ in range(60_000)), " " * 50_000, "é" * 20_000):
        assert ids(codec, text) == library.encode(text, add_special_tokens=False).ids


def test_a_small_memory_changes_nothing(codec, library, monkeypatch):
    small = bpe._Memory(codec.codes.make, 3)
    monkeypatch.setattr(codec, "codes", small)
    monkeypatch.setattr(codec, "chunks", bpe._Memory(codec.chunks.make, 3))
    text = "one two three four five, one two six. seven"
    assert ids(codec, text) == library.encode(text, add_special_tokens=False).ids and len(small) <= 3


def test_ids_outside_the_vocabulary(codec):
    with pytest.raises(IndexError):
        codec.decode([10**6])


def test_every_row(docs, rows, empty, clashing, library):
    for df in (docs, clashing):
        got = sorted(map(tuple, bpe.encode(df, with_ids=False).collect()), key=repr)
        want = []
        for r in rows:
            own = library.encode(r[1] or "", add_special_tokens=False).ids
            text = library.decode(own, skip_special_tokens=False)
            want.append((r[0], len(own), hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        assert got == sorted(want, key=repr)
    assert bpe.encode(empty).count() == 0


def test_round_trip_and_columns(docs, rows, clashing):
    made = bpe.encode(docs)
    back = sorted(((r.doc_id, r.text) for r in bpe.decode(made).collect()), key=repr)
    assert back == sorted(((r[0], r[1] or "") for r in rows), key=repr)
    got = bpe.tokenise(clashing)
    assert "text" not in got.columns and len(set(got.columns)) == len(got.columns) and got.count() == len(rows)
