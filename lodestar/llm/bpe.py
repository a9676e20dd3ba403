"""Byte-level BPE encoding and decoding; the merges of a word are chosen by a segment tree over its pairs' ranks.

A text is cut into words by the vocabulary's pattern, and each word into bytes. The leaves of a segment tree hold, for
each symbol, the rank of its pair with the next one, together with its position; an inner node holds the least of its
``FAN`` children (``min`` of a slice, so the tree is wide and flat). So the root names the leftmost of the lowest-ranked
pairs. After a merge, the pairs on both sides of it get new leaves and their ancestors new values, in logarithmic time,
until the root holds no rank. A word of n bytes takes n log n steps, however long it is. Up to ``FAN`` pairs are one node.

Each worker keeps the codes of words seen so far, up to a fixed number (``CACHE``), until another operator's task; this changes no result. The vocabulary file
is read by the driver (its path is a parameter) and broadcast: about two megabytes, whatever the size of the input.

The strings of special tokens become their ids wherever they stand in a text, as the vocabulary's own library does it.
A null text is empty and has no ids. Rows are encoded one by one: repeated rows repeat their ids.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

CACHE = 300_000
FAN = 16

#: Fixed value: the pattern of byte-level vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_NONE = 1 << 62


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def printable_bytes() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary: itself, or for others the next from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Codec:
    """A vocabulary, ready to encode and decode."""

    def __init__(self, source: str):
        import regex

        spec = json.loads(source)
        model, byte_of = spec["model"], printable_bytes()
        vocab = model["vocab"]
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.tokens: list[bytes] = [b""] * size
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in vocab.items():
            self.tokens[i] = token.encode() if token in added else bytes(byte_of[c] for c in token)
        for token, i in added.items():
            self.tokens[i] = token.encode()
        self.single = [0] * 256
        for char, b in byte_of.items():
            self.single[b] = vocab[char]
        self.ranks: dict[int, int] = {}  # of a pair of ids, in the upper bits
        self.made: list[int] = []  # by rank
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault(vocab[a] << 32 | vocab[b], rank << 32)
            self.made.append(vocab[a + b])
        self.byte_pairs = [self.ranks.get(a << 32 | b, _NONE) for a in self.single for b in self.single]
        self.special = sorted(added, key=len, reverse=True)
        self.special_ids = {t: np.array([i], "<u4").tobytes() for t, i in added.items()}
        self.special_at = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if added else None
        self.words = regex.compile(PATTERN)
        self.letters = regex.compile(r"\p{L}+").fullmatch
        self.odd_space = regex.compile(r"^[\s\x1c-\x1f]|[\s\x1c-\x1f]$| [\s\x1c-\x1f]|[\s\x1c-\x1f] ")
        whole = lambda word: array("I", self.merge(word.encode())).tobytes()
        self.codes = _Memory(whole, CACHE)
        # A word of letters alone is remembered here only, others by their parts too.
        self.chunks = _Memory(lambda chunk: whole(" " + chunk) if self.letters(chunk) else self.pattern_words(" " + chunk), CACHE)

    def merge_leaf(self, word: bytes) -> list[int]:
        """The ids of a word whose pairs fit into one node: its least value is the root, and merged pairs leave the node."""
        single, pairs, ranks, made = self.single, self.byte_pairs, self.ranks, self.made
        ids = [single[b] for b in word]
        node = [pairs[a << 8 | b] for a, b in zip(word, word[1:])]
        while node:
            least = min(node)
            if least >= _NONE:
                break
            i = node.index(least)  # the leftmost
            ids[i : i + 2] = (made[least >> 32],)
            del node[i]
            if i:
                node[i - 1] = ranks.get(ids[i - 1] << 32 | ids[i], _NONE)
            if i < len(node):
                node[i] = ranks.get(ids[i] << 32 | ids[i + 1], _NONE)
        return ids

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word."""
        if len(word) <= FAN + 1:
            return self.merge_leaf(word)
        ids = [self.single[b] for b in word]
        n, pairs, ranks, made = len(word), self.byte_pairs, self.ranks, self.made
        levels = [[pairs[a << 8 | b] | i for i, (a, b) in enumerate(zip(word, word[1:]))]]
        while len(levels[-1]) > FAN:
            below = levels[-1]
            levels.append([min(below[i : i + FAN]) for i in range(0, len(below), FAN)])
        leaves, top = levels[0], levels[-1]
        after, before = list(range(1, n + 2)), list(range(-1, n))
        while True:
            least = min(top, default=_NONE)
            if least >= _NONE:
                return [i for i in ids if i >= 0]
            i = least & 0xFFFFFFFF
            j = after[i]
            ids[i] = made[least >> 32]
            ids[j] = -1
            after[i] = k = after[j]
            before[k] = i
            if j < n - 1:
                leaves[j] = _NONE
            leaves[i] = ranks.get(ids[i] << 32 | ids[k], _NONE) | i if k < n else _NONE
            h = before[i]
            if h >= 0:
                leaves[h] = ranks.get(ids[h] << 32 | ids[i], _NONE) | h
            if top is not leaves:
                touched = {i // FAN, j // FAN, max(h, 0) // FAN}
                for below, above in zip(levels, levels[1:]):
                    for at in touched:
                        if at < len(above):
                            above[at] = min(below[at * FAN : at * FAN + FAN])
                    touched = {at // FAN for at in touched}

    def pattern_words(self, text: str) -> bytes:
        return b"".join(map(self.codes.__getitem__, self.words.findall(text)))

    def plain(self, text: str) -> bytes:
        """The ids of a text without special tokens, as little-endian 32-bit integers.

        A lone space between other characters always starts a word. If there is no other kind of space beside one, the
        text is cut there first and each piece looked up whole.
        """
        if " " not in text or self.odd_space.search(text):
            return self.pattern_words(text)
        first, *rest = text.split(" ")
        return self.pattern_words(first) + b"".join(map(self.chunks.__getitem__, rest))

    def encode(self, text: str) -> bytes:
        if self.special_at is None or not any(t in text for t in self.special):
            return self.plain(text)
        parts = self.special_at.split(text)
        return b"".join(self.special_ids[p] if i % 2 else self.plain(p) for i, p in enumerate(parts))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")


class _Memory(dict):
    """Values made on first use. Beyond ``most``, what was not asked for since the last time goes: a young generation of
    half the size becomes the old one, whose values come back when they are asked for."""

    def __init__(self, make, most):
        self.make, self.half, self.old = make, max(1, most // 2), {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) < 64:
            if len(self) >= self.half:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


@lru_cache(maxsize=2)
def codec(source: str) -> Codec:
    """One codec for a worker process, kept for its later tasks."""
    return Codec(source)


common.KEPT.append(codec.cache_clear)


def _broadcast(spark: SparkSession, vocabulary: str | None):
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def _array(codes: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(c) // 4 for c in codes)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(codes), "<i4")))


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, with_ids: bool = True) -> DataFrame:
    """For each row: n_tokens, the digests of its ids and of the text they decode to, and with ``with_ids`` the ids."""
    source = _broadcast(df.sparkSession, vocabulary)

    def start():
        from hashlib import sha256

        c = codec(source.value)

        def run(texts):
            codes = [c.encode(t.decode("utf-8", "replace")) for t in texts]
            decoded = [sha256(c.decode(np.frombuffer(x, "<u4").tolist()).encode()).hexdigest() for x in codes]
            out = [[len(x) // 4 for x in codes], [sha256(x).hexdigest() for x in codes], decoded]
            return [*out, _array(codes)] if with_ids else out

        return run

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return common.map_texts(df, id_col, text_col, T.StructType(fields + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids), start, keep=True)


def tokenise(df: DataFrame, text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``df`` without its text, with n_tokens, ids_sha256, decoded_sha256 and ids; columns of these names are replaced."""
    from pyspark.sql.pandas.types import to_arrow_schema

    new = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    kept = [f for f in df.schema.fields if f.name != text_col and f.name not in new.names]
    rows = df.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(common.TEXT), *[F.col(f"`{f.name}`") for f in kept])
    out = T.StructType([*kept, *new.fields])
    arrow, source = to_arrow_schema(out), _broadcast(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        c = codec(source.value)
        for batch in batches:
            texts = batch.column(0).cast(pa.binary())
            for where in common.slices(texts):
                codes = [c.encode(t.decode("utf-8", "replace")) for t in texts.slice(*where).to_pylist()]
                made = [
                    pa.array([len(x) // 4 for x in codes], pa.int64()),
                    pa.array([sha256(x).hexdigest() for x in codes]),
                    pa.array([sha256(c.decode(np.frombuffer(x, "<u4").tolist()).encode()).hexdigest() for x in codes]),
                    _array(codes),
                ]
                part = batch.slice(*where)
                columns = [*part.columns[1:], *made]
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(columns, arrow)], names=arrow.names)

    return common.bounded(rows).mapInArrow(common.resting(run, keep=True), out)


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """(id, text) from ids; null ids give a null text, ids outside the vocabulary raise."""
    source = _broadcast(df.sparkSession, vocabulary)
    own = df.select(F.col(id_col).alias(common.ID), F.col(ids_col).cast("array<int>").alias("__ids"))
    out = T.StructType([T.StructField(id_col, own.schema[0].dataType), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(source.value)
        for batch in batches:
            texts = [None if x is None else c.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return own.mapInArrow(common.resting(run, keep=True), out)


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document."""
    return encode(common.table(spark, sf_dir, "documents"), with_ids=False)
