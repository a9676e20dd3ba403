"""License scans by diagonal voting over rolling word k-gram hashes.

A-Z is lower-cased and words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. The words of a text are hashed, and each k-gram by a
polynomial that rolls over the words' hashes. Spark joins all of a text's k-gram hashes with those of the templates; where a
hash is one of a template's, the words of the k-gram come along and must be equal, so a hit is never a collision. A hit at
word p of a text and word q of a template votes for the diagonal p - q. Neighbouring diagonals of one template in one
text (``slack`` apart or less, a 20th of the template's words if that is more: words put in or left out) are merged.

A span is verified by its words: of what ``JOINED`` or fewer neighbouring diagonals, or all merged ones, hold, M are the
template's words that stand there, each counted once however often it is repeated, and L the words from the first to the last
hit. The score is 2 M / (words of the template + L): 1 for a copy, less for each word put in, left out or replaced. A
template's label is given from a score of ``share`` on; one of fewer than ``EXACT`` words, where a single word tells licenses
apart, must stand as it is.

Base phrases are templates too, with k-grams of ``BASE_K`` words. A phrase stands at word p just if all its k-grams vote for
diagonal p: then its words stand there one after the other. Places may overlap.

Templates are ``PASSAGES`` and ``LICENSES``, or a table (label, text) of the caller's, of any number of texts of any length; up to
``BROADCAST_GRAMS`` k-grams are broadcast, more are joined by a shuffle. A null label or text is no template, nor is one of fewer
than ``K`` words.

A text takes part by id and hash of the text: rows with equal id and text have equal results, and rows with equal ids but
different texts, or with null ids, are kept apart. A null text is empty and has no words. Texts are read whole. Only hits
are shuffled; those of one text and one template meet in one row, so memory is in proportion to the longest text. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

BASE_K, K, JOINED, EXACT = 2, 3, 4, 16
BROADCAST_GRAMS = 1 << 20

# The base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Passages of public licenses, and the labels of their texts.
PASSAGES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache-2.0",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis": "apache-2.0",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit-text",
    "released under the mit license": "mit-notice",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl-notice",
    "licensed under the gnu general public license version 3": "gpl-3.0",
    "licensed under the gnu lesser general public license": "lgpl",
    "licensed under the mozilla public license version 2 0": "mpl-2.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "licensed under a creative commons attribution": "cc-notice",
}
_BSD_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution. """
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission. """
_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
# Whole texts of public licenses and notices, without their copyright lines, by label.
LICENSES = {
    "mit-full": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
        and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS
        PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
        HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
        ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc-full": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
        PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
        OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
        CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
        CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
        SOFTWARE.""",
    "bsd-2-full": _BSD_CONDITIONS + _BSD_DISCLAIMER,
    "bsd-3-full": _BSD_CONDITIONS + _BSD_NAMES + _BSD_DISCLAIMER,
    "zlib-full": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for
        any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
        software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated
        but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as
        being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
        required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
        BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
        language governing permissions and limitations under the License.""",
    "gpl-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
        later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
        the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
        details. You should have received a copy of the GNU General Public License along with this program.""",
}

_NOT_WORDS = bytes(b if chr(b).isalnum() or b >= 0x80 else 0x20 for b in range(256))
_BASE = 0x9E3779B97F4A7C15  # odd, so that the polynomial loses no bit


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(_NOT_WORDS).split()


def gram_hashes(words: list[bytes], k: int) -> np.ndarray:
    """A signed 64-bit hash of each k-gram: a polynomial in ``_BASE`` that rolls over the words' hashes."""
    import xxhash

    n = len(words) - k + 1
    if n < 1:
        return np.empty(0, np.int64)
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out = own[:n].copy()
    for i in range(1, k):
        out = out * np.uint64(_BASE) + own[i : n + i]
    return out.view(np.int64)


def default_templates() -> list[tuple[str, str]]:
    return [(label, text) for text, label in PASSAGES.items()] + list(LICENSES.items())


_TEMPLATE = "t_hash long, t_gram string, template long, q int, words int, label string"


def _template_rows(texts: list[tuple[str, str]], k: int) -> list[tuple]:
    out = []
    for number, (label, text) in enumerate(texts):
        words = words_of(text.encode())
        out += [(int(h), b" ".join(words[q : q + k]).decode(), number, q, len(words), label) for q, h in enumerate(gram_hashes(words, k))]
    return out


def template_grams(templates: DataFrame) -> DataFrame:
    """The k-grams of a caller's templates (label, text), each numbered by a hash of both."""
    rows = templates.where("label IS NOT NULL AND text IS NOT NULL").select(F.col("label").cast("string"), F.col("text").cast("string")).distinct()
    rows = rows.select(F.xxhash64("label", "text").alias("template"), "label", "text")
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T._parse_datatype_string(_TEMPLATE)
    names, arrow = schema.names, to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for number, label, text in zip(*(c.to_pylist() for c in batch.columns)):
                made = [(h, g, number, *rest) for h, g, _, *rest in _template_rows([(label, text)], K)]
                yield pa.RecordBatch.from_pylist([dict(zip(names, m)) for m in made], schema=arrow)

    return common.bounded(rows).mapInArrow(run, schema)


_GRAM = "id_hash long, pos int, base_hash long, hash long, base_gram string, gram string, n_words long"


def grams(df: DataFrame, id_col: str, text_col: str, known_base: np.ndarray, known: np.ndarray | None) -> DataFrame:
    """For each row one with its number of words (pos -1), then one for each word: the hashes of the k-grams that start there.

    The words of a k-gram come along where its hash is among ``known`` (sorted), or everywhere if that is None.
    """
    own = df.select(F.col(id_col).alias(common.ID), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(common.TEXT))
    own = own.withColumn("id_hash", F.xxhash64(common.ID, common.TEXT))
    out = T.StructType([own.schema[common.ID], *T._parse_datatype_string(_GRAM).fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def column(words: list[list[bytes]], k: int, among: np.ndarray | None, rows: int, first: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """Hashes and words of all texts' k-grams, at the places of the rows that they start at."""
        hashes, none, shown = np.zeros(rows, np.int64), np.ones(rows, bool), [None] * rows
        for own_words, start in zip(words, first):
            got = gram_hashes(own_words, k)
            at = slice(start, start + len(got))
            hashes[at], none[at] = got, False
            hit = range(len(got)) if among is None else np.flatnonzero(among[np.searchsorted(among, got).clip(max=len(among) - 1)] == got).tolist() if len(among) else ()
            for i in hit:
                shown[start + i] = b" ".join(own_words[i : i + k])
        return pa.array(hashes, mask=none), pa.array(shown, pa.binary()).cast(pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for start, length in common.slices(texts, 1 << 20):
                words = [words_of(t) for t in texts.slice(start, length).to_pylist()]
                counts = np.array([len(w) for w in words], np.int64)
                sizes = 1 + counts
                row = np.repeat(np.arange(length), sizes)
                begin = np.cumsum(sizes) - sizes
                at = np.arange(len(row)) - np.repeat(begin, sizes) - 1
                base_hash, base_gram = column(words, BASE_K, known_base, len(row), begin + 1)
                hash_, gram = column(words, K, known, len(row), begin + 1)
                take = pa.array(row + start)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(2).take(take), pa.array(at.astype(np.int32)), base_hash, hash_, base_gram, gram, pa.array(np.where(at < 0, counts[row], 0))],
                    schema=arrow,
                )

    return common.bounded(own).mapInArrow(run, out)


def _score(at: Column, low: Column, high: Column) -> Column:
    """Of k-grams at positions ``at`` of the template, from ``low`` to ``high`` in the text: how alike words and template are."""
    held = F.size(F.array_distinct(F.flatten(F.transform(at, lambda q: F.sequence(q, q + (K - 1))))))
    long = high + K - low
    return 2 * F.least(held, long) / (F.col("words") + long)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", slack: int = 3, share: float = 0.9, templates: DataFrame | None = None) -> DataFrame:
    """One row for each of ``df``: words, places of base phrases, base labels, labels of verified spans, best score."""
    spark = df.sparkSession
    base_rows = _template_rows([(label, text) for text, label in PHRASES.items()], BASE_K)
    bases = common.literal_rows(spark, base_rows, _TEMPLATE).select(*[F.col(c).alias(f"base_{c}") for c in T._parse_datatype_string(_TEMPLATE).names])
    if templates is None:
        rows = _template_rows(default_templates(), K)
        own, known, few = common.literal_rows(spark, rows, _TEMPLATE), np.unique([r[0] for r in rows]), True
    else:
        own = common.cut(template_grams(templates))
        few = own.count() <= BROADCAST_GRAMS
        known = np.unique(own.select("t_hash").toArrow().column(0).to_numpy()) if few else None
    hit = (F.col("hash") == F.col("t_hash")) & (F.col("gram") == F.col("t_gram"))
    base_hit = (F.col("base_hash") == F.col("base_t_hash")) & (F.col("base_gram") == F.col("base_t_gram"))
    joined = (
        grams(df, id_col, text_col, np.unique([r[0] for r in base_rows]), known)
        .join(F.broadcast(bases), base_hit, "left")
        .join(F.broadcast(own) if few else own, hit, "left")
    )
    kept = ("template", "q", "words", "label")
    found = common.cut(joined.where("pos < 0 OR template IS NOT NULL OR base_template IS NOT NULL").select(common.ID, "id_hash", "pos", "n_words", *kept, *[f"base_{c}" for c in kept]))
    rows, key = found.where("pos < 0"), [common.ID, "id_hash"]

    # Base phrases: all k-grams on one diagonal.
    diagonal = (F.col("pos") - F.col("base_q")).cast("long")
    places = (
        found.where("base_template IS NOT NULL")
        .groupBy(*key, "base_template", "base_words", F.col("base_label").alias("label"), diagonal.alias("word"))
        .agg(F.count_distinct("base_q").alias("votes"))
        .where(F.col("votes") == F.col("base_words") - (BASE_K - 1))
        .select(*key, "label", F.lit(1.0).alias("score"), "word")
    )

    # Other templates: the hits of one template in one text; those that can't reach the score are left out at once.
    enough = F.col("words") * (share / (2 - share)) - 1e-9
    hits = (
        found.where("template IS NOT NULL")
        .groupBy(*key, *kept[:1], *kept[2:])
        .agg(F.collect_set(F.struct("pos", "q")).alias("hits"))
        .where(F.size(F.array_distinct(F.transform("hits", lambda h: h["q"]))) * K >= enough)
        .select(*key, "template", "words", "label", F.explode("hits").alias("hit"))
    )
    group = [*key, "template", "words", "label"]
    votes = hits.groupBy(*group, (F.col("hit.pos") - F.col("hit.q")).alias("diagonal")).agg(F.collect_set("hit.q").alias("at"), F.min("hit.pos").alias("low"), F.max("hit.pos").alias("high"))
    apart = F.least(F.greatest(F.lit(slack), F.floor(F.col("words") / 20)), F.floor(F.col("words") / 2))
    near = Window.partitionBy(*group).orderBy("diagonal")
    votes = votes.withColumn("new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(near) > apart).cast("int"), F.lit(0)))
    votes = votes.withColumn("span", F.sum("new").over(near.rowsBetween(Window.unboundedPreceding, 0)))
    merged = votes.groupBy(*group, "span").agg(_score(F.flatten(F.collect_list("at")), F.min("low"), F.max("high")).alias("score"))
    runs = []
    for more in range(JOINED):
        frame = Window.partitionBy(*group, "span").orderBy("diagonal").rowsBetween(0, more)
        runs.append(_score(F.flatten(F.collect_list("at").over(frame)), F.min("low").over(frame), F.max("high").over(frame)))
    single = votes.select(*group, "span", F.greatest(*runs).alias("score"))
    spans = (
        merged.unionByName(single)
        .groupBy(*group)
        .agg(F.max("score").alias("score"))
        .where((F.col("score") >= share) & ((F.col("words") >= EXACT) | (F.col("score") == 1)))
        .select(*key, "label", "score", F.lit(None).cast("long").alias("word"))
    )
    by_text = (
        places.unionByName(spans)
        .groupBy(*key)
        .agg(
            F.count("word").alias("n_base"),
            F.min("word").alias("first_word"),
            F.max("word").alias("last_word"),
            F.array_join(F.array_sort(F.collect_set(F.when(F.col("word").isNotNull(), F.col("label")))), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
            F.max("score").alias("score"),
        )
    )
    out = rows.select(F.col(common.ID).alias("__own"), F.col("id_hash").alias("__own_hash"), "n_words")
    out = out.join(by_text, F.col("__own").eqNullSafe(F.col(common.ID)) & (F.col("__own_hash") == F.col("id_hash")), "left")
    return out.select(
        F.col("__own").alias(id_col),
        "n_words",
        F.coalesce("n_base", F.lit(0)).alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op7_licenses(spark, sf_dir: str) -> DataFrame:
    """Licenses in every document."""
    return scan(common.table(spark, sf_dir, "documents"))
