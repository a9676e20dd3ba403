"""Quality rules, line first: lines that fail a rule go, then documents that lost too much go.

A text (null: empty) is cut at ``\\n``. Each line with a word is held against three families of rules, in this order:

* punctuation: many symbol characters, or many stacked marks such as ``!!``;
* navigation: many separators such as ``|`` between few words, or only menu words;
* boilerplate: a legal or subscription phrase in a short line, the same line seen before in the text, or few different
  words in many. The share of different words falls with length in any text, so a longer line is judged by windows of
  ``line_distinct_window`` words, all of them.

Failing lines are removed and the others stay as they are. A document is rejected if it has fewer than ``min_words``
words, if more than ``max_repeat`` of its words stand in repeated five-word windows, or if the removed lines hold more
than ``max_lost`` of the characters of its words. All counts are of one text, so a repeated row has the same result
each time, and an empty table gives an empty one. Texts are read whole; memory is in proportion to the longest text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

_SPACES = b" \t\n\v\f\r"
_INNER_BYTES = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"

# Menu words and boilerplate phrases of English, German, French and Spanish, with A-Z in lower case.
MENU_WORDS = tuple(w.encode() for w in (
    "about", "archive", "back", "blog", "categories", "contact", "faq", "help", "home", "login", "logout", "menu", "more",
    "next", "previous", "register", "search", "share", "sitemap", "top",
    "abmelden", "anmelden", "hilfe", "impressum", "kontakt", "mehr", "nach", "oben", "startseite", "suche", "teilen",
    "weiter", "zurück",
    "accueil", "aide", "connexion", "haut", "partager", "plan", "précédent", "recherche", "retour", "suivant",
    "anterior", "arriba", "ayuda", "buscar", "compartir", "contacto", "inicio", "siguiente", "volver",
))
BOILERPLATE = tuple(w.encode() for w in (
    "accept cookies", "all rights reserved", "click here", "cookie policy", "enable javascript", "privacy policy",
    "read more", "sign up for", "subscribe to", "terms of service", "terms of use",
    "alle rechte vorbehalten", "cookies akzeptieren", "datenschutzerklärung", "hier klicken", "newsletter abonnieren",
    "accepter les cookies", "cliquez ici", "conditions générales", "lire la suite", "politique de confidentialité", "tous droits réservés",
    "aceptar cookies", "haga clic aquí", "leer más", "política de privacidad", "términos de uso", "todos los derechos reservados",
))

_STACKED = re.compile(rb"[!?]{2,}")
_GUILLEMET = "\u00bb".encode()


@dataclass(frozen=True)
class Rules:
    """Thresholds, in numbers of words and in percent: of the words' characters (lost, symbols) or of the words; and the words
    and phrases (UTF-8, with A-Z in lower case) that tell menus and boilerplate."""

    min_words: int = 10
    max_repeat: int = 20
    max_lost: int = 50
    line_symbols: int = 10
    line_stacked: int = 30
    line_separators: int = 20
    line_distinct: int = 30
    line_distinct_words: int = 10
    line_distinct_window: int = 500
    boilerplate_words: int = 12
    menu_words: tuple[bytes, ...] = MENU_WORDS
    boilerplate: tuple[bytes, ...] = BOILERPLATE


def code_points(text: bytes) -> int:
    """Code points outside white space in UTF-8."""
    return len(text.translate(None, _SPACES + _INNER_BYTES))


def symbols(text: bytes) -> int:
    return len(text) - len(text.translate(None, _SYMBOLS))


def _joined(key: np.ndarray, keys: int, other: np.ndarray, others: int) -> tuple[np.ndarray, int]:
    """A number for each pair, equal where both are equal."""
    if keys * others >= 1 << 62:
        key = np.unique(key, return_inverse=True)[1]
        keys = int(key.max()) + 1
    return key * others + other, keys * others


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words that stand in a window of ``width`` words found at two or more places."""
    n = len(words)
    if n <= width:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    key, keys = ids[: n - width + 1], len(seen)
    for i in range(1, width):
        key, keys = _joined(key, keys, ids[i : n - width + 1 + i], len(seen))
    order = np.argsort(key, kind="stable")
    same = np.diff(key[order]) == 0
    if not same.any():
        return 0
    twice = np.zeros(len(key) + 1, bool)
    twice[order[:-1][same]] = True
    twice[order[1:][same]] = True
    steps = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + width, -1)
    return int((np.cumsum(steps)[:n] > 0).sum())


def separators(line: bytes, words: list[bytes]) -> int:
    """Vertical bars and guillemets, and angle brackets that stand alone."""
    return line.count(b"|") + line.count(_GUILLEMET) + words.count(b"<") + words.count(b">")


def few_different(words: list[bytes], rules: Rules) -> bool:
    """Whether under ``line_distinct`` percent of the words are different, in the line and on average over its windows.

    Windows follow each other, and the last one ends with the line, so all are full. A shorter line is one window.
    """
    n, width = len(words), rules.line_distinct_window
    if 100 * len(set(words)) >= rules.line_distinct * n:
        return False
    if n <= width:
        return True
    starts = [*range(0, n - width, width), n - width]
    return 100 * sum(len(set(words[i : i + width])) for i in starts) < rules.line_distinct * width * len(starts)


def line_fails(line: bytes, words: list[bytes], rules: Rules) -> str:
    """The family of the first rule that a line with words fails, or an empty string."""
    n = len(words)
    bars = n > 1 and 100 * separators(line, words) > rules.line_separators * n
    if n > 1 and 100 * symbols(line) > rules.line_symbols * code_points(line):
        return "navigation" if bars else "punctuation"
    if (b"!" in line or b"?" in line) and 100 * len(_STACKED.findall(line)) > rules.line_stacked * n:
        return "punctuation"
    if bars:
        return "navigation"
    if n <= rules.boilerplate_words:
        lower = line.lower()
        if all(w.strip(b".,:;!?>") in rules.menu_words for w in lower.split()):
            return "navigation"
        if any(x in lower for x in rules.boilerplate):
            return "boilerplate"
    if n >= rules.line_distinct_words and few_different(words, rules):
        return "boilerplate"
    return ""


def judge(text: bytes, rules: Rules = Rules()) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lost_chars, clean text."""
    words = text.split()
    n, chars = len(words), code_points(text)
    lines, seen, kept, with_words, lost = text.split(b"\n"), set(), [], 0, 0
    for line in lines:
        own = line.split()
        if not own:
            kept.append(line)
            continue
        with_words += 1
        if line in seen:
            why = "boilerplate"
        else:
            seen.add(line)
            why = line_fails(line, own, rules)
        if why:
            lost += code_points(line)
        else:
            kept.append(line)
    repeat = repeated_words(words)
    failed = n < rules.min_words or 100 * repeat > rules.max_repeat * n
    return n, chars, symbols(text), with_words - len(seen), repeat, failed, not failed and 100 * lost <= rules.max_lost * chars, lost, b"\n".join(kept)


_COLUMNS = [("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()), ("base_failed", T.BooleanType()), ("kept", T.BooleanType()), ("lost_chars", T.LongType()), ("clean_text", T.StringType())]


def assess(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules(), with_text: bool = True) -> DataFrame:
    """The counts and the verdict for each row, and with ``with_text`` what is left of its text. One pass, no shuffle."""
    columns = _COLUMNS if with_text else _COLUMNS[:-1]

    def start():
        def run(texts):
            rows = [judge(t, rules) for t in texts]
            values = [list(v) for v in zip(*rows)] if rows else [[] for _ in _COLUMNS]
            if with_text:
                values[-1] = [v.decode("utf-8", "replace") for v in values[-1]]
            return values[: len(columns)]

        return run

    return common.map_texts(df, id_col, text_col, T.StructType([T.StructField(n, t) for n, t in columns]), start)


def keep_clean(df: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", rules: Rules = Rules()) -> DataFrame:
    """The rows of ``df`` that pass, with their cleaned texts; ``chars_col`` (if there is one) is counted again.

    All other columns stay, whatever their names. A null text is empty and so has too few words.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    import pyarrow as pa

    schema, arrow = df.schema, to_arrow_schema(df.schema)
    at = df.columns.index(text_col)
    count = df.columns.index(chars_col) if chars_col in df.columns else None

    def run(batches):
        for batch in batches:
            texts = batch.column(at).cast(pa.binary())
            for where in common.slices(texts):
                part = batch.slice(*where)
                rows = [judge(t or b"", rules) for t in texts.slice(*where).to_pylist()]
                keep = [i for i, r in enumerate(rows) if r[6]]
                part = part.take(pa.array(keep, pa.int64()))
                columns = list(part.columns)
                clean = [rows[i][8].decode("utf-8", "replace") for i in keep]
                columns[at] = pa.array(clean, arrow.field(at).type)
                if count is not None:
                    columns[count] = pa.array([len(t) for t in clean], arrow.field(count).type)
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], names=arrow.names)

    return common.bounded(df).mapInArrow(common.resting(run), schema)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    """Counts and verdicts for every document."""
    return assess(common.table(spark, sf_dir, "documents"), with_text=False).withColumn("lost_share", F.col("lost_chars") / F.greatest(F.col("word_chars"), F.lit(1)))
