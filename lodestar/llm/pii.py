"""Personal data: exact base patterns, and a semi-Markov conditional random field that adds spans.

Base: leftmost, non-overlapping matches of each kind's pattern; an ip with a part over 255, a card without 14 to 19
digits that pass the Luhn sum and a phone without 10 to 15 digits are dropped, without another try inside the match.

Model: a text is cut into tokens (runs of letters or of digits, and single other characters). A segmentation deals the
tokens into entities of up to ``LONGEST`` tokens, and single tokens outside. The features of a segment see the whole span:
how many digits, how they are grouped, the Luhn sum, the marks that join the groups, what touches the span, and
the words before it. Weights are those of greatest conditional likelihood over labelled sentences (made by ``sentences``
from a fixed seed: ``TRAIN_SENTENCES`` of them, a bounded sample), by forward and backward sums over all segmentations.
The best segmentation, found by dynamic programming, decides borders and types together.

A segment without a digit, ``@`` or a bracketed "at" is never a candidate, so far from such marks only single tokens
outside remain: dynamic programming runs over the stretches round the marks, with the same result as over the whole text.
Time is in proportion to the text, whatever is in it, white space or none. An entity of the field has ``LONGEST``
tokens and ``LONGEST_CHARS`` characters at most; longer ones are left to the base patterns.
Spans are in code points, end exclusive. A base span always stays; a span of the model is added if no base span
overlaps it. A null text is empty and has no span. Each row is judged alone: repeated rows repeat their result.
"""

from __future__ import annotations

import math
import random
import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common

KINDS = ("email", "ip", "card", "phone")
OUT = len(KINDS)
LONGEST, LONGEST_CHARS = 20, 80
TRAIN_SENTENCES = 240

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_MARKS = b"0123456789@[({"
_TRIGGER = re.compile(r"[0-9@]+|[\[({] ?(?:at|AT|At) ?[\])}]")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\S")


def digits_of(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str):
    """Leftmost, non-overlapping matches, found from each ``@`` outwards: linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base patterns, by start, then kind."""
    found = [(a, b, 0) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 40:
            d = digits_of(m[0])
            if 14 <= len(d) <= 19 and luhn(d):
                found.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(digits_of(m[0])) <= 15:
                found.append((m.start(), m.end(), 3))
    return sorted(found, key=lambda s: (s[0], s[2]))


# --- segments and their features -------------------------------------------------------------------------------------

# Words that often stand before a kind.
HINTS = {
    "mail": 0, "email": 0, "contact": 0, "write": 0, "ip": 1, "host": 1, "server": 1, "address": 1, "card": 2, "visa": 2,
    "credit": 2, "mastercard": 2, "tel": 3, "phone": 3, "call": 3, "fax": 3, "mobile": 3, "cell": 3,
}
_AT, _DOT = {"at"}, {"dot"}


def tokens(text: str, start: int, end: int) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(text, start, end)]


def _shape(words: list[str]) -> str:
    """Of an email: the words with "at" and "dot" in brackets as signs; empty if it isn't one."""
    out, i = [], 0
    while i < len(words):
        w = words[i]
        if w in "[({" and i + 2 < len(words) and words[i + 2] in "])}" and words[i + 1].lower() in ("at", "dot"):
            out.append("@" if words[i + 1].lower() == "at" else ".")
            i += 3
            continue
        out.append(w)
        i += 1
    if out.count("@") != 1:
        return ""
    at = out.index("@")
    local, domain = out[:at], out[at + 1 :]
    ok = local and domain and all(x.isalnum() or x in "._%+-" for x in local) and all(x.isalnum() or x in ".-" for x in domain)
    if not ok or "." not in domain or not domain[-1].isalpha() or not local[0].isalnum() or domain[0] == ".":
        return ""
    return f"{sum(x == '.' for x in domain)}"


def _numeric(text: str, a: int, b: int, words: list[str]) -> list[tuple[int, list[str]]]:
    span = text[a:b]
    groups = [w for w in words if w.isdigit()]
    joins = {c for c in span if not c.isdigit()}
    digits = "".join(groups)
    n = len(digits)
    out = []
    if 6 <= n <= 19:
        shape = "-".join(str(len(g)) for g in groups) if len(groups) <= 5 else "many"
        marks = "".join(sorted(joins))
        if joins <= set(" -") and n >= 13:
            out.append((2, [f"luhn{luhn(digits)}", f"digits{n}", f"groups{shape}", f"marks{marks}"]))
        if joins <= set("+() .-/") and "+" not in span[1:] and n <= 15:
            out.append((3, [f"digits{n}", f"plus{span[0] == '+'}", f"paren{'(' in joins}", f"groups{min(len(groups), 5)}", f"last{len(groups[-1])}", f"marks{marks if len(marks) < 3 else 'mixed'}"]))
    if joins == {"."} and len(groups) == 4 and span.count(".") == 3 and len(words) == 7:
        small = all(int(g) <= 255 for g in groups if len(g) < 9) and max(map(len, groups)) <= 3
        out.append((1, [f"small{small}", f"lead{any(len(g) > 1 and g[0] == '0' for g in groups)}"]))
    return out


def segments(text: str, toks: list[tuple[int, int, str]]) -> list[list[tuple[int, int, list[str]]]]:
    """By end position j: (start position i, kind, features) of each candidate entity over tokens i..j-1."""
    n, out = len(toks), [[] for _ in range(len(toks) + 1)]
    for i in range(n):
        a, _, first = toks[i]
        numeric = first.isdigit() or first in "+("
        if not numeric and not first.isalnum():
            continue
        before = [t[2].lower() for t in toks[max(0, i - 4) : i]]
        hints = {HINTS[w] for w in before if w in HINTS}
        glued = i > 0 and toks[i - 1][1] == a
        left = "none" if not glued else "word" if before[-1].isalnum() else before[-1]
        seen_at, words, digits = False, [], 0
        for j in range(i + 1, min(n, i + LONGEST) + 1):
            b, last = toks[j - 1][1], toks[j - 1][2]
            if b - a > LONGEST_CHARS:
                break
            words.append(last)
            seen_at = seen_at or last == "@" or (last.lower() == "at" and len(words) > 1 and words[-2] in "[({")
            mail = first.isalnum() and not (j - 1 > i and toks[j - 1][0] - toks[j - 2][1] > 1)
            if numeric:
                gap = j - 1 > i and toks[j - 1][0] - toks[j - 2][1] > 1
                if gap or not (last.isdigit() or last in "+()-./"):
                    numeric = False
                elif last.isdigit():
                    digits += len(last)
                    numeric = digits <= 19
            if not numeric and not mail:
                break
            found = []
            if numeric and last.isdigit():
                found = _numeric(text, a, b, words)
            if mail and seen_at and last.isalnum():
                shape = _shape(words)
                if shape:
                    found.append((0, [f"dots{shape}", f"plain{'@' in words}", f"spaces{' ' in text[a:b]}"]))
            if found:
                tight = j < n and toks[j][0] == b
                right = "none" if not tight else "word" if toks[j][2].isalnum() else toks[j][2]
                more = j + 1 < n and tight and not toks[j][2].isalnum() and toks[j + 1][0] == toks[j][1] and toks[j + 1][2].isalnum()
                for kind, features in found:
                    own = [*features, f"left{left}", f"right{right}", f"more{more}", f"hint{kind in hints}", "is"]
                    out[j].append((i, kind, [f"{KINDS[kind]}:{f}" for f in own]))
    return out


def _outside(word: str) -> list[str]:
    return ["out:digits" if word.isdigit() else "out:at" if word == "@" else "out:word"]


# --- the model -------------------------------------------------------------------------------------------------------


def _lse(values: list[float]) -> float:
    top = max(values, default=-math.inf)
    return top if top == -math.inf else top + math.log(sum(math.exp(v - top) for v in values))


def _score(weights: dict[str, float], features: list[str]) -> float:
    return sum(weights.get(f, 0.0) for f in features)


def _lattice(text: str, toks) -> list[list[tuple[int, int, list[str]]]]:
    """Candidates by end, the single tokens outside with them."""
    by_end = segments(text, toks)
    for j, (_, _, word) in enumerate(toks):
        by_end[j + 1].append((j, OUT, _outside(word)))
    return by_end


def _move(before: int, kind: int) -> str:
    return f"move:{before}:{kind}"


def best(text: str, toks, weights: dict[str, float]) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the entities in the most likely segmentation."""
    by_end = _lattice(text, toks)
    if all(kind == OUT for ends in by_end for _, kind, _ in ends):
        return []
    n = len(toks)
    table: list[dict[int, tuple[float, int, int]]] = [{OUT: (0.0, 0, OUT)}] + [{} for _ in range(n)]
    for j in range(1, n + 1):
        for i, kind, features in by_end[j]:
            own = _score(weights, features)
            for before, (score, _, _) in table[i].items():
                total = score + own + weights.get(_move(before, kind), 0.0)
                if kind not in table[j] or total > table[j][kind][0]:
                    table[j][kind] = (total, i, before)
    out, j = [], n
    kind = max(table[n], key=lambda k: table[n][k][0])
    while j > 0:
        _, i, before = table[j][kind]
        if kind != OUT:
            out.append((toks[i][0], toks[j - 1][1], kind))
        j, kind = i, before
    return out[::-1]


def _expected(by_end, weights: dict[str, float], into: dict[str, float]) -> None:
    """Adds to ``into``, negated, how often each feature is expected over all segmentations."""
    n = len(by_end) - 1
    kinds = range(OUT + 1)
    scored = [[(i, k, f, _score(weights, f)) for i, k, f in ends] for ends in by_end]
    move = [[weights.get(_move(a, b), 0.0) for b in kinds] for a in kinds]
    alpha = [[-math.inf] * (OUT + 1) for _ in range(n + 1)]
    alpha[0][OUT] = 0.0
    for j in range(1, n + 1):
        for i, k, _, s in scored[j]:
            alpha[j][k] = _lse([alpha[j][k], s + _lse([alpha[i][a] + move[a][k] for a in kinds])])
    beta = [[-math.inf] * (OUT + 1) for _ in range(n + 1)]
    beta[n] = [0.0] * (OUT + 1)
    for j in range(n, 0, -1):
        for i, k, _, s in scored[j]:
            for a in kinds:
                beta[i][a] = _lse([beta[i][a], move[a][k] + s + beta[j][k]])
    total = _lse(alpha[n])
    for j in range(1, n + 1):
        for i, k, features, s in scored[j]:
            share = 0.0
            for a in kinds:
                p = math.exp(alpha[i][a] + move[a][k] + s + beta[j][k] - total)
                if p > 1e-12:
                    into[_move(a, k)] = into.get(_move(a, k), 0.0) - p
                share += p
            if share > 1e-12:
                for f in features:
                    into[f] = into.get(f, 0.0) - share


def sentences(count: int = TRAIN_SENTENCES, seed: int = 11) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Labelled sentences: made-up words, entities in several spellings, and numbers that are no personal data."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeiourstnlmd") for _ in range(r.randint(2, 7)))
    digit = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def card(valid: bool) -> str:
        while True:
            d = r.choice("3456") + digit(r.choice((14, 15, 15, 15, 18)) - 0)
            if luhn(d) == valid:
                break
        style = r.random()
        return d if style < 0.5 else r.choice(" -").join(d[i : i + 4] for i in range(0, len(d), 4))

    def phone() -> str:
        a, b, c = digit(3), digit(3), digit(4)
        return r.choice((f"+1 ({a}) {b}-{c}", f"+{r.randint(20, 99)} {digit(2)} {digit(4)} {digit(4)}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{r.randint(1, 99)}{digit(10)}", f"+1-{a}-{b}-{c}", f"+1 {a} {b} {c}"))

    def mail() -> str:
        user, host, top = r.choice((word(), f"{word()}.{word()}", f"{word()}{digit(2)}")), word(), r.choice(("com", "org", "net", "de"))
        return r.choice((f"{user}@{host}.{top}", f"{user}@{host}.{word()}.{top}", f"{user} (at) {host} (dot) {top}", f"{user}[at]{host}[dot]{top}", f"{user} [at] {host}.{top}"))

    def ip() -> str:
        return ".".join(str(r.randint(0, 255)) for _ in range(4))

    def noise() -> str:
        return r.choice((digit(4), digit(6), digit(8), digit(10), digit(12), card(False), card(False), f"{digit(4)}-{digit(2)}-{digit(2)}", f"{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}", f"{digit(3)}.{digit(2)}", f"{r.randint(256, 999)}.{digit(3)}.{r.randint(1, 9)}.{digit(2)}", f"{digit(2)}:{digit(2)}", f"@{word()}", f"#{digit(5)}", f"{digit(3)}x{digit(3)}", f"v{digit(1)}.{digit(1)}", "".join(r.choice("0123456789abcdef") for _ in range(20)), f"{digit(2)} {digit(3)} {digit(2)}", f"{digit(24)}"))

    hints = {k: [w for w, i in HINTS.items() if i == k] for k in range(OUT)}
    out = []
    for _ in range(count):
        parts, spans, at = [], [], 0

        def add(piece: str, kind: int | None = None):
            nonlocal at
            if parts:
                glue = r.choice((" ", " ", " ", " ", ", ", ": "))
                parts.append(glue)
                at += len(glue)
            if kind is not None:
                spans.append((at, at + len(piece), kind))
            parts.append(piece)
            at += len(piece)

        for _ in range(r.randint(1, 3)):
            for _ in range(r.randint(1, 3)):
                add(word())
            kind = r.choice((0, 1, 2, 3, 4, 4, 4))
            if kind == OUT:
                add(noise())
            else:
                if r.random() < 0.3:
                    add(r.choice(hints[kind]))
                add((mail, ip, lambda: card(True), phone)[kind](), kind)
        if r.random() < 0.5:
            add(word() + r.choice(".!?"))
        out.append(("".join(parts), spans))
    return out


@lru_cache(maxsize=1)
def train(rounds: int = 25, rate: float = 0.5, ridge: float = 0.02) -> dict[str, float]:
    """Weights of (nearly) greatest conditional likelihood, by adaptive gradient steps; the same each time."""
    work = []
    for text, spans in sentences():
        toks = tokens(text, 0, len(text))
        by_end = _lattice(text, toks)
        starts, ends = {t[0]: i for i, t in enumerate(toks)}, {t[1]: i + 1 for i, t in enumerate(toks)}
        gold = {(starts[a], ends[b], k) for a, b, k in spans if a in starts and b in ends}
        gold = {(i, j, k) for i, j, k in gold if any((x, y) == (i, k) for x, y, _ in by_end[j])}
        inside = {t for i, j, _ in gold for t in range(i, j)}
        path = sorted([*gold, *((t, t + 1, OUT) for t in range(len(toks)) if t not in inside)])
        counts: dict[str, float] = {}
        before = OUT
        for i, j, k in path:
            for f in [_move(before, k), *next(f for x, y, f in by_end[j] if (x, y) == (i, k))]:
                counts[f] = counts.get(f, 0.0) + 1
            before = k
        work.append((by_end, counts))
    weights: dict[str, float] = {}
    squares: dict[str, float] = {}
    for _ in range(rounds):
        slope: dict[str, float] = {f: -ridge * w * len(work) / 10 for f, w in weights.items()}
        for by_end, counts in work:
            for f, c in counts.items():
                slope[f] = slope.get(f, 0.0) + c
            _expected(by_end, weights, slope)
        for f in sorted(slope):
            squares[f] = squares.get(f, 0.0) + slope[f] ** 2
            weights[f] = weights.get(f, 0.0) + rate * slope[f] / (math.sqrt(squares[f]) + 1e-9)
    return weights


# --- texts -----------------------------------------------------------------------------------------------------------


def _kind(c: str) -> int:
    """Which characters make one token together: 0 digits, 1 letters; 2 for those that are tokens of their own."""
    return 0 if "0" <= c <= "9" else 1 if c.isalnum() and not c.isdecimal() else 2


def _back(text: str, at: int, more: int) -> int:
    """The start of the token that ``at`` lies in, and of ``more`` tokens before it."""
    for n in range(more + 1):
        if n:
            while at > 0 and text[at - 1].isspace():
                at -= 1
            at = max(0, at - 1)
        while 0 < at < len(text) and _kind(text[at - 1]) == _kind(text[at]) != 2:
            at -= 1
    return at


def stretches(text: str) -> list[tuple[int, int]]:
    """The parts of a text round its marks, from and to borders of tokens, with the tokens that features look at.

    A run of letters or digits, however long, is walked a fixed number of times, so this is linear without any white space.
    """
    reach, near = LONGEST_CHARS + 40, []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - reach), min(len(text), m.end() + reach)
        if near and a <= near[-1][1]:
            near[-1][1] = b
        else:
            near.append([a, b])
    out = []
    for a, b in near:
        if out and a <= out[-1][1]:
            a = out.pop()[0]
        else:
            a = _back(text, a, 4)
            if out and a <= out[-1][1]:
                a = out.pop()[0]
        while b < len(text) and _kind(text[b - 1]) == _kind(text[b]) != 2:
            b += 1
        out.append((a, b))
    return out


def find(text: str, weights: dict[str, float]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans by start, then kind."""
    base, more = base_spans(text), []
    for a, b in stretches(text):
        more += best(text, tokens(text, a, b), weights)
    if more:
        free, at = [], 0
        covered = sorted((a, b) for a, b, _ in base)
        for span in sorted(set(more)):
            while at < len(covered) and covered[at][1] <= span[0]:
                at += 1
            if not any(a < span[1] and span[0] < b for a, b in covered[at : at + 8]):
                free.append(span)
        return base, sorted([*base, *free], key=lambda s: (s[0], s[2]))
    return base, base


def digest(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def masked(text: str, spans) -> str:
    """The text with each stretch of overlapping spans replaced by its first kind, such as ``[EMAIL]``."""
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def quiet(text: bytes) -> bool:
    """Whether no pattern and no candidate can be in the text."""
    return len(text.translate(None, _MARKS)) == len(text)


_COLUMNS = T.StructType([*(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: counts of base spans by kind, the SHA-256 of their list, and the list of all spans. No shuffle."""
    weights = train()

    def start():
        from hashlib import sha256

        def run(texts):
            rows = []
            for t in texts:
                base, spans = ([], []) if quiet(t) else find(t.decode("utf-8", "replace"), weights)
                counts = [0] * OUT
                for _, _, k in base:
                    counts[k] += 1
                rows.append((*counts, sha256(digest(base).encode()).hexdigest(), digest(spans)))
            return [list(c) for c in zip(*rows)]

        return run

    return common.map_texts(df, id_col, text_col, _COLUMNS, start)


def mask(df: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """``df`` with every span masked; null texts stay null, and ``chars_col`` (if there is one) is counted again."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    weights, schema, arrow = train(), df.schema, to_arrow_schema(df.schema)
    at = df.columns.index(text_col)
    count = df.columns.index(chars_col) if chars_col in df.columns else None

    def run(batches):
        for batch in batches:
            texts = batch.column(at).cast(pa.binary())
            for where in common.slices(texts):
                part = batch.slice(*where)
                clean = []
                for t in texts.slice(*where).to_pylist():
                    if t is None or quiet(t):
                        clean.append(t and t.decode("utf-8", "replace"))
                    else:
                        s = t.decode("utf-8", "replace")
                        clean.append(masked(s, find(s, weights)[1]))
                clean = ["" if c == b"" else c for c in clean]
                columns = list(part.columns)
                columns[at] = pa.array(clean, arrow.field(at).type)
                if count is not None:
                    columns[count] = pa.array([None if c is None else len(c) for c in clean], arrow.field(count).type)
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], names=arrow.names)

    return common.bounded(df).mapInArrow(common.resting(run), schema)


def op4_pii(spark, sf_dir: str) -> DataFrame:
    """Base counts and all spans of every document."""
    return scan(common.table(spark, sf_dir, "documents"))
