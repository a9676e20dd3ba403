"""DuckDB SQL for the queries of this package that SQL can state."""

from __future__ import annotations

from . import chat, licenses, quality, urls


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _lower(s: str) -> str:
    return f"translate({s}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def chat_sql(template: chat.Template = chat.Template()) -> str:
    """``op6_chat``: turns and loss as they were, lengths of what the template makes of them, and the machine by pairs."""
    odd = _text("\\### Assistant: </turn> ok")
    escaped = "{}"
    for a, b in template.codes():
        escaped = f"replace({escaped}, {_text(a)}, {_text(b)})"
    shown = " ".join(f"WHEN role = {_text(r.name)} THEN {_text(f'{template.mark} {r.shown}{template.colon}')}" for r in template.roles)
    other = f"{_text(template.mark + ' Role ')} || replace({escaped.format('role')}, ':', '\\c') || {_text(template.colon)}"
    loss = ", ".join(_text(r.name) for r in template.roles if r.loss)
    moves = ", ".join(_text(f"{state}>{r}") for state, nexts in template.moves.items() for r in nexts)
    ends = ", ".join(map(_text, template.ends))
    return f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', {odd} UNION ALL SELECT -7, 1, 'assistant', {odd}
), placed AS (
  SELECT *, row_number() OVER w - 1 AS place, coalesce(lag(role) OVER w, 'start') AS before,
    length(CASE {shown} ELSE {other} END || {escaped.format('text')} || {_text(template.tail + chr(10))}) AS chars
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), judged AS (
  SELECT *, CASE WHEN before || '>' || role NOT IN ({moves}) THEN place END AS wrong FROM placed
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role IN ({loss}) THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role IN ({loss}) THEN text END, '' ORDER BY place), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars,
  coalesce(min(wrong), CASE WHEN arg_max(role, place) NOT IN ({ends}) THEN count(*) END) IS NULL AS valid,
  CAST(coalesce(min(wrong), CASE WHEN arg_max(role, place) NOT IN ({ends}) THEN count(*) END) AS INTEGER) AS broken_at
FROM judged GROUP BY conv_id
"""


def license_sql(slack: int = 3, share: float = 0.9) -> str:
    """``op7_licenses``: k-grams as they are written instead of hashed; the words that a span holds are counted one by one."""

    def values(texts, k):
        rows = []
        for number, (label, text) in enumerate(texts):
            words = [w.decode() for w in licenses.words_of(text.encode())]
            rows += [f"({_text(' '.join(words[q : q + k]))}, {number}, {q}, {len(words)}, {_text(label)})" for q in range(len(words) - k + 1)]
        return ", ".join(rows)

    def grams(k):
        parts = ", ".join(f"w[{i + 1} : len(w) - {k - 1 - i}]" for i in range(k))
        text = " || ' ' || ".join(f"x[{i + 1}]" for i in range(k))
        return f"SELECT row, unnest(range(len(w) - {k - 1})) AS pos, unnest(list_transform(list_zip({parts}), lambda x: {text})) AS gram FROM texts WHERE len(w) >= {k}"

    def scored(held):
        return f"2.0 * least(len(list_distinct(flatten(list_transform({held}, lambda q: range(q, q + {licenses.K}))))), high + {licenses.K} - low) / (words + high + {licenses.K} - low)"

    joined = " UNION ALL ".join(
        f"SELECT row, template, words, label, flatten(list(held) OVER w) AS held, min(low) OVER w AS low, max(high) OVER w AS high FROM merged WINDOW w AS (PARTITION BY row, template, span ORDER BY diagonal ROWS BETWEEN CURRENT ROW AND {more} FOLLOWING)"
        for more in range(licenses.JOINED)
    )
    lower = _lower("coalesce(text, '')")
    return f"""
WITH phrases(gram, template, q, words, label) AS (VALUES {values([(label, p) for p, label in licenses.PHRASES.items()], licenses.BASE_K)}),
templates(gram, template, q, words, label) AS (VALUES {values(licenses.default_templates(), licenses.K)}),
texts AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
places AS (
  SELECT row, label, pos - q AS word FROM ({grams(licenses.BASE_K)}) JOIN phrases USING (gram)
  GROUP BY row, template, words, label, pos - q HAVING count(DISTINCT q) = words - {licenses.BASE_K - 1}
),
votes AS (
  SELECT row, template, words, label, pos - q AS diagonal, list(DISTINCT q) AS held, min(pos) AS low, max(pos) AS high
  FROM ({grams(licenses.K)}) JOIN templates USING (gram) GROUP BY row, template, words, label, pos - q
),
marked AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY row, template ORDER BY diagonal) > least(greatest({slack}, words // 20), words // 2) THEN 1 ELSE 0 END AS new FROM votes
),
merged AS (SELECT *, sum(new) OVER (PARTITION BY row, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS span FROM marked),
spans AS (
  {joined}
  UNION ALL SELECT row, template, words, label, flatten(list(held)) AS held, min(low) AS low, max(high) AS high FROM merged GROUP BY row, template, words, label, span
),
found AS (
  SELECT row, label, score, NULL AS word FROM (SELECT row, label, words, {scored("held")} AS score FROM spans) WHERE score >= {share} AND (words >= {licenses.EXACT} OR score = 1)
  UNION ALL SELECT row, label, 1.0, word FROM places
),
by_text AS (
  SELECT row, count(word) AS n_base, CAST(min(word) AS BIGINT) AS first_word, CAST(max(word) AS BIGINT) AS last_word,
    coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (word IS NOT NULL)), ','), '') AS base_labels,
    array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(score) AS score
  FROM found GROUP BY row
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM texts LEFT JOIN by_text USING (row)
"""


def quality_sql(rules: quality.Rules = quality.Rules()) -> str:
    """``op10_quality``: windows by position, lines in order; long lines by all their windows."""
    word, width = "[^\\x20\\x09-\\x0D]+", rules.line_distinct_window
    menu = ", ".join(_text(w.decode()) for w in rules.menu_words)
    phrases = " OR ".join(f"contains(lower_line, {_text(p.decode())})" for p in rules.boilerplate)
    return f"""
WITH texts AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}') AS w FROM documents),
windows AS (SELECT row, unnest(range(1, len(w) - 3)) AS pos, w FROM texts WHERE len(w) > 4),
twice AS (SELECT row, unnest(list(pos)) AS pos FROM (SELECT row, pos, w[pos : pos + 4] AS five FROM windows) GROUP BY row, five HAVING count(*) > 1),
repeated AS (SELECT row, count(DISTINCT pos + j) AS n_repeat_words FROM twice, range(5) r(j) GROUP BY row),
lines AS (
  SELECT row, at_line, line, regexp_extract_all(line, '{word}') AS lw, {_lower("line")} AS lower_line,
    row_number() OVER (PARTITION BY row, line ORDER BY at_line) > 1 AS seen
  FROM (SELECT row, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS at_line FROM texts)
),
measured AS (
  SELECT *, len(lw) AS n, CAST(coalesce(list_sum(list_transform(lw, lambda x: length(x))), 0) AS BIGINT) AS chars,
    len(regexp_extract_all(line, '[#*$%&|<>]')) AS marks, len(regexp_extract_all(line, '[!?]{{2,}}')) AS stacked,
    list_append(range(0, greatest(len(lw) - {width}, 0), {width}), greatest(len(lw) - {width}, 0)) AS starts,
    len(regexp_extract_all(line, '[|»]')) + len(list_filter(lw, lambda x: x = '<' OR x = '>')) AS bars
  FROM lines WHERE len(lw) > 0
),
judged AS (
  SELECT *, seen
    OR (n > 1 AND 100 * marks > {rules.line_symbols} * chars)
    OR 100 * stacked > {rules.line_stacked} * n
    OR (n > 1 AND 100 * bars > {rules.line_separators} * n)
    OR (n <= {rules.boilerplate_words} AND len(list_filter(regexp_extract_all(lower_line, '{word}'), lambda x: trim(x, '.,:;!?>') NOT IN ({menu}))) = 0)
    OR (n <= {rules.boilerplate_words} AND ({phrases}))
    OR (n >= {rules.line_distinct_words} AND 100 * len(list_distinct(lw)) < {rules.line_distinct} * n AND (n <= {width}
      OR 100 * list_sum(list_transform(starts, lambda i: len(list_distinct(lw[i + 1 : i + {width}])))) < {rules.line_distinct} * {width} * len(starts))) AS fails
  FROM measured
),
by_text AS (SELECT row, sum(CASE WHEN seen THEN 1 ELSE 0 END) AS dup, sum(CASE WHEN fails THEN chars ELSE 0 END) AS lost FROM judged GROUP BY row),
counted AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(coalesce(lost, 0) AS BIGINT) AS lost_chars
  FROM texts LEFT JOIN repeated USING (row) LEFT JOIN by_text USING (row)
)
SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat} * n_words AS base_failed,
  NOT (n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat} * n_words) AND 100 * lost_chars <= {rules.max_lost} * word_chars AS kept,
  CAST(lost_chars AS DOUBLE) / greatest(word_chars, 1) AS lost_share
FROM counted
"""


def url_sql(rules=urls.RULES, limits: urls.Limits = urls.Limits()) -> str:
    """``op5_urls``: the tree as tables of its places, and purities from the root down."""
    cases = []
    for _, (verdict, h, p) in sorted(enumerate(rules), key=lambda r: (-len(r[1][1] + r[1][2]), r[0])):
        cases.append((f"(host = {_text(h)} OR ends_with(host, {_text('.' + h)})) AND starts_with(path, {_text(p)})", h + p, verdict))
    rule = "CASE " + " ".join(f"WHEN {c} THEN {_text(name)}" for c, name, _ in cases) + " END"
    decided = "CASE " + " ".join(f"WHEN {c} THEN {_text(v)}" for c, _, v in cases) + " END"
    parts = "(?s)^.*?://([^/?#]*)([^?#]*)"
    ending = "\\.[A-Za-z][A-Za-z0-9]{0,4}$"
    stem, tail = f"regexp_replace(s, '{ending}', '')", f"regexp_extract(s, '{ending}')"
    form = (
        f"CASE WHEN s = '' THEN '' WHEN regexp_matches({stem}, '^[0-9]+$') THEN '{{n}}' || {tail} "
        f"WHEN regexp_matches({stem}, '^[0-9a-fA-F-]{{8,}}$') AND regexp_matches({stem}, '[0-9]') THEN '{{h}}' || {tail} "
        f"WHEN regexp_matches({stem}, '[0-9]') AND length({stem}) >= 6 THEN '{{x}}' || {tail} ELSE s END"
    )
    joined = "array_to_string(list_transform({}, lambda s: '/' || s), '')"
    shape = joined.format("list_transform(segments[i + 1 :], lambda s: CASE WHEN starts_with(s, '{') OR s = '' THEN s ELSE 'w' END)")
    places = f"SELECT host, path_form, pages, blocked, allowed, i, segments[i] AS segment, {joined.format('segments[: i - 1]')} AS parent, {shape} AS below FROM (SELECT *, unnest(range(1, len(segments) + 1)) AS i FROM @)"
    rebuilt = "SELECT host, path_form, pages, blocked, allowed, list(segment ORDER BY i) AS segments FROM @ GROUP BY host, path_form, pages, blocked, allowed"
    word = "NOT starts_with(segment, '{') AND segment <> ''"
    w = f"CAST({limits.weight!r} AS DOUBLE)"
    return f"""
WITH known AS (
  SELECT doc_id, CASE WHEN bool_or(coalesce(toxic, 0) = 1 OR coalesce(quality, 1) = 0) THEN 'block' ELSE 'allow' END AS label
  FROM labels WHERE toxic IS NOT NULL OR quality IS NOT NULL GROUP BY doc_id
),
cut AS (SELECT page_id, {_lower(f"coalesce(regexp_extract(url, '{parts}', 1), '')")} AS host, coalesce(regexp_extract(url, '{parts}', 2), '') AS path FROM pages),
ruled AS (SELECT cut.*, {rule} AS rule, {decided} AS decided, label, string_split(path, '/')[2 :] AS segs FROM cut LEFT JOIN known ON doc_id = TRY_CAST(regexp_extract(path, {_text(urls.DOCUMENT)}, 1) AS BIGINT)),
shaped AS (SELECT *, list_transform(segs, lambda s: {form}) AS every FROM ruled),
formed AS (SELECT *, every[: {limits.deepest}] || CASE WHEN len(every) > {limits.deepest} THEN ['{{**' || left(md5(array_to_string(every[{limits.deepest} + 1 :], '/')), 16) || '}}'] ELSE [] END AS segments FROM shaped),
rows AS (SELECT *, {joined.format("segments")} AS path_form FROM formed),
tree AS (
  SELECT host, path_form, any_value(segments) AS segments, count(*) AS pages,
    CAST(sum(CASE WHEN label = 'block' THEN 1 ELSE 0 END) AS BIGINT) AS blocked, CAST(sum(CASE WHEN label = 'allow' THEN 1 ELSE 0 END) AS BIGINT) AS allowed
  FROM rows GROUP BY host, path_form
),
places AS ({places.replace("@", "tree")}),
words AS (SELECT host, i, parent, segment, sum(pages) AS pages FROM places WHERE {word} GROUP BY host, i, parent, segment),
wild AS (SELECT host, i, parent, true AS wild FROM words GROUP BY host, i, parent HAVING count(*) >= {limits.variable} AND count(*) >= CAST({limits.spread} AS DOUBLE) * sum(pages)),
general AS (SELECT p.* REPLACE (CASE WHEN wild AND {word} THEN '{{*}}' ELSE segment END AS segment) FROM places p LEFT JOIN wild USING (host, i, parent)),
tree2 AS ({rebuilt.replace("@", "general")}),
places2 AS ({places.replace("@", "tree2")}),
branch AS (SELECT host, i, parent, segment, CAST(sum(blocked) AS DOUBLE) AS b, CAST(sum(allowed) AS DOUBLE) AS a, list_sort(list(DISTINCT below)) AS shape FROM places2 GROUP BY host, i, parent, segment),
unions AS (SELECT host, i, parent, shape, sum(b) AS ub, sum(a) AS ua, count(*) AS branches FROM branch GROUP BY host, i, parent, shape),
merged AS (
  SELECT host, i, parent, segment, true AS merged FROM (SELECT *, ub / nullif(ua + ub, 0) AS share, a + b AS n FROM branch JOIN unions USING (host, i, parent, shape))
  WHERE branches > 1 AND n >= {limits.labelled} AND {word} AND (share IN (0, 1) OR (b - n * share) * (b - n * share) < CAST(3.84 AS DOUBLE) * (n * share * (1 - share)))
),
final AS (SELECT p.* REPLACE (CASE WHEN merged THEN '{{~}}' ELSE segment END AS segment) FROM places2 p LEFT JOIN merged USING (host, i, parent, segment)),
named AS (
  SELECT host, path_form, blocked, allowed, segments, {joined.format("segments")} AS template FROM ({rebuilt.replace("@", "final")})
  UNION ALL SELECT host, path_form, blocked, allowed, segments, '' FROM tree WHERE len(segments) = 0
),
own AS (SELECT host, template, any_value(segments) AS segments, CAST(sum(blocked) AS DOUBLE) AS b, CAST(sum(blocked) + sum(allowed) AS DOUBLE) AS n FROM named GROUP BY host, template),
whole AS (SELECT (coalesce(sum(b), 0) + CAST({limits.weight * limits.prior!r} AS DOUBLE)) / (coalesce(sum(n), 0) + {w}) AS g FROM own),
above AS (SELECT host, template, b, n, depth, {joined.format("segments[: depth]")} AS node FROM (SELECT *, unnest(range(0, greatest(len(segments), 1))) AS depth FROM own)),
nodes AS (SELECT host, depth, node, sum(b) AS node_b, sum(n) AS node_n FROM above GROUP BY host, depth, node),
chain AS (SELECT host, template, list({{'b': node_b, 'n': node_n, 'p': CAST(0 AS DOUBLE)}} ORDER BY depth) AS chain FROM above JOIN nodes USING (host, depth, node) GROUP BY host, template),
parents AS (SELECT host, template, list_reduce(list_prepend({{'b': CAST(0 AS DOUBLE), 'n': CAST(0 AS DOUBLE), 'p': g}}, chain), lambda x, y: {{'b': y.b, 'n': y.n, 'p': (y.b + {w} * x.p) / (y.n + {w})}}).p AS parent FROM chain, whole),
elsewhere AS (SELECT template, (sum(b) + {w} * any_value(g)) / (sum(n) + {w}) AS elsewhere FROM own, whole GROUP BY template),
pure AS (SELECT host, template, round((b + {w} * ((parent + elsewhere) / 2)) / (n + {w}), 9) AS purity FROM own JOIN parents USING (host, template) JOIN elsewhere USING (template))
SELECT page_id, r.host, path, rule, coalesce(decided, CASE WHEN purity >= {limits.reject} THEN 'block' ELSE 'allow' END) AS verdict, n.template, purity
FROM rows r LEFT JOIN named n ON n.host = r.host AND n.path_form = r.path_form LEFT JOIN pure p ON p.host = n.host AND p.template = n.template
"""
