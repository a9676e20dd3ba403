"""Secret scans: candidates by pattern, false positives removed by a random forest. DataFrame functions only.

Candidates of a text are found from left to right and don't overlap. At each place, the first of these that fits:

* ``header``: a key block header, ``-----BEGIN ... -----``;
* ``assigned``: a value of ``Patterns.least_value`` characters or more that a name with a secret word assigns (``=``, ``:``, ``:=``
  or ``=>``): between quotes in its line, or up to white space, a quote, a comma, a semicolon or a bracket. It may be short
  and may have letters only;
* ``run``: ``Patterns.least_run`` characters or more of ``[A-Za-z0-9+/_.-]``, then up to two ``=``, with a letter, and a digit, an
  inner capital or five consonants in a row. In ``NAME=value``, name and value are runs of their own.

None has a greatest length. A header that stands directly behind ``least_run`` characters of a run belongs to that run.
Each candidate comes with up to 40 characters before it in its line, after the candidate before it. Its features
are those that the forest was asked for:

* its length, and the shares of digits, capitals and marks;
* character transitions: changes between letter, digit and mark per character, changes of case, and pairs of letters that
  are frequent in words;
* dictionary coverage: the share of its characters that stand in words of ``Patterns.dictionary``;
* the path it is found in: whether the row's path (or source) names tests, examples, locks or configuration;
* neighbouring words: a word such as "token", "secret" or "commit" before it (or in the header itself), and whether ``=`` or
  ``:`` assigns it.

The forest (``TREES`` trees) is trained on lines of ``findings``, ``FINDINGS`` in number, so that training is bounded whatever the
input; what stands for a finding is extracted from its line just as from texts. Callers may pass their own labelled
findings and patterns. Candidates are rows, one for each place of each text, so a text with very many is not gathered
anywhere but in its own row; there is no shuffle. Equal rows have equal results; a null text or path is empty; a text without
candidates has no row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TREES, DEPTH, FINDINGS = 24, 8, 2400

# Words that ordinary identifiers, urls and paths are made of.
DICTIONARY = (
    "about", "account", "action", "admin", "api", "archive", "article", "asset", "backup", "branch", "build", "button",
    "cache", "category", "change", "class", "client", "cloud", "code", "comment", "config", "content", "count", "create",
    "data", "date", "default", "delete", "deploy", "dist", "document", "download", "driver", "email", "error", "event",
    "example", "feature", "field", "file", "filter", "folder", "format", "function", "group", "handler", "header", "html",
    "http", "image", "import", "index", "info", "input", "install", "item", "java", "json", "label", "language", "layout",
    "left", "library", "link", "list", "local", "login", "main", "manager", "master", "media", "menu", "message", "method",
    "model", "module", "name", "network", "node", "number", "object", "option", "order", "output", "package", "page",
    "parser", "path", "plugin", "post", "print", "process", "product", "profile", "project", "python", "query", "release",
    "remote", "report", "request", "response", "result", "right", "route", "sample", "schema", "script", "search",
    "section", "server", "service", "session", "setting", "shared", "simple", "source", "spark", "start", "state",
    "status", "storage", "store", "stream", "string", "style", "system", "table", "task", "template", "test", "text",
    "time", "title", "type", "update", "upload", "user", "util", "value", "version", "video", "view", "widget", "window",
    "with", "your",
)
# Pairs of letters that are frequent in the words of several European languages.
PAIRS = (
    "al", "an", "ar", "as", "at", "ch", "co", "de", "di", "ea", "ed", "ei", "el", "en", "er", "es", "ge", "ha", "he", "hi",
    "ic", "ie", "il", "in", "io", "is", "it", "la", "le", "li", "ll", "ly", "ma", "me", "nd", "ne", "ng", "no", "nt", "on",
    "or", "ou", "qu", "ra", "re", "ri", "ro", "se", "si", "st", "ta", "te", "th", "ti", "to", "tr", "un", "ur", "us", "ve",
)
# Names under which secrets are kept.
NAMES = ("token", "secret", "passwd", "password", "passphrase", "pwd", "api[_ -]?key", "access[_ -]?key", "auth[_-]?key", "credential", "private[_-]?key", "encryption[_-]?key")


@dataclass(frozen=True)
class Patterns:
    """What makes a candidate, and what its neighbourhood is held against. ``names`` and the last four are regular expressions."""

    least_run: int = 16
    least_value: int = 6
    dictionary: tuple[str, ...] = DICTIONARY
    names: tuple[str, ...] = NAMES
    secret_words: str = r"(?i)(?:token|secret|passwd|password|passphrase|pwd|api[_ -]?key|access[_ -]?key|auth|bearer|credential|private[_ -]?key|encryption[_ -]?key)[\w.-]*\W*$"
    public_words: str = r"(?i)(?:commit|sha1|sha256|md5|checksum|digest|hash|etag|uuid|revision|integrity|example|placeholder|dummy|sample|certificate|public[_ -]?key)[\w.-]*\W*$"
    public_paths: str = r"(?i)test|spec|example|sample|fixture|mock|lock|vendor|node_modules|docs?/"
    config_paths: str = r"(?i)\.env|config|settings|credential|\.ya?ml|\.properties|\.ini|deploy"

    @property
    def header(self) -> str:
        return r"-----BEGIN [A-Z0-9 ]{1,64}-----"

    @property
    def assignment(self) -> str:
        """A name and what stands between it and its value, up to the opening quote."""
        return rf"(?i:{'|'.join(self.names)})[A-Za-z0-9_.-]{{0,40}}[\"']?[ \t]{{0,8}}(?::=|=>|=|:)[ \t]{{0,8}}"

    @property
    def value(self) -> str:
        n = self.least_value
        quoted = "|".join(rf"{q}[^{q}\n]{{{n},}}{q}" for q in ('"', "'", "`"))
        return rf"(?:{quoted}|[^\s\"'`,;()\[\]{{}}<>]{{{n},}})"

    @property
    def run(self) -> str:
        return rf"[A-Za-z0-9+/_.-]{{{self.least_run},}}={{0,2}}"

    @property
    def candidate(self) -> str:
        return f"{self.header}|{self.assignment}{self.value}|{self.run}"


FEATURES = ("length", "digits", "capitals", "marks", "changes", "cases", "pairs", "coverage", "path_public", "path_config", "near_secret", "near_public", "assigned", "quoted")


def findings(count: int = FINDINGS, seed: int = 5) -> list[tuple[str, str, str, int]]:
    """(line, value, path, label): lines with a value in each; 1 is a secret. What else is found in a line is none."""
    r = random.Random(seed)
    some = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    words = lambda n: [r.choice(DICTIONARY) for _ in range(n)]
    syllables = lambda n: "".join(r.choice(PAIRS) for _ in range(n))
    plain = lambda: " ".join(r.choice((some(lower, r.randint(2, 7)), syllables(r.randint(1, 4)))) for _ in range(r.randint(0, 4)))
    names = ("token", "secret", "password", "api_key", "apikey", "access_key", "auth_token", "client_secret", "private_key", "passwd", "db.password", "DB_PASSWORD", "API_KEY", "SECRET")
    paths = ("src/main.py", "app/settings.yml", "deploy/.env", "config/production.json", "docs/readme.md", "tests/test_login.py", "src0", "src7", "web/crawl", "package-lock.json", "vendor/lib.js", "")
    glue = lambda: r.choice((" = ", "=", ": ", " := "))
    strong = (
        lambda: some("0123456789abcdef", r.choice((32, 40, 40, 64))),
        lambda: some(lower + upper + digits, r.randint(20, 60)),
        lambda: some(lower + upper + digits + "+/", 40) + r.choice(("", "=", "==")),
        lambda: some(lower + upper + digits + "-_", r.randint(200, 900)),
        lambda: some(lower + upper, r.randint(16, 40)),
        lambda: some(lower, r.randint(20, 40)),
        lambda: "AKIA" + some(upper + digits, 16),
        lambda: "ghp_" + some(lower + upper + digits, 36),
        lambda: "sk-" + some(lower + upper + digits, 40),
        lambda: ".".join(some(lower + upper + digits + "-_", n) for n in (36, r.randint(80, 300), 43)),
    )
    weak = (
        lambda: some(lower + upper + digits, r.randint(8, 15)),
        lambda: some(lower + digits + "!$%&*?_", r.randint(8, 15)),
        lambda: syllables(3) + some(digits, r.randint(1, 4)),
        lambda: some(lower, r.randint(8, 15)),
    )
    dull = ("changeme", "your_token_goes_here_1", "example_secret_0000", "placeholder", "xxxxxxxxxxxxxxxx1", "0000000000000000a", "required", "undefined", "process.env.VALUE", "None,None", "********", "string", "default", "optional", "request.session.token", "<your-token>", "not_set")
    out = []
    for i in range(count):
        path, quote = r.choice(paths), r.choice(('"', '"', "'", ""))
        if i % 2:
            kind = r.randrange(8)
            if kind == 0:
                value = f"-----BEGIN {r.choice(('RSA ', 'EC ', 'OPENSSH ', 'ENCRYPTED ', 'DSA ', ''))}PRIVATE KEY-----"
                line = r.choice(("", plain() + " ")) + value
            elif kind <= 2:
                value = r.choice(weak)()
                line = f"{plain()} {r.choice(names)}{glue()}{quote}{value}{quote}"
            elif kind == 3:
                value = r.choice(strong[6:])()
                line = f"{plain()} {r.choice(('', quote))}{value}{quote} {plain()}"
            else:
                value = r.choice(strong)()
                line = f"{plain()} {r.choice(names)}{glue()}{quote}{value}{quote} {plain()}"
        else:
            kind = r.randrange(9)
            if kind == 0:
                value = some("0123456789abcdef", r.choice((32, 40, 64)))
                line = f"{plain()} {r.choice(('commit', 'sha256', 'md5', 'checksum', 'revision', 'etag', 'integrity'))}{r.choice((' ', ': ', '=', ' = '))}{value}"
            elif kind == 1:
                value = r.choice("_-./").join([*words(r.randint(3, 6)), some(digits, r.randint(1, 4))])
                line = f"{plain()} {value} {plain()}"
            elif kind == 2:
                value = "/".join([*words(3), "v" + some(digits, 1), *words(1)])
                line = f"{plain()} {r.choice(('path', 'url', 'file'))}: {value}"
            elif kind == 3:
                value = some(digits, 4) + "-" + some(digits, 2) + "-" + some(digits, 2) + "T" + some(digits, 6)
                line = f"{plain()} {value}"
            elif kind == 4:
                value = "-".join(some("0123456789abcdef", n) for n in (8, 4, 4, 4, 12))
                line = f"{plain()} {r.choice(('uuid', 'id', 'request'))}{r.choice((' = ', ': ', ' '))}{value}"
            elif kind == 5:
                value = f"-----BEGIN {r.choice(('CERTIFICATE', 'PUBLIC KEY', 'CERTIFICATE REQUEST', 'PGP PUBLIC KEY BLOCK', 'RSA PUBLIC KEY'))}-----"
                line = value
            elif kind == 6:
                value = r.choice((lambda: "".join(w.capitalize() for w in words(r.randint(3, 5))), lambda: syllables(r.randint(8, 14)), lambda: syllables(r.randint(3, 8)) + r.choice((".", "-", "/")) + syllables(r.randint(5, 9)) + r.choice(("", some(digits, 2)))))()
                line = f"{plain()} {value} {plain()}"
            else:
                value = r.choice((r.choice(dull), r.choice(dull), "_".join(words(2))))
                line = f"{plain()} {r.choice(names)}{glue()}{quote}{value}{quote}"
        out.append((line, value, path, i % 2))
    return out


def _share(col: Column, pattern: str) -> Column:
    return F.regexp_count(col, F.lit(pattern)) / F.length(col)


def described(rows: DataFrame, patterns: Patterns = Patterns(), before: str = "before", value: str = "value", path: str = "path") -> DataFrame:
    """``rows`` with a column for each feature. A header is judged by its own words, like the words before other values."""
    v, p = F.col(value), F.coalesce(F.col(path), F.lit(""))
    b = F.when(v.startswith("-----BEGIN "), F.concat(F.coalesce(F.col(before), F.lit("")), v)).otherwise(F.coalesce(F.col(before), F.lit("")))
    in_words = F.length(v) - F.length(F.regexp_replace(F.lower(v), "|".join(sorted(patterns.dictionary, key=len, reverse=True)), ""))
    made = {
        "length": F.length(v).cast("double"),
        "digits": _share(v, "[0-9]"),
        "capitals": _share(v, "[A-Z]"),
        "marks": _share(v, "[^A-Za-z0-9]"),
        "changes": _share(v, r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[A-Za-z0-9])(?=[^A-Za-z0-9])"),
        "cases": _share(v, r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"),
        "pairs": _share(F.lower(v), f"(?=(?:{'|'.join(PAIRS)}))"),
        "coverage": in_words / F.length(v),
        "path_public": p.rlike(patterns.public_paths).cast("double"),
        "path_config": p.rlike(patterns.config_paths).cast("double"),
        "near_secret": b.rlike(patterns.secret_words).cast("double"),
        "near_public": b.rlike(patterns.public_words).cast("double"),
        "assigned": b.rlike(r"[=:]>?\s*[\"'`(]?$").cast("double"),
        "quoted": b.rlike(r"[\"'`]$").cast("double"),
    }
    return rows.withColumns({f"f_{k}": made[k] for k in FEATURES})


def candidates(df: DataFrame, id_col: str, text_col: str, path_col: str | None, patterns: Patterns = Patterns()) -> DataFrame:
    """(id, path, place, kind, before, value): a row for each candidate of each text; places count matches from 0."""
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).alias(common.ID), path.alias("path"), text.alias("text"), F.regexp_extract_all(text, F.lit(patterns.candidate), F.lit(0)).alias("found"))
    # What stands between matches is cut out only where there are any.
    between = F.when(F.size("found") > 0, F.split("text", patterns.candidate, -1))
    rows = rows.select(common.ID, "path", F.posexplode(F.zip_with("found", between, lambda m, gap: F.struct(m.alias("match"), F.right(gap, F.lit(40)).alias("gap")))).alias("place", "pair"))
    rows = rows.select(common.ID, "path", "place", "pair.match", "pair.gap").where("match IS NOT NULL")
    opening = F.regexp_extract("match", f"^{patterns.assignment}[\"'`]?", 0)
    kind = F.when(F.col("match").startswith("-----BEGIN "), "header").when(opening != "", "assigned").otherwise("run")
    rows = rows.withColumn("opening", opening).withColumn("kind", kind).withColumn("value", F.expr("substring(match, length(opening) + 1)"))
    rows = rows.withColumn("value", F.when(F.col("opening").rlike("[\"'`]$"), F.regexp_replace("value", "[\"'`]$", "")).otherwise(F.col("value")))
    before = F.regexp_extract(F.right(F.concat("gap", "opening"), F.lit(40)), r"[^\n]*\z", 0)
    likely = F.col("value").rlike("[A-Za-z]") & F.col("value").rlike("[0-9]|[a-z][A-Z]|(?i:[bcdfghjklmnpqrstvwxz]{5})")
    return rows.where((F.col("kind") != "run") | likely).select(common.ID, "path", "place", "kind", before.alias("before"), "value")


def training_rows(spark: SparkSession, made: list[tuple[str, str, str, int]], patterns: Patterns = Patterns()) -> DataFrame:
    """(before, value, path, label): what is found in the lines of ``findings``; other than their values is no secret."""
    lines = common.literal_rows(spark, [(i, *f) for i, f in enumerate(made)], "number int, line string, given string, path string, label int")
    found = candidates(lines.withColumn("row", F.struct("number", "given", "label")), "row", "line", "path", patterns)
    label = F.when(F.col("value") == F.col(f"{common.ID}.given"), F.col(f"{common.ID}.label")).otherwise(0)
    return found.select("before", "value", "path", label.alias("label"))


def forest(spark: SparkSession, labelled: DataFrame | None = None, seed: int = 17, patterns: Patterns = Patterns()):
    """A random forest over ``FEATURES`` from (before, value, path, label); by default from ``findings``."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    if labelled is None:
        labelled = training_rows(spark, findings(), patterns)
    rows = VectorAssembler(inputCols=[f"f_{f}" for f in FEATURES], outputCol="features").transform(described(labelled, patterns))
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, featureSubsetStrategy="sqrt").fit(rows.select("features", F.col("label").cast("double")))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", least: float = 0.5, labelled: DataFrame | None = None, patterns: Patterns = Patterns()) -> DataFrame:
    """(id, place, kind, before, length, value_sha256, probability, secret) for each candidate."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    model = forest(df.sparkSession, labelled, patterns=patterns)
    rows = VectorAssembler(inputCols=[f"f_{f}" for f in FEATURES], outputCol="__features").transform(described(candidates(df, id_col, text_col, path_col, patterns), patterns))
    judged = model.setFeaturesCol("__features").setProbabilityCol("__p").setPredictionCol("").setRawPredictionCol("").transform(rows)
    return judged.select(
        F.col(common.ID).alias(id_col),
        F.col("place").cast("long").alias("place"),
        "kind",
        "before",
        F.length("value").cast("long").alias("length"),
        F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"),
        F.round(vector_to_array("__p")[1], 6).alias("probability"),
    ).withColumn("secret", F.col("probability") >= least)


def op2_secrets(spark, sf_dir: str) -> DataFrame:
    """Every candidate in every document, with the forest's verdict."""
    return scan(common.table(spark, sf_dir, "documents"))
