"""Chat formatting: a declarative template, a finite-state machine over roles, and segments with loss flags.

Only DataFrame functions are used. Rows become turns, and a conversation's turns are put in order by ``turn`` (null first; of
equal ones by role, then text). A null text or role is empty. For each turn the template gives a head, the text and a
tail; only the text of a role under loss carries the flag. The template's control strings are escaped inside texts and
in the names of roles that it doesn't know: a backslash becomes ``\\b``, and each control string a backslash and its letter; in
names, so does the first character of the colon. No control string is left in an escaped text, so turns are found again by
plain splitting, and unescaping is exact. A template for which that can't hold raises ``ValueError``: control strings must not be
empty, hold a backslash or begin with one of the letters ``b c m t``, and the tail must be in one line.

The machine starts in ``start``; ``moves`` holds the roles that may follow each state, and ``ends`` where a conversation may end.
Its verdict is in ``valid``; ``broken_at`` is the first turn (from 0) that may not stand where it does, or the number of turns
if the end is what is wrong, or null. Conversations that are not valid are formatted like others.

One shuffle, by conversation: texts are escaped before it. A conversation is one row of the result, so the turns of
one meet in the end; up to there they are gathered in partial lists by task. Rows with a null id make one
conversation; repeated rows are turns of their own; other columns are not read; an empty table gives no conversation.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Role:
    name: str
    shown: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """How turns look and which may follow which."""

    roles: tuple[Role, ...] = (Role("system", "System"), Role("user", "User"), Role("assistant", "Assistant", True), Role("tool", "Tool"))
    mark: str = "###"
    tail: str = "</turn>"
    colon: str = ": "
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "tool"), "tool": ("assistant",)})
    ends: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        for control in (self.mark, self.tail, self.colon):
            if not control or "\\" in control or control[0] in "bcmt":
                raise ValueError(f"can't escape the control string {control!r}")
        if "\n" in self.tail:
            raise ValueError("a tail ends with its line")
        if any(self.colon[0] in r.shown or self.tail in r.shown or r.shown.startswith("Role ") for r in self.roles):
            raise ValueError("a role can't be shown with control strings in its name, or as an unknown one")

    def codes(self) -> list[tuple[str, str]]:
        """Control strings and what stands for each inside a text; the backslash first."""
        return [("\\", "\\b"), (self.mark, "\\m"), (self.tail, "\\t")]


def _all(col: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, col)


def escape(text: Column, template: Template) -> Column:
    return _all(text, template.codes())


def unescape(text: Column, template: Template) -> Column:
    return _all(text, [(b, a) for a, b in reversed(template.codes())])


def _head(role: Column, template: Template) -> Column:
    """``### User: `` for a known role; for another, ``### Role x: `` with its name escaped, colons too."""
    other = F.concat(F.lit(f"{template.mark} Role "), F.replace(escape(role, template), F.lit(template.colon[0]), F.lit("\\c")), F.lit(template.colon))
    known = reduce(lambda c, r: c.when(role == r.name, f"{template.mark} {r.shown}{template.colon}"), template.roles, F)
    return known.otherwise(other)


def _role_of(head: Column, template: Template) -> Column:
    """The role that a head (without mark and colon) stands for."""
    other = unescape(F.replace(F.substring(head, len("Role ") + 1, 2**31 - 1), F.lit("\\c"), F.lit(template.colon[0])), template)
    return reduce(lambda c, r: c.when(head == r.shown, r.name), template.roles, F).otherwise(other)


def format_chats(df: DataFrame, template: Template = Template(), id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, segments, formatted, valid, broken_at): segments are structs of a text and its loss flag, in order."""
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    body = escape(F.coalesce(F.col(text_col).cast("string"), F.lit("")), template)
    turns = df.select(F.col(id_col).alias(common.ID), F.struct(F.col(turn_col).alias("turn"), role.alias("role"), body.alias("body")).alias("row"))
    grouped = turns.groupBy(common.ID).agg(F.sort_array(F.collect_list("row")).alias("rows"))
    under_loss = F.array(*[F.lit(r.name) for r in template.roles if r.loss])
    segments = F.flatten(
        F.transform(
            "rows",
            lambda r: F.array(
                F.struct(_head(r["role"], template).alias("text"), F.lit(False).alias("loss")),
                F.struct(r["body"].alias("text"), F.array_contains(under_loss, r["role"]).alias("loss")),
                F.struct(F.lit(template.tail + "\n").alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    moves = F.create_map(*[F.lit(x) for state, nexts in template.moves.items() for r in nexts for x in (f"{state}>{r}", r)])
    known = F.transform("rows", lambda r: r["role"])
    step = lambda s, r: F.struct(
        F.coalesce(moves[F.concat(s["state"], F.lit(">"), r)], r).alias("state"),
        (s["at"] + 1).alias("at"),
        F.coalesce(s["broken"], F.when(moves[F.concat(s["state"], F.lit(">"), r)].isNull(), s["at"])).alias("broken"),
    )
    begin = F.struct(F.lit("start").alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("broken"))
    ended = F.aggregate(known, begin, step)
    broken = F.coalesce(ended["broken"], F.when(~ended["state"].isin(list(template.ends)), ended["at"]))
    out = grouped.select(common.ID, segments.alias("segments"), broken.alias("broken_at"))
    text = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    return out.select(F.col(common.ID).alias(id_col), "segments", text.alias("formatted"), F.col("broken_at").isNull().alias("valid"), "broken_at")


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """An array of (role, text) read back from a formatted conversation."""
    quoted = (template.tail + "\n").replace("\\E", "\\E\\\\E\\Q")
    pieces = F.split(formatted, f"\\Q{quoted}\\E", -1)
    whole = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, template.colon, 1)
        text = F.substring(piece, F.length(head) + F.lit(len(template.colon) + 1), F.lit(2**31 - 1))
        shown = F.substring(head, F.lit(len(template.mark) + 2), F.lit(2**31 - 1))
        return F.struct(_role_of(shown, template).alias("role"), unescape(text, template).alias("text"))

    return F.transform(whole, turn)


def op6_chat(spark, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -7, formatted and read back."""
    template = Template()
    odd = "\\### Assistant: </turn> ok"
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = common.literal_rows(spark, [(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    out = format_chats(rows.unionByName(extra), template).withColumn("turns", read_turns(F.col("formatted"), template))
    loss = unescape(F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]), ""), template)
    return out.withColumn("loss", loss).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "broken_at",
    )
