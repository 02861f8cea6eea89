"""Chat formatting: a declarative template turns conversations into text segments with a loss flag each, and a
finite-state machine over roles tells which turns are in order.

The template says for each role what comes before and after its texts and whether they are learned; its marks hold control
strings, none of which can occur within a text, since there a backslash is put after the first character of each
(and before each backslash). So the formatted text alone tells the turns again. Roles that the template doesn't know
are written out, escaped in the same way.

A state of the machine is the last turn's role, so a turn's state needs its predecessor only: one window over the
conversation in order, without gathering it. Everything is DataFrame functions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Turn:
    """What a role's texts stand between, and whether they are learned."""

    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks of known roles, of other roles (before, between and after the role and the text), the control strings in
    them, the roles that may follow each state (None: the beginning) and the states that a conversation may end in."""

    turns: dict[str, Turn]
    other: tuple[str, str, str]
    controls: tuple[str, ...]
    follows: dict[str | None, tuple[str, ...]]
    ends: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        marks = [(t.before, t.after) for t in self.turns.values()] + [self.other[:2], self.other[1:]]
        for c in self.controls:
            if len(c) < 2 or "\\" in c:
                raise ValueError(f"a control string has two characters at least and no backslash: {c!r}")
            for k in range(1, len(c)):
                head, tail = c[:k], c[k:]
                if any(x.startswith(tail) or x.endswith(head) for x in self.controls if x != c) or c.endswith(head):
                    raise ValueError(f"{c!r} overlaps a control string")
                if any(before.endswith(head) or head.endswith(before) or after.startswith(tail) or tail.startswith(after) for before, after in marks):
                    raise ValueError(f"{c!r} could arise where a text meets its marks")
        for x in (y for pair in marks for y in pair):
            if not any(c in x for c in self.controls):
                raise ValueError(f"no control string in {x!r}")
        begins = [t.before for t in self.turns.values()] + [self.other[0]]
        if any(a is not b and a.startswith(b) for a in begins for b in begins):
            raise ValueError("two roles begin alike")


INSTRUCTIONS = Template(
    turns={"system": Turn("<<SYS>>\n", "\n<</SYS>>\n"), "user": Turn("[INST] ", " [/INST]"), "assistant": Turn("<s> ", " </s>", loss=True)},
    other=("[ROLE] ", " [/ROLE] ", " [/TURN]"),
    controls=("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "[ROLE]", "[/ROLE]", "[/TURN]"),
    follows={None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    ends=("assistant",),
)


def _plain(text: str) -> str:
    """A regular expression for this text alone, as Java reads it."""
    return re.sub(r"[^A-Za-z0-9]", lambda m: f"\\x{{{ord(m[0]):x}}}", text)


def escaped(text: Column, template: Template) -> Column:
    """The text without control strings: a backslash after each backslash and after the first character of each."""
    heads: dict[str, list[str]] = {}
    for c in template.controls:
        heads.setdefault(c[0], []).append(_plain(c[1:]))
    starts = [f"{_plain(head)}(?={'|'.join(rest)})" for head, rest in heads.items()]
    return F.regexp_replace(text, "|".join([r"\x{5c}", *starts]), r"$0\\")


def unescaped(text: Column) -> Column:
    """What escaped() was given."""
    return F.regexp_replace(text, r"(?s)\x{5c}(.)", "$1")


def ordered(conversations: DataFrame, template: Template) -> DataFrame:
    """conv_id, place (from 0), role, text, allowed: whether the machine has a way to this turn from the one before, and
    last: whether the conversation ends here."""
    rows = conversations.select(
        conversations["conv_id"].cast("long").alias("conv_id"),
        conversations["turn"].cast("long").alias("turn"),
        *(F.coalesce(conversations[x].cast("string"), F.lit("")).alias(x) for x in ("role", "text")),
    )
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    ways = [F.col("state").eqNullSafe(F.lit(state)) & F.col("role").isin(*roles) for state, roles in template.follows.items() if state is not None]
    ways.append((F.col("place") == 0) & F.col("role").isin(*template.follows[None]))
    allowed = ways[0]
    for way in ways[1:]:
        allowed = allowed | way
    return rows.select(
        "conv_id", (F.row_number().over(in_order) - 1).alias("place"), "role", "text", F.lag("role").over(in_order).alias("state"), F.lead("role").over(in_order).isNull().alias("last")
    ).select("conv_id", "place", "role", "text", allowed.alias("allowed"), "last")


def segments(conversations: DataFrame, template: Template = INSTRUCTIONS) -> DataFrame:
    """conv_id, place, segment (from 0 in its turn), text, loss and allowed: the formatted conversations, by segment.

    Turns are in ascending order (null first), ties by role and text; null texts and roles are empty; rows with a null
    conv_id are one conversation; a turn out of order is formatted too and not allowed, and the last turn isn't either
    unless its role may end a conversation. An empty table gives no rows; further columns are left behind.
    """
    piece = lambda text, loss=False: F.struct(text.alias("text"), F.lit(loss).alias("loss"))
    text = escaped(F.col("text"), template)
    other = [piece(F.lit(template.other[0])), piece(escaped(F.col("role"), template)), piece(F.lit(template.other[1])), piece(text), piece(F.lit(template.other[2]))]
    pieces = F.array(*other)
    for role, turn in template.turns.items():
        pieces = F.when(F.col("role") == role, F.array(piece(F.lit(turn.before)), piece(text, turn.loss), piece(F.lit(turn.after)))).otherwise(pieces)
    allowed = F.col("allowed") & (~F.col("last") | F.col("role").isin(*template.ends))
    turns = ordered(conversations, template).select("conv_id", "place", allowed.alias("allowed"), F.posexplode(pieces).alias("segment", "piece"))
    return turns.select("conv_id", "place", "segment", "piece.text", "piece.loss", "allowed")


def turns_of(formatted: Column, template: Template = INSTRUCTIONS) -> Column:
    """The turns (role, text) of a formatted conversation, from its text alone."""
    marks = [(turn.before, turn.after) for turn in template.turns.values()] + [(template.other[0], template.other[2])]
    found = F.regexp_extract_all(formatted, F.lit("(?s)" + "|".join(f"{_plain(before)}.*?{_plain(after)}" for before, after in marks)), F.lit(0))

    def within(x: Column, before: str, after: str) -> Column:
        return F.substring(x, len(before) + 1, F.length(x) - len(before) - len(after))

    def turn(x: Column) -> Column:
        first, between, last = template.other
        named = within(x, first, last)
        told = F.struct(unescaped(F.substring_index(named, between, 1)).alias("role"), unescaped(F.substring(named, F.locate(between, named) + len(between), F.length(named))).alias("text"))
        for role, t in template.turns.items():
            told = F.when(x.startswith(t.before), F.struct(F.lit(role).alias("role"), unescaped(within(x, t.before, t.after)).alias("text"))).otherwise(told)
        return told

    return F.transform(found, turn)


def read_back(formatted: DataFrame, template: Template = INSTRUCTIONS) -> DataFrame:
    """conv_id, formatted, turns (role, text), learned (the unescaped texts under the loss mask, in order) and
    in_order (all turns allowed), of the segments of each conversation."""
    parts = F.array_sort(F.collect_list(F.struct("place", "segment", "text", "loss")))
    whole = formatted.groupBy("conv_id").agg(parts.alias("parts"), F.bool_and("allowed").alias("in_order"))
    text = F.concat_ws("", F.transform("parts", lambda x: x["text"]))
    learned = F.transform(F.filter("parts", lambda x: x["loss"]), lambda x: unescaped(x["text"]))
    return whole.select("conv_id", "in_order", text.alias("formatted"), learned.alias("learned")).select("conv_id", "formatted", turns_of(F.col("formatted"), template).alias("turns"), "learned", "in_order")


def digests(formatted: DataFrame, template: Template = INSTRUCTIONS) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars and in_order, read from the segments. A
    digest of a conversation needs it whole, so one conversation has to fit a row here (segments() doesn't need that)."""
    line = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    learned = F.concat_ws("", "learned")
    return read_back(formatted, template).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(line.cast("binary"), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "in_order",
    )


def stored(conversations: DataFrame, template: Template = INSTRUCTIONS) -> DataFrame:
    """The segments, written to a table of the shared folder and read from there."""
    return common.written(segments(conversations, template), "chat-segments")


#: A conversation whose texts are control strings.
PROBE = (-7, "</s>[INST] ok [/INST]")


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and PROBE's: a user's turn and an assistant's."""
    rows = conversations.select("conv_id", "turn", "role", "text")
    conv_id, text = PROBE
    probe = conversations.sparkSession.range(2).select(F.lit(conv_id).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    return rows.unionByName(probe)


def _oracle() -> str:
    """The digests in SQL, with escapes by plain replacements."""
    text, role = "replace(coalesce(text, ''), '\\', '\\\\')", "replace(coalesce(role, ''), '\\', '\\\\')"
    for c in INSTRUCTIONS.controls:
        text, role = (f"replace({x}, '{c}', '{c[0]}\\{c[1:]}')" for x in (text, role))
    marks = "".join(f" WHEN '{name}' THEN {len(t.before) + len(t.after)}" for name, t in INSTRUCTIONS.turns.items())
    follows = "".join(f" WHEN {state!r} THEN role IN ({', '.join(repr(r) for r in roles)})" for state, roles in INSTRUCTIONS.follows.items() if state is not None)
    begins = ", ".join(repr(r) for r in INSTRUCTIONS.follows[None])
    ends = ", ".join(repr(r) for r in INSTRUCTIONS.ends)
    return f"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT {PROBE[0]}, 0, 'user', '{PROBE[1]}' UNION ALL SELECT {PROBE[0]}, 1, 'assistant', '{PROBE[1]}'),
e AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
  length({text}) + CASE role{marks} ELSE {sum(map(len, INSTRUCTIONS.other))} + length({role}) END AS chars FROM c),
o AS (SELECT *, lag(role) OVER w AS state, lead(role) OVER w AS next, row_number() OVER w AS place FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
f AS (SELECT *, CASE WHEN place = 1 THEN role IN ({begins}) ELSE CASE state{follows} ELSE FALSE END END AND (next IS NOT NULL OR role IN ({ends})) AS allowed FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars, bool_and(allowed) AS in_order FROM f GROUP BY conv_id
"""


ORACLE = _oracle()
