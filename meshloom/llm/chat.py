"""Chat formatting: a finite-state machine over roles and a declarative template, in Spark functions only.

The template names, for each role, what stands before and after a text and whether the text counts for the
loss. Control strings inside texts are escaped reversibly: a backslash becomes `\\e`, and `\\c` goes into
each control string after its first character. So no control string is left in a text, and the formatted
string can be cut into turns again.

Turns of a conversation are one row, as its digest and its formatted string are one value; conversations are
dealt over the tasks by their id.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Role:
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks begin with `<`, `[`, white space or nothing, and each `after` ends in a control string of its own."""

    begin: str = "<s>"
    roles: dict[str, Role] = field(default_factory=lambda: {"system": Role("[SYS] ", " [/SYS]"), "user": Role("[INST] ", " [/INST]"), "assistant": Role("[ANS] ", "</s>", loss=True)})
    #: For every other role: the role's name stands between the first two.
    other: tuple[str, str, str] = ("[ROLE] ", " [TEXT] ", " [/ROLE]")
    control: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ANS]", "[ROLE]", "[TEXT]", "[/ROLE]")
    #: What may follow each state; a turn's role is the next state.
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    #: States in which a conversation may end.
    ends: tuple[str, ...] = ("assistant",)


DEFAULT = Template()
_TURNS = "array<struct<role:string,text:string>>"
_SEGMENTS = "array<struct<text:string,loss:boolean>>"


def escape(text: Column, template: Template) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\e"))
    for c in template.control:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\c{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\c"), F.lit("")), F.lit("\\e"), F.lit("\\"))


def conversations_of(rows: DataFrame) -> DataFrame:
    """(conv_id, turns): the rows (conv_id, turn, role, text) in the order of turn, then role, then text, nulls first; null role and text are empty."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    gathered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return gathered.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def order_error(turns: Column, template: Template) -> Column:
    """The number, from 1, of the first turn that the machine doesn't allow; one more than all if it may not end there; else null."""
    state = F.struct(F.lit("start").alias("state"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("bad"))

    def step(acc, t):
        allowed = F.lit(False)
        for at, nexts in template.follows.items():
            allowed = allowed | ((acc["state"] == at) & t["role"].isin(*nexts))
        return F.struct(t["role"].alias("state"), (acc["n"] + 1).alias("n"), F.when(acc["bad"].isNull() & ~allowed, acc["n"] + 1).otherwise(acc["bad"]).alias("bad"))

    return F.aggregate(turns, state, step, lambda acc: F.when(acc["bad"].isNotNull(), acc["bad"]).when(~acc["state"].isin(*template.ends), acc["n"] + 1))


def segments_of(turns: Column, template: Template) -> Column:
    """Text segments with their loss flags: the beginning, then three for each turn."""

    def pick(t, value, other):
        out = None
        for name, role in template.roles.items():
            out = (F.when if out is None else out.when)(t["role"] == name, F.lit(value(role)))
        return out.otherwise(other)

    def turn(t):
        named = F.concat(F.lit(template.other[0]), escape(t["role"], template), F.lit(template.other[1]))
        parts = ((pick(t, lambda r: r.before, named), F.lit(False)), (escape(t["text"], template), pick(t, lambda r: r.loss, F.lit(False))), (pick(t, lambda r: r.after, F.lit(template.other[2])), F.lit(False)))
        return F.array(*[F.struct(text.alias("text"), loss.alias("loss")) for text, loss in parts])

    first = F.array(F.struct(F.lit(template.begin).alias("text"), F.lit(False).alias("loss")))
    return F.concat(first.cast(_SEGMENTS), F.flatten(F.transform(turns, turn)).cast(_SEGMENTS))


def _literal(mark: str) -> str:
    return "".join("\\" + c if c in "\\[](){}.*+?^$|/<>" else c for c in mark)


def turns_of(formatted: Column, template: Template) -> Column:
    """The turns, read back from a formatted string."""
    closing = [r.after for r in template.roles.values()] + [template.other[2]]
    body = F.substr(formatted, F.lit(len(template.begin) + 1))
    pieces = F.filter(F.split(body, "(?<=" + "|".join(_literal(c.strip()) for c in closing) + ")", -1), lambda p: p != "")

    def turn(p):
        out = None
        for name, role in template.roles.items():
            text = F.substr(p, F.lit(len(role.before) + 1), F.length(p) - len(role.before) - len(role.after))
            row = F.struct(F.lit(name).alias("role"), unescape(text).alias("text"))
            out = (F.when if out is None else out.when)(p.startswith(role.before), row)
        cut = F.instr(p, template.other[1])
        name = F.substr(p, F.lit(len(template.other[0]) + 1), cut - len(template.other[0]) - 1)
        text = F.substr(p, cut + len(template.other[1]), F.length(p) - cut - len(template.other[1]) - len(template.other[2]) + 1)
        return out.otherwise(F.struct(unescape(name).alias("role"), unescape(text).alias("text")))

    return F.transform(pieces, turn).cast(_TURNS)


def format_chats(rows: DataFrame, *, template: Template = DEFAULT) -> DataFrame:
    """(conv_id, n_turns, valid, first_error, segments, formatted) for each conversation in rows (conv_id, turn, role, text).

    Every conversation is formatted; valid tells whether the machine allows its order of roles and first_error
    is the number of the first turn it doesn't allow (or, for one that may not end there, the number of turns
    plus one). Null roles and texts are empty; a null conv_id is a conversation of its own; repeated turns all
    count, ordered by role and text; no rows give no rows. Other columns aren't read.
    """
    out = conversations_of(rows.select("conv_id", "turn", "role", "text"))
    out = out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), order_error(F.col("turns"), template).alias("first_error"), segments_of(F.col("turns"), template).alias("segments"))
    formatted = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    return out.select("conv_id", "n_turns", F.col("first_error").isNull().alias("valid"), "first_error", "segments", formatted.alias("formatted"))


def loss_text(segments: Column) -> Column:
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
