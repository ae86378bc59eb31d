r"""Chat formatting: a template as data, a finite-state machine over roles, segments with loss flags.

A turn becomes opening mark + escaped text + closing mark. Marks are control strings; in texts a
backslash is doubled and a backslash goes behind the first sign of each control string, so that no
control string stands in an escaped text, and dropping one backslash of each restores the text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """marks: opening mark, closing mark, loss flag by role. other: marks around role and text of any
    other role. after: roles allowed behind a role ("" is the start); ends: roles a conversation may end on."""

    marks: dict = field(default_factory=lambda: {
        "system": ("[SYS]", "[/SYS]", False), "user": ("[INST]", "[/INST]", False),
        "assistant": ("<s>", "</s>", True), "tool": ("[TOOL]", "[/TOOL]", False)})
    other: tuple = ("[ROLE]", "[TEXT]", "[/TEXT]")
    after: dict = field(default_factory=lambda: {
        "": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "tool"), "tool": ("assistant", "tool")})
    ends: tuple = ("assistant",)

    def controls(self) -> list[str]:
        return [m for first, last, _ in self.marks.values() for m in (first, last)] + list(self.other)


DEFAULT = Template()


def _java_quote(text: str) -> str:
    return re.sub(r"([\\\[\](){}.*+?^$|<>/])", r"\\\1", text)


def escape(text: Column, template: Template = DEFAULT) -> Column:
    """Text without control strings; `unescape` undoes it."""
    marks = "|".join(f"({_java_quote(c[0])})({_java_quote(c[1:])})" for c in template.controls())
    groups = len(template.controls())
    first, rest = ("".join(f"${2 * i + k}" for i in range(groups)) for k in (1, 2))
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, marks, f"{first}\\\\{rest}")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def format_chats(turns: DataFrame, template: Template = DEFAULT, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """One row per conversation: conv_id, segments (text, loss), n_turns, valid, bad_turn.

    Turns are in order of turn (null first), then role, then text, so ties and repeated rows have a
    defined place and all stay. Null role and null text are empty; a null conversation is one
    conversation. valid: each role may follow the one before and the last may end; bad_turn: position
    (from 0) of the first turn that may not follow, else null. Invalid conversations are formatted all
    the same; the caller decides. An empty table gives no rows; other columns are not looked at.

    Escaping runs before the shuffle. A conversation is one row of its result by definition.
    """
    role = F.coalesce(F.col(role_col), F.lit(""))
    text = escape(F.coalesce(F.col(text_col), F.lit("")), template)
    row, _, last = template.other
    opening, closing, loss = F.concat(F.lit(row), escape(role, template), F.lit(template.other[1])), F.lit(last), F.lit(False)
    for name, (first, end, flag) in template.marks.items():
        opening = F.when(role == name, F.lit(first)).otherwise(opening)
        closing = F.when(role == name, F.lit(end)).otherwise(closing)
        loss = F.when(role == name, F.lit(flag)).otherwise(loss)
    one = F.struct(F.col(turn_col).alias("turn"), role.alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("plain"),
                   opening.alias("opening"), text.alias("text"), closing.alias("closing"), loss.alias("loss"))
    chats = turns.groupBy(F.col(conv_col).alias("conv_id")).agg(F.array_sort(F.collect_list(one)).alias("turns"))
    chats = chats.withColumn("roles", F.transform("turns", lambda t: t["role"]))

    def follows(role, i):
        allowed = F.lit(False)
        for state, nexts in template.after.items():
            before = F.get("roles", i - 1) == state if state else i == 0
            allowed = allowed | (before & role.isin(*nexts))
        return F.coalesce(allowed, F.lit(False))

    bad = F.array_position(F.transform("roles", follows), False)
    flagged = F.flatten(F.transform("turns", lambda t: F.when(t["loss"], F.array(
        F.struct(t["opening"].alias("text"), F.lit(False).alias("loss")),
        F.struct(t["text"].alias("text"), F.lit(True).alias("loss")),
        F.struct(t["closing"].alias("text"), F.lit(False).alias("loss")))).otherwise(
        F.array(F.struct(F.concat(t["opening"], t["text"], t["closing"]).alias("text"), F.lit(False).alias("loss"))))))
    return chats.select("conv_id", flagged.alias("segments"), F.size("turns").cast("long").alias("n_turns"),
                        ((bad == 0) & F.element_at("roles", -1).isin(*template.ends)).alias("valid"),
                        F.when(bad > 0, bad - 1).alias("bad_turn"))


def formatted(segments: Column) -> Column:
    """The whole text of a conversation."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def loss_text(segments: Column) -> Column:
    """What stands under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def parse_turns(text: Column, template: Template = DEFAULT) -> Column:
    """Turns (role, text) of a formatted text."""
    ends = "|".join(_java_quote(m) for m in [last for _, last, _ in template.marks.values()] + [template.other[2]])
    pieces = F.split(text, ends)
    row, mid, _ = template.other

    def turn(piece):
        at = F.instr(piece, mid)
        role, body = F.substring(piece, F.lit(len(row) + 1), at - len(row) - 1), F.substring(piece, at + len(mid), F.length(piece))
        for name, (first, _, _) in template.marks.items():
            role = F.when(piece.startswith(first), F.lit(name)).otherwise(role)
            body = F.when(piece.startswith(first), F.substring(piece, F.lit(len(first) + 1), F.length(piece))).otherwise(body)
        return F.struct(unescape(role).alias("role"), unescape(body).alias("text"))

    return F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), turn)
