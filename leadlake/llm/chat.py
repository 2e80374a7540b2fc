"""Format conversations with a declarative template and a finite-state machine.

The template names the marks around a turn, the states that follow each role and
the roles that are trained on. The machine walks through the roles of a
conversation and rejects a turn out of order; the text is formatted all the same
and ``valid`` tells. Output segments carry the loss flag each.

Control strings inside texts are escaped reversibly: the escape character first,
then the first character of every control string. So an escaped text holds no
control string, and unescaping restores it.

Defined results: a null text or role is empty; rows are ordered by turn, null
turns first, then by role and text; rows without conv_id form one conversation, or
each its own with ``split_unnamed``, so that they are not gathered in one value;
repeated rows are turns of their own; an unknown role has no state, so the
conversation isn't valid; an empty table gives no rows. Only the four columns
named here are read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlake.llm.common import column


@dataclass(frozen=True)
class Template:
    head: str = "### "
    head_end: str = "\n"
    tail: str = "</turn>\n"
    #: Control strings, each with the sequence that stands for it inside texts; the escape character comes first.
    escapes: tuple[tuple[str, str], ...] = (("\\", "\\s"), ("</turn>", "\\l/turn>"), ("### ", "\\h## "))
    #: In role names the end of the head counts as well.
    role_escapes: tuple[tuple[str, str], ...] = (("\n", "\\n"),)
    start: str = "start"
    #: (state, role) to the next state.
    moves: dict[tuple[str, str], str] = field(default_factory=lambda: {
        ("start", "system"): "told", ("start", "user"): "asked", ("told", "user"): "asked",
        ("asked", "assistant"): "answered", ("answered", "user"): "asked",
    })
    final: tuple[str, ...] = ("answered",)
    trained: tuple[str, ...] = ("assistant",)


CHAT = Template()


def escape(text: Column, pairs) -> Column:
    for plain, escaped in pairs:
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def unescape(text: Column, pairs) -> Column:
    for plain, escaped in reversed(pairs):
        text = F.replace(text, F.lit(escaped), F.lit(plain))
    return text


def _moves(template: Template) -> Column:
    flat = [F.lit(x) for (state, role), to in template.moves.items() for x in (f"{state} {role}", to)]
    return F.create_map(*flat)


def format_conversations(
    turns: DataFrame, template: Template = CHAT, *, id_column: str = "conv_id", turn_column: str = "turn",
    role_column: str = "role", text_column: str = "text", split_unnamed: bool = False,
) -> DataFrame:
    """(conv_id, segments, formatted, valid): segments are (text, loss), formatted is all of them together.

    The turns of one conversation come together, as its text is one value.
    """
    turn = F.struct(
        column(turns, turn_column, "long").alias("turn"),
        F.coalesce(column(turns, role_column, "string"), F.lit("")).alias("role"),
        F.coalesce(column(turns, text_column, "string"), F.lit("")).alias("text"),
    )
    role_escapes = (*template.escapes, *template.role_escapes)

    def pieces(t: Column) -> Column:
        trained = t["role"].isin(*template.trained)
        head = F.concat(F.lit(template.head), escape(t["role"], role_escapes), F.lit(template.head_end))
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"], template.escapes).alias("text"), trained.alias("loss")),
            F.struct(F.lit(template.tail).alias("text"), F.lit(False).alias("loss")),
        )

    moves = _moves(template)
    state = F.aggregate(
        F.col("turns"), F.lit(template.start),
        lambda state, t: F.coalesce(moves[F.concat_ws(" ", state, t["role"])], F.lit("none")),
    )
    given = turns.select(column(turns, id_column, "long").alias("conv_id"), turn.alias("t"))
    named = given.filter("conv_id IS NOT NULL") if split_unnamed else given
    whole = named.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    if split_unnamed:
        whole = whole.unionByName(given.filter("conv_id IS NULL").select("conv_id", F.array("t").alias("turns")))
    return (
        whole
        .select("conv_id", F.flatten(F.transform("turns", pieces)).alias("segments"), state.isin(*template.final).alias("valid"))
        .select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "valid")
    )


def read_turns(formatted: Column, template: Template = CHAT) -> Column:
    """Array of (role, text) read back from a formatted conversation."""
    role_escapes = (*template.escapes, *template.role_escapes)
    parts = F.filter(F.split(formatted, f"\\Q{template.tail}\\E", -1), lambda p: F.length(p) > 0)

    def turn(part: Column) -> Column:
        cut = F.instr(part, template.head_end)
        start = len(template.head) + 1
        role = F.substring(part, F.lit(start), cut - start)
        text = F.substring(part, cut + len(template.head_end), F.length(part))
        return F.struct(unescape(role, role_escapes).alias("role"), unescape(text, template.escapes).alias("text"))

    return F.transform(parts, turn)


def trained_text(segments: Column, template: Template = CHAT) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], template.escapes)), "")
