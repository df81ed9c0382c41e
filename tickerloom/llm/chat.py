"""Chat formatting: a finite-state machine over roles and a declarative template."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

#: Replacements that keep control strings out of texts, in the order in which they are made.
ESCAPES = (("&", "&amp;"), ("<|", "&lt;|"), ("|>", "|&gt;"))


@dataclass(frozen=True)
class Template:
    """How turns are written, and which roles may follow each other.

    A turn is `open`, the role, `after_role`, the text, `close`. The control strings must hold
    "<|" or "|>" where they begin or end, so that escaped texts cannot contain them.
    """

    open: str = "<|turn:"
    after_role: str = "|>\n"
    close: str = "<|end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("assistant",)


def escape(text: Column) -> Column:
    for plain, safe in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for plain, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def turn_state(roles: Column, template: Template) -> Column:
    """State after all roles; 'bad' once a role may not follow."""
    moves = F.map_from_arrays(*[F.array(*[F.lit(x) for x in part]) for part in zip(
        *[(f"{a}>{b}", b) for a, nexts in template.moves.items() for b in nexts], strict=True)])
    return F.aggregate(roles, F.lit(template.start), lambda state, role: F.coalesce(
        F.try_element_at(moves, F.concat(state, F.lit(">"), role)), F.lit("bad")))


def format_chats(turns: DataFrame, template: Template | None = None, conv_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, n_turns, valid, segments, formatted.

    Turns are put in order of (turn, role, text), NULLs first. segments is an array of (text, loss):
    markers and prompts have loss false, texts of a loss role have loss true, and the segments
    joined are `formatted`. valid tells whether the roles follow the template's moves and end in a
    final state; conversations that do not are formatted as well. A NULL text or role is empty; rows of a
    NULL conversation form one conversation. Repeated rows are turns of their own.
    Other columns are left out. A conversation is one cell of the result, so it must fit in one.
    """
    template = template or Template()
    empty = F.lit("")
    one = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), empty).alias("role"),
                   F.coalesce(F.col(text_col).cast("string"), empty).alias("text"))
    chats = turns.groupBy(F.col(conv_col).alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("__turns"))

    def segments(turn: Column) -> Column:
        loss = turn["role"].isin(*template.loss_roles)
        head = F.concat(F.lit(template.open), escape(turn["role"]), F.lit(template.after_role))
        return F.array(F.struct(head.alias("text"), F.lit(False).alias("loss")),
                       F.struct(escape(turn["text"]).alias("text"), loss.alias("loss")),
                       F.struct(F.lit(template.close).alias("text"), F.lit(False).alias("loss")))

    state = turn_state(F.col("__turns.role"), template)
    cut = chats.select("conv_id", F.size("__turns").cast("bigint").alias("n_turns"), state.isin(*template.final).alias("valid"),
                       F.flatten(F.transform("__turns", segments)).alias("segments"))
    return cut.withColumn("formatted", F.array_join("segments.text", ""))


def read_back(formatted: Column, template: Template | None = None) -> Column:
    """Turns (role, text) of a formatted conversation, unescaped."""
    template = template or Template()
    close, after = F.lit(template.close), F.lit(template.after_role)
    # Each turn ends with `close`, so the last part is empty.
    parts = F.split(formatted, r"\Q" + template.close + r"\E", -1)
    whole = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def turn(part: Column) -> Column:
        body = F.substring(part, F.lit(len(template.open) + 1), F.length(part))
        cut = F.instr(body, after)
        return F.struct(unescape(F.substring(body, F.lit(1), cut - 1)).alias("role"),
                        unescape(F.substring(body, cut + len(template.after_role), F.length(body))).alias("text"))

    return F.transform(whole, turn)
