"""Chat formatting by relational steps only.

Turns of a conversation are collected as structs, sorted by turn, adjacent turns
of one role are merged into one block, and blocks are concatenated:

    <s>[role]text[+]text[/role]</s>

``[+]`` parts the turns that were merged, so nothing is lost. Every character
that a mark is made of (``<``, ``[``, ``]``) and every backslash inside a role or a text
gets a backslash before it, so no text can forge a mark, and the escape is undone
exactly on reading. Text of assistant turns is under the loss mask.

Defined results: a null text is empty; a null role is the role ``""``; turns with
equal numbers are ordered by role, then text; rows that repeat are turns of their
own; a null conversation id is one conversation of its own; an empty table gives
an empty result. Columns beyond the four named ones are not read. One conversation
is one output text, so it has to fit a row; nothing else is gathered by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, PART = "<s>", "</s>", "[+]"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\<\[\]])", r"\\$1")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def format_chats(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conv, formatted): one text for each conversation."""
    sorted_turns = (
        turns.select(
            F.col(conv).alias("conv"),
            F.struct(
                F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                F.coalesce(F.col(text), F.lit("")).alias("text"),
            ).alias("t"),
        )
        .groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    )

    def head(t: Column) -> Column:
        return F.concat(F.lit(f"{START}["), escape(t["role"]), F.lit("]"))

    def tail(t: Column) -> Column:
        return F.concat(F.lit("[/"), escape(t["role"]), F.lit(f"]{END}"))

    # a turn opens a block where its role differs from the turn before, and closes one where it differs from the next
    piece = F.transform(
        "ts",
        lambda t, i: F.concat(
            F.when((i == 0) | (F.get("ts", i - 1)["role"] != t["role"]), head(t)).otherwise(F.lit(PART)),
            escape(t["text"]),
            F.when((i == F.size("ts") - 1) | (F.get("ts", i + 1)["role"] != t["role"]), tail(t)).otherwise(F.lit("")),
        ),
    )
    return sorted_turns.select(F.col("conv").alias(conv), F.array_join(piece, "").alias("formatted"))


#: A run of escaped and of plain characters. Possessive, so that long texts need no deep recursion.
_INSIDE = r"[^\\<\[\]]*+(?:\\.[^\\<\[\]]*+)*+"


def read_chats(chats: DataFrame, conv: str = "conv_id", formatted: str = "formatted") -> DataFrame:
    """Back to turns, from the formatted text alone: (conv, formatted, turns array<struct<role, text>>)."""
    blocks = F.regexp_extract_all(
        F.col(formatted), F.lit(rf"(?s)<s>\[{_INSIDE}\]{_INSIDE}(?:\[\+\]{_INSIDE})*+\[/{_INSIDE}\]</s>"), F.lit(0)
    )

    def split(block: Column) -> Column:
        role = F.regexp_extract(block, rf"(?s)\[/({_INSIDE})\]</s>$", 1)
        body = F.substring(
            block, F.length(role) + len(START) + 3,
            F.length(block) - 2 * F.length(role) - len(START) - len(END) - 5,
        )
        parts = F.regexp_extract_all(F.concat(F.lit(PART), body), F.lit(rf"(?s)\[\+\]({_INSIDE})"), F.lit(1))
        return F.transform(parts, lambda p: F.struct(unescape(role).alias("role"), unescape(p).alias("text")))

    return chats.select(
        F.col(conv), F.col(formatted), F.flatten(F.transform(blocks, split)).alias("turns")
    )


def loss_text(turns: Column, role: str = "assistant") -> Column:
    """All text under the loss mask, in order, with nothing between."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == role), lambda t: t["text"]), "")
