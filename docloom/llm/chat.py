"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted, adjacent turns of one role are merged into a block, and
blocks are concatenated: ``<role>: text<+>text</turn>``, a block's texts parted by ``<+>``. Within roles and texts a
backslash becomes ``\\\\``, ``<`` becomes ``\\l``, ``#`` becomes ``\\h`` and, in roles, ``:`` becomes ``\\c``, so no control string can occur in them and
formatting is reversible.

Defined cases: a null text or role is empty; turns are ordered by (turn, role, text), null turns first, so repeated
and tied rows have one order; rows with a null conversation id form one conversation; no rows, no conversations;
other columns are ignored. A conversation is one output string, so it must fit into a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, HEAD_END, PART, TURN_END = "### ", ": ", "<+>", " </turn>\n"


def escaped(text: Column) -> Column:
    """``text`` without control characters of the template; ``unescaped`` undoes it."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("\\l")), F.lit("#"), F.lit("\\h"))


def unescaped(text: Column) -> Column:
    """The text before ``escaped``."""
    parts = F.transform(
        F.split(text, r"\\\\"),
        lambda p: F.replace(
            F.replace(F.replace(p, F.lit("\\l"), F.lit("<")), F.lit("\\h"), F.lit("#")), F.lit("\\c"), F.lit(":")
        ),
    )
    return F.array_join(parts, "\\")


def format_conversations(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conv_id, formatted): one string per conversation."""
    rows = df.select(
        F.col(conv).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            F.replace(escaped(F.coalesce(F.col(role).cast("string"), F.lit(""))), F.lit(":"), F.lit("\\c")).alias("role"),
            escaped(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text"),
        ).alias("t"),
    )
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    # A turn opens a block unless the turn before it has its role; it closes one unless the next has.
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice(F.transform("turns", lambda t: t.role), 1, F.size("turns") - 1))
    after = F.concat(F.slice(F.transform("turns", lambda t: t.role), 2, F.size("turns")), F.array(F.lit(None).cast("string")))
    pieces = F.transform(
        F.arrays_zip(F.col("turns").alias("t"), F.col("before").alias("before"), F.col("after").alias("after")),
        lambda z: F.concat(
            F.when(z.before.eqNullSafe(z.t.role), F.lit(PART)).otherwise(F.concat(F.lit(HEAD), z.t.role, F.lit(HEAD_END))),
            z.t.text,
            F.when(z.after.eqNullSafe(z.t.role), F.lit("")).otherwise(F.lit(TURN_END)),
        ),
    )
    return turns.withColumns({"before": before, "after": after}).select("conv_id", F.array_join(pieces, "").alias("formatted"))


def parse_conversations(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, blocks): what ``format_conversations`` wrote, read back.

    ``blocks`` is an array of (role, texts), unescaped; texts of role ``assistant`` are under the loss mask.
    """
    raw = F.filter(F.split("formatted", TURN_END.replace("\n", "\\n")), lambda b: b != "")
    blocks = F.transform(
        raw,
        lambda b: F.struct(
            unescaped(F.substring_index(F.substr(b, F.lit(len(HEAD) + 1)), HEAD_END, 1)).alias("role"),
            F.transform(
                F.split(F.substr(b, F.instr(b, HEAD_END) + len(HEAD_END)), r"<\+>"), unescaped
            ).alias("texts"),
        ),
    )
    return formatted.select("conv_id", "formatted", blocks.alias("blocks"))
