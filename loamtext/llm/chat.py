"""Chat formatting with Spark expressions only.

Per conversation: turn structs are collected and sorted, adjacent turns of one role
are merged under one header with array aggregation, and the pieces are concatenated.

Template::

    <|turn|>ROLE<|text|>TEXT[<|and|>TEXT ...]<|end|>

Roles and texts are escaped: ``\\`` becomes ``\\\\`` and ``<`` becomes ``\\l``.  So ``<``
occurs in control strings only and the output can be read back exactly; ``<|and|>``
keeps the borders of merged turns.

Turns are first formatted in blocks of ``BLOCK`` consecutive turn numbers, so that
one long conversation is formatted by many tasks; what then meets in one row is its
output string, which the result holds in one row anyway.

Defined results: a null text or role is the empty string; a null turn number sorts
first; equal turn numbers are ordered by role, then text; repeated rows are all kept;
rows with a null conversation id form a conversation of their own; an empty table
gives an empty table.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, AND, END = "<|turn|>", "<|text|>", "<|and|>", "<|end|>"
BLOCK = 256


def escaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l"))


def unescaped(c: Column) -> Column:
    """The reverse; U+0000 cannot stand in for a marker here, so pairs are read by splitting.

    ``\\\\`` is split off first, so that the ``l`` after it is never taken for an escape.
    """
    return F.array_join(F.transform(F.split(c, r"\\\\", -1), lambda x: F.replace(x, F.lit("\\l"), F.lit("<"))), "\\")


def _joined(parts: Column, opening: Column, closing: Column, body: Column) -> Column:
    """Bodies in order: one header for each run of parts whose roles meet.

    ``opening``, ``closing`` and ``body`` are arrays as long as ``parts`` with the role
    that a part begins with, the one that it ends with, and its text without the first
    header.  All arrays are made once per row; no lambda refers to another array, so the
    work is linear in the number of parts.
    """
    before = F.slice(F.concat(F.array(F.lit(None).cast("string")), closing), 1, F.size(parts))
    starts = F.zip_with(opening, before, lambda role, last: F.when(last.isNull(), F.concat(F.lit(TURN), role, F.lit(TEXT))).when(role == last, AND).otherwise(F.concat(F.lit(END + TURN), role, F.lit(TEXT))))
    return F.array_join(F.zip_with(starts, body, lambda start, text: F.concat(start, text)), "")


def _blocks(rows: DataFrame, block: int) -> DataFrame:
    """One row per conversation and block of turn numbers, formatted but for its ends."""
    turns = F.col("turns")
    roles = F.transform(turns, lambda t: t.role)
    whole = _joined(turns, roles, roles, F.transform(turns, lambda t: t.text))
    first = F.element_at(turns, 1).role
    return (
        rows.groupBy("cid", F.floor(F.col("turn") / block).alias("block"))
        .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
        .select(
            "cid",
            "block",
            first.alias("first"),
            F.element_at(turns, -1).role.alias("last"),
            F.substr(whole, F.char_length(first) + F.lit(len(TURN) + len(TEXT) + 1)).alias("body"),
        )
    )


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per conversation: ``conv_id`` and ``formatted``."""
    rows = turns.select(
        F.col(conv_col).alias("cid"),
        F.col(turn_col).alias("turn"),
        escaped(F.coalesce(F.col(role_col), F.lit(""))).alias("role"),
        escaped(F.coalesce(F.col(text_col), F.lit(""))).alias("text"),
    )
    parts = F.col("parts")
    whole = _joined(parts, F.transform(parts, lambda p: p.first), F.transform(parts, lambda p: p.last), F.transform(parts, lambda p: p.body))
    return (
        _blocks(rows, block)
        .groupBy("cid")
        .agg(F.sort_array(F.collect_list(F.struct("block", "first", "last", "body"))).alias("parts"))
        .select(F.col("cid").alias(conv_col), F.concat(whole, F.lit(END)).alias("formatted"))
    )


def read_back(formatted: DataFrame, col: str = "formatted") -> DataFrame:
    """Adds ``turns``, the array<struct<role, text>> that the output encodes."""
    pieces = F.filter(F.split(F.col(col), r"<\|end\|>", -1), lambda x: x != "")
    header = F.transform(pieces, lambda p: F.split(F.substr(p, F.lit(len(TURN) + 1)), r"<\|text\|>", 2))
    turns = F.flatten(
        F.transform(
            header,
            lambda h: F.transform(
                F.split(F.get(h, F.lit(1)), r"<\|and\|>", -1),
                lambda t: F.struct(unescaped(F.get(h, F.lit(0))).alias("role"), unescaped(t).alias("text")),
            ),
        )
    )
    return formatted.withColumn("turns", turns)


def loss_text(turns: Column, role: str = "assistant") -> Column:
    """All text under the loss mask: each text of ``role`` once, in order."""
    return F.concat_ws("", F.transform(F.filter(turns, lambda t: t.role == role), lambda t: t.text))
