"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTENCE_BREAK = "\x1e"
#: What the pattern ``\\s`` matches.
WHITE = " \t\n\x0b\f\r"


def sentence_id(num: Column) -> Column:
    """The shown form of a sentence number: ``S`` and the number."""
    return F.concat(F.lit("S"), num.cast("string"))


def sentence_number(shown: Column) -> Column:
    """The number in ``S12``; null for anything else."""
    return F.when(shown.rlike("^S[0-9]+$"), F.substring(shown, 2, 20).try_cast("int"))


def span_slice(text: Column, start: Column, end: Column) -> Column:
    """``text[start:end)``; empty where the span is not inside the text."""
    bad = (start < 0) | (end > F.char_length(text)) | (start >= end)
    return F.when(bad, "").otherwise(F.substring(text, start + 1, end - start))


def last_position(text: Column, needle: Column, before: Column) -> Column:
    """Start of the last occurrence of ``needle`` that ends at or before ``before``; null without one."""
    head = F.substring(text, F.lit(1), F.greatest(before, F.lit(0)))
    at = F.instr(F.reverse(head), F.reverse(needle))
    return F.when((F.char_length(needle) > 0) & (at > 0), F.char_length(head) - at - F.char_length(needle) + 1)


def first_position(text: Column, needle: Column) -> Column:
    """Start of the first occurrence of a non-empty needle; null without one."""
    at = F.instr(text, needle)
    return F.when((F.char_length(needle) > 0) & (at > 0), at - 1)


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole``, 0 where the whole is 0."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def iou(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Intersection over union of two half-open spans, 0 where the union is empty."""
    both = overlap(a_start, a_end, b_start, b_end)
    return ratio(both, (a_end - a_start) + (b_end - b_start) - both)
