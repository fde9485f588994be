"""True segments from annotated minutes.

``items``: ``doc_id, item_no, title``; ``subjects``: ``doc_id, item_no, idx, start, end``
(and what else they carry); ``docs``: ``doc_id, text``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamtext.functions import last_position, span_slice

_LEADING_NUMBER = r"^[0-9]+[.\s]+"


def flatten_subjects(documents: DataFrame) -> DataFrame:
    """Items x subjects of nested documents (``doc_id, agenda_items``), unnested in order."""
    items = documents.select("doc_id", F.posexplode("agenda_items").alias("item_no", "item"))
    return items.select("doc_id", "item_no", F.posexplode("item.subjects").alias("idx", "subject")).select("doc_id", "item_no", "idx", "subject.*")


def title_position(text: Column, title: Column, before: Column) -> Column:
    """Last occurrence of the title that ends before ``before``, else of it without its number."""
    bare = F.regexp_replace(F.regexp_replace(title, _LEADING_NUMBER, ""), r"^\s+|\s+$", "")
    return F.coalesce(last_position(text, title, before), last_position(text, bare, before))


def last_places(titles: DataFrame, docs: DataFrame) -> DataFrame:
    """``doc_id, idx, pos``: the last occurrence of each title that ends at or before ``before``;
    null without one (``titles``: doc_id, idx, title, before).

    One row a document and a search backwards from each place: a text is neither copied nor
    turned for each of its titles.
    """
    given = F.struct("idx", F.coalesce("title", F.lit("")).alias("title"), F.greatest(F.coalesce("before", F.lit(0)), F.lit(0)).alias("before"))
    listed = titles.groupBy("doc_id").agg(F.collect_list(given).alias("l"))
    joined = docs.join(listed.hint("shuffle_hash"), "doc_id")

    @F.pandas_udf("array<int>")
    def places(texts: pd.Series, titles: pd.Series, ends: pd.Series) -> pd.Series:
        def search(text, needles, stops) -> list[int | None]:
            found = (text.rfind(n, 0, int(e)) if text is not None and n else -1 for n, e in zip(needles, stops))
            return [None if at < 0 else at for at in found]

        return pd.Series([search(*row) for row in zip(texts, titles, ends)], dtype=object)

    at = places("text", F.transform("l", lambda x: x.title), F.transform("l", lambda x: x.before)).alias("at")
    rows = joined.select("doc_id", F.transform("l", lambda x: x.idx).alias("idx"), at)
    return rows.select("doc_id", F.explode(F.arrays_zip("idx", "at")).alias("m")).select("doc_id", "m.idx", F.col("m.at").alias("pos"))


def item_spans(items: DataFrame, subjects: DataFrame, docs: DataFrame) -> DataFrame:
    """``start, end`` for each item with a fully placed subject, null for others.

    start: the title's position or the first subject's start; end: the last subject's end.
    """
    valid = subjects.where("start is not null and end is not null")
    ends = valid.groupBy("doc_id", "item_no").agg(F.min("start").alias("first"), F.max("end").alias("last"))
    joined = items.join(ends, ["doc_id", "item_no"], "left").join(docs.select("doc_id", F.col("text").alias("_full")), "doc_id")
    start = F.coalesce(title_position(F.col("_full"), F.col("title"), F.col("first")), F.col("first"))
    return joined.select(*items.columns, F.when(F.col("first").isNotNull(), start).cast("int").alias("start"), F.col("last").alias("end"))


def body_span(spans: DataFrame) -> DataFrame:
    """``doc_id, body_start, body_end`` of documents with a placed item (title-aware)."""
    return spans.where("start is not null").groupBy("doc_id").agg(F.min("start").alias("body_start"), F.max("end").alias("body_end"))


def plain_body_span(subjects: DataFrame) -> DataFrame:
    """Least start and greatest end, nulls ignored one by one; null if either is missing."""
    both = subjects.groupBy("doc_id").agg(F.min("start").alias("s"), F.max("end").alias("e"))
    known = F.col("s").isNotNull() & F.col("e").isNotNull()
    return both.select("doc_id", F.when(known, F.col("s")).alias("body_start"), F.when(known, F.col("e")).alias("body_end"))


def trim_to_body(docs: DataFrame, body: DataFrame) -> DataFrame:
    """The text cut to the body span; a span out of range keeps the text (``body_status``)."""
    joined = docs.join(body, "doc_id", "left")
    fits = (F.col("body_start") >= 0) & (F.col("body_end") <= F.char_length("text"))
    status = F.when(F.col("body_start").isNull(), "none").when(fits, "trimmed").otherwise("out of range")
    trimmed = span_slice(F.col("text"), F.col("body_start"), F.col("body_end"))
    return joined.withColumn("body_status", status).select(
        "doc_id",
        F.when(F.col("body_status") == "trimmed", trimmed).otherwise(F.col("text")).alias("text"),
        F.when(F.col("body_status") == "trimmed", F.col("body_start")).otherwise(0).alias("body_offset"),
        "body_status",
    )


def rebase(spans: DataFrame, trimmed: DataFrame) -> DataFrame:
    """Offsets less the document's ``body_offset``; nulls stay null."""
    joined = spans.join(trimmed.select("doc_id", "body_offset"), "doc_id")
    return joined.withColumns({c: F.col(c) - F.col("body_offset") for c in ("start", "end")}).drop("body_offset")


def offset_status(subjects: DataFrame, docs: DataFrame) -> DataFrame:
    """``status`` of each subject's offsets against its text: null, invalid, exact, contained, mismatch, no text."""
    joined = subjects.join(docs.select("doc_id", F.col("text").alias("_full")), "doc_id")
    n, text = F.char_length("_full"), F.coalesce(F.col("text"), F.lit(""))
    cut = span_slice(F.col("_full"), F.col("start"), F.col("end"))
    status = (
        F.when(F.col("start").isNull() | F.col("end").isNull(), "null")
        .when((F.col("start") < 0) | (F.col("end") > n) | (F.col("start") >= F.col("end")), "invalid")
        .when(text == "", "no text")
        .when(cut == text, "exact")
        .when(cut.contains(text) | text.contains(cut), "contained")
        .otherwise("mismatch")
    )
    return joined.withColumn("status", status).drop("_full")
