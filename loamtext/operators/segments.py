"""Segments over sentences: validation, renumbering, repair, conversion, assembly.

A segment table has ``doc_id, idx, start_num, end_num`` (inclusive sentence numbers) or
``start, end`` (half-open characters).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamtext.functions import span_slice

SMALL_GAP = 3


def by_start(*more: str) -> Window:
    return Window.partitionBy("doc_id", *more).orderBy("start_num", "idx")


def validate(items: DataFrame, last_num: str = "n_sentences", first_num: int | str = 1, required: tuple[str, ...] = (), keys: tuple[str, ...] = (), more: tuple[tuple[Column, str], ...] = ()) -> DataFrame:
    """``doc_id, idx, error`` rows: missing keys, unreadable ids, range, order, overlap.

    ``start_num``/``end_num`` are null where an id is missing or unreadable.  ``keys`` names
    what sets lists of one document apart, ``more`` adds checks.
    """
    nxt = F.lead("start_num").over(by_start(*keys))
    least = F.col(first_num) if isinstance(first_num, str) else F.lit(first_num)
    out_of_range = lambda c: F.col(c).isNotNull() & ((F.col(c) < least) | (F.col(c) > F.col(last_num)))
    checks: list[tuple[Column, str]] = [
        (F.col("start_num").isNull(), "bad start_id"),
        (F.col("end_num").isNull(), "bad end_id"),
        (out_of_range("start_num"), "start_id out of range"),
        (out_of_range("end_num"), "end_id out of range"),
        (F.col("start_num") > F.col("end_num"), "start_id after end_id"),
        (nxt <= F.col("end_num"), "overlaps the next"),
    ]
    checks += [(F.coalesce(F.col(c) == "", F.lit(True)), f"missing {c}") for c in required]
    errors = F.array_compact(F.array(*(F.when(c, F.lit(m)) for c, m in (*checks, *more))))
    return items.select("doc_id", *keys, "idx", errors.alias("errors")).select("doc_id", *keys, "idx", F.explode("errors").alias("error"))


def validate_subjects(subjects: DataFrame, first_num: str, last_num: str, theme: bool = False, topics: bool = False) -> DataFrame:
    """``doc_id, item_no, idx, error`` for the subjects of items that run from ``first_num`` to ``last_num``.

    With ``theme`` and ``topics`` their keys must be there (``topics_is_list`` is null without
    one), and topics must be a list.
    """
    more = []
    if theme:
        more.append((F.col("theme").isNull(), "missing theme"))
    if topics:
        placed = F.col("start_num").isNotNull() & F.col("end_num").isNotNull()
        more.append((F.col("topics_is_list").isNull(), "missing topics"))
        more.append((placed & ~F.coalesce("topics_is_list", F.lit(False)), "topics not a list"))
    return validate(subjects, last_num, first_num, keys=("item_no",), more=tuple(more))


def rebase(items: DataFrame, first: str) -> DataFrame:
    """Chunk- or item-relative numbers to absolute ones: ``+ first - 1``; nulls stay."""
    return items.withColumns({c: F.col(c) + F.col(first) - 1 for c in ("start_num", "end_num")})


def rebase_clamped(items: DataFrame, numbers: str) -> DataFrame:
    """Relative numbers to those of the array ``numbers``, clamped to its ends; rows with a null go."""
    at = lambda c: F.element_at(numbers, F.greatest(F.lit(1), F.least(F.col(c), F.size(numbers))))
    return items.where("start_num is not null and end_num is not null").withColumns({"start_num": at("start_num"), "end_num": at("end_num")})


def fix_small_gaps(items: DataFrame, threshold: int = SMALL_GAP) -> DataFrame:
    """Gaps of 1 to ``threshold`` sentences are closed by the segment before; overlaps stay."""
    nxt = F.lead("start_num").over(by_start())
    gap = nxt - F.col("end_num") - 1
    return items.withColumn("end_num", F.when((gap > 0) & (gap <= threshold), nxt - 1).otherwise(F.col("end_num")))


def fix_all_gaps(items: DataFrame, first: str, last: str) -> DataFrame:
    """The segments of a node cover it: ends are stretched, every gap is closed."""
    w = by_start()
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n, rank = F.count(F.lit(1)).over(whole), F.row_number().over(w)
    nxt = F.lead("start_num").over(w)
    end = F.when(rank == n, F.col(last)).when(nxt - 1 > F.col("end_num"), nxt - 1).otherwise(F.col("end_num"))
    start = F.when(rank == 1, F.col(first)).otherwise(F.col("start_num"))
    return items.withColumns({"_end": end, "_start": start}).drop("start_num", "end_num").withColumnsRenamed({"_start": "start_num", "_end": "end_num"})


def merge_overlaps(segments: DataFrame, start: str = "start_num", end: str = "end_num") -> DataFrame:
    """Segments that reach the running end (inclusive) become one; themes joined by ``; ``."""
    w = Window.partitionBy("doc_id").orderBy(start, "idx")
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    grouped = segments.withColumn("opens", F.when(F.col(start) <= before, 0).otherwise(1)).withColumn("grp", F.sum("opens").over(w))
    themes = F.transform(F.array_sort(F.collect_list(F.struct(F.col(start).alias("s"), "idx", "theme"))), lambda x: x.theme)
    return grouped.groupBy("doc_id", "grp").agg(
        F.min(start).alias(start),
        F.max(end).alias(end),
        F.array_join(themes, "; ").alias("theme"),
        F.count(F.lit(1)).alias("n_merged"),
    )


def merge_anchored(items: DataFrame, tolerance: int) -> DataFrame:
    """Chunk results merged: an item whose start lies within ``tolerance`` of its group's
    first start joins the group; the longest title wins, the earlier one on ties.

    The anchor is the first start of a group, not its last, so this is a fold.
    """
    listed = items.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_num", "idx", "end_num", "title"))).alias("l"))
    kind = "array<struct<anchor:int,start_num:int,end_num:int,title:string>>"

    def add(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        fresh = F.struct(x.start_num.alias("anchor"), x.start_num.alias("start_num"), x.end_num.alias("end_num"), x.title.alias("title"))
        longer = F.char_length(x.title) > F.char_length(last.title)
        joined = F.struct(
            last.anchor.alias("anchor"),
            F.least(last.start_num, x.start_num).alias("start_num"),
            F.greatest(last.end_num, x.end_num).alias("end_num"),
            F.when(longer, x.title).otherwise(last.title).alias("title"),
        )
        return F.when((F.size(acc) > 0) & (x.start_num - F.try_element_at(acc, F.lit(-1)).anchor <= tolerance), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(fresh)))

    merged = F.aggregate("l", F.array().cast(kind), add)
    return listed.select("doc_id", F.posexplode(merged).alias("idx", "m")).select("doc_id", "idx", "m.start_num", "m.end_num", "m.title")


def to_spans(items: DataFrame, sentences: DataFrame) -> DataFrame:
    """``start, end`` of sentence ranges by two equi-joins; unknown numbers drop the row."""
    first = sentences.select("doc_id", F.col("sent_num").alias("start_num"), "start")
    last = sentences.select("doc_id", F.col("sent_num").alias("end_num"), "end")
    return items.join(first, ["doc_id", "start_num"]).join(last, ["doc_id", "end_num"])


def place(items: DataFrame, spans: DataFrame) -> DataFrame:
    """As :func:`to_spans`, from one row a document (:func:`sentences.spans`), dealt once."""
    at = lambda c: F.get("spans", F.col(c) - 1)
    found = items.join(spans, "doc_id").withColumns({"start": at("start_num")["start"], "end": at("end_num")["end"]})
    return found.where("start is not null and end is not null").drop("spans")


def with_text(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """The text of each span; an inverted span has the empty text."""
    full = docs.select("doc_id", F.col("text").alias("_full"))
    return spans.join(full, "doc_id").withColumn("text", span_slice(F.col("_full"), F.col("start"), F.col("end"))).drop("_full")


def annotate(items: DataFrame, sentences: DataFrame, docs: DataFrame) -> DataFrame:
    """:func:`to_spans` with the text of each span; an inverted span has the empty text."""
    return with_text(to_spans(items, sentences), docs)


def annotate_subjects(subjects: DataFrame, sentences: DataFrame, docs: DataFrame, offset: int = 0) -> DataFrame:
    """As :func:`annotate`, with sentence numbers moved by ``offset`` and default theme and topics."""
    return annotate(with_defaults(subjects, offset), sentences, docs)


def with_defaults(subjects: DataFrame, offset: int = 0) -> DataFrame:
    return subjects.withColumns(
        {
            "start_num": F.col("start_num") + offset,
            "end_num": F.col("end_num") + offset,
            "theme": F.coalesce("theme", F.lit("")),
            "topics": F.coalesce("topics", F.array().cast("array<string>")),
        }
    )


def covered(segments: DataFrame) -> DataFrame:
    """``doc_id, covered``: characters in the union of the segments."""
    w = Window.partitionBy("doc_id").orderBy("start", "end")
    before = F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), before))
    return segments.select("doc_id", fresh.alias("fresh")).groupBy("doc_id").agg(F.sum("fresh").alias("covered"))


def coverage(segments: DataFrame, docs: DataFrame) -> DataFrame:
    """``doc_id, covered, coverage`` for each document; 0 without segments or text."""
    n = F.char_length("text")
    joined = docs.select("doc_id", n.alias("n")).join(covered(segments), "doc_id", "left")
    part = F.coalesce("covered", F.lit(0))
    return joined.select("doc_id", part.alias("covered"), F.when(F.col("n") > 0, part / F.col("n")).otherwise(F.lit(0.0)).alias("coverage"))


def fallback_subjects(items: DataFrame, subjects: DataFrame) -> DataFrame:
    """Subjects, and the whole item as one for each item without any (``is_fallback``)."""
    missing = items.join(subjects.select("doc_id", "item_no").distinct(), ["doc_id", "item_no"], "left_anti")
    whole = missing.select("doc_id", "item_no", F.lit(0).alias("idx"), "start_num", "end_num", F.col("title").alias("theme"), F.lit(True).alias("is_fallback"))
    kept = subjects.select("doc_id", "item_no", "idx", "start_num", "end_num", "theme", F.lit(False).alias("is_fallback"))
    return kept.unionByName(whole)


def fallback_document(items: DataFrame, sentences: DataFrame, title: str = "Document") -> DataFrame:
    """Items, and one over all sentences for each document without any."""
    ends = sentences.groupBy("doc_id").agg(F.min("sent_num").alias("start_num"), F.max("sent_num").alias("end_num"))
    whole = ends.join(items.select("doc_id").distinct(), "doc_id", "left_anti")
    made = whole.select("doc_id", F.lit(0).alias("idx"), "start_num", "end_num", F.lit(title).alias("title"), F.lit(True).alias("is_fallback"))
    return items.select("doc_id", "idx", "start_num", "end_num", "title", F.lit(False).alias("is_fallback")).unionByName(made)


def extend_preface(items: DataFrame) -> DataFrame:
    """The first segment of a document starts at sentence 1."""
    first = F.row_number().over(by_start()) == 1
    return items.withColumn("start_num", F.when(first, F.lit(1)).otherwise(F.col("start_num")))


def leaves(nodes: DataFrame) -> DataFrame:
    """Nodes (``path ARRAY<INT>``) that are no other node's parent."""
    parents = nodes.where(F.size("path") > 1).select("doc_id", F.slice("path", F.lit(1), F.size("path") - 1).alias("path")).distinct()
    return nodes.join(parents, ["doc_id", "path"], "left_anti")


def tree_depth(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("doc_id").agg(F.max(F.size("path")).alias("depth"))


def nested(items: DataFrame, subjects: DataFrame) -> DataFrame:
    """One row per document: ``agenda_items`` with ``item_id`` from 1 and their subjects."""
    return nested_spans(items, subjects, "text")


def nested_spans(items: DataFrame, subjects: DataFrame, *text: str) -> DataFrame:
    """:func:`nested`; without ``text`` the spans alone, for :func:`texts_inside`."""
    subject = F.struct("idx", "theme", "topics", "start", "end", *text)
    mine = subjects.groupBy("doc_id", "item_no").agg(F.array_sort(F.collect_list(subject)).alias("subjects"))
    kind = dict(mine.dtypes)["subjects"]
    joined = items.join(mine, ["doc_id", "item_no"], "left").withColumn("subjects", F.coalesce("subjects", F.array().cast(kind)))
    item = F.struct("item_no", (F.col("item_no") + 1).alias("item_id"), F.col("title").alias("item_title"), "start", "end", *text, "subjects")
    return joined.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("agenda_items"))


def texts_inside(agenda_items: Column, full: Column) -> Column:
    """Items of :func:`nested_spans` with the texts of their spans, in the fields' order of :func:`nested`."""
    cut = lambda x: span_slice(full, x.start, x.end).alias("text")
    subject = lambda s: F.struct(s.idx.alias("idx"), s.theme.alias("theme"), s.topics.alias("topics"), s.start.alias("start"), s.end.alias("end"), cut(s))
    item = lambda i: F.struct(
        i.item_no.alias("item_no"), i.item_id.alias("item_id"), i.item_title.alias("item_title"), i.start.alias("start"), i.end.alias("end"), cut(i), F.transform(i.subjects, subject).alias("subjects")
    )
    return F.transform(agenda_items, item)


def statistics(docs: DataFrame, sentences: DataFrame, items: DataFrame, subjects: DataFrame) -> DataFrame:
    """Counts and coverage of a result per document; zero where there is nothing."""
    count = lambda df, name: df.groupBy("doc_id").agg(F.count(F.lit(1)).alias(name))
    out = docs.select("doc_id").join(coverage(subjects, docs), "doc_id")
    for df, name in ((sentences, "num_sentences"), (items, "num_items"), (subjects, "num_subjects")):
        out = out.join(count(df, name), "doc_id", "left")
    return out.fillna(0, ["num_sentences", "num_items", "num_subjects"])
