"""Benchmark decontamination by a distributed positional inverted index.

The index stores a posting (term, document key, position) for every training token that
is a word of the benchmark, and one end posting per document whose position is its
number of words.  Documents are indexed where they are scanned: building needs no
shuffle, and a word that no test item holds can never be part of a match.

Phrase search starts from the rarest term of each window: its postings give candidate
starts, which are intersected with the offset-adjusted list of the second-rarest term,
and what is left with the lists of all other terms.  So the long lists of common words
are only ever looked at for documents that two rare terms at the right distance have
picked.  Proximity search starts from the rarest term as well and asks for all others
within a distance.

Lists are joined by (document, position, term), never by a term alone, so a hot term or
a passage that a third of the documents hold spreads over all tasks.  The vocabulary,
the windows' rarest terms and the picked documents are broadcast only if their counted
size allows it; else the same joins shuffle.

Documents are keyed by two 64-bit hashes, of the id and of the text, so repeated rows
share their matches and each gets its own result row.  Defined results: a null text has
no words; a test item without words has no window; items with a null id are ignored; an
empty table of documents gives an empty table, an empty benchmark no hits.  Other
columns are not read.  Spark functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamtext.llm.common import ascii_lower, written

WINDOW = 8
DELIMITERS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The end posting's term; no word can hold this character.
END = "\x00"
#: Rows up to which a counted table is broadcast (some tens of MB).
BROADCAST_ROWS = 300_000
#: Bytes up to which the vocabulary, whose words have any length, is broadcast.
BROADCAST_BYTES = 32 << 20
KEY = ["k1", "k2"]


def words(c: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(c, F.lit(""))), DELIMITERS, -1), "")


def sized(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast if the counted rows allow it."""
    return F.broadcast(df) if rows <= limit else df


@dataclass
class Windows:
    """``terms(wid, n, off, term)``, ``items(wid, item)`` and the vocabulary, all written."""

    vocabulary: DataFrame
    terms: DataFrame
    items: DataFrame
    n_terms: int
    n_windows: int
    vocabulary_bytes: int


def windows_of(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> Windows:
    """All windows of ``window`` consecutive words; a shorter item is one window."""
    w = F.col("w")
    starts = F.sequence(F.lit(1), F.greatest(F.size(w) - window + 1, F.lit(1)))
    cut = (
        items.where(F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("w"))
        .where(F.size("w") > 0)
        .select("item", F.explode(F.transform(starts, lambda s: F.slice(w, s, window))).alias("phrase"))
    )
    cut = written(cut, "cut")
    known = cut.select(F.explode("phrase").alias("word")).union(cut.sparkSession.range(1).select(F.lit(END))).distinct()
    # numbers with gaps, given by each task on its own; written, so they are given once
    vocabulary = written(known.select("word", F.monotonically_increasing_id().alias("term")), "vocabulary")
    phrases = written(cut.select("phrase").distinct().select("phrase", F.monotonically_increasing_id().alias("wid")), "phrases")
    listed = written(cut.join(phrases, "phrase").select("wid", "item").distinct(), "window_items")
    placed = phrases.select("wid", F.size("phrase").alias("n"), F.posexplode("phrase").alias("off", "word"))
    terms = written(placed.join(vocabulary, "word").select("wid", "n", "off", "term"), "window_terms")
    size = vocabulary.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("word") + 24).alias("b")).first()
    return Windows(vocabulary, terms, listed, size.n, phrases.count(), size.b)


def build_index(docs: DataFrame, found: Windows, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings ``(term, pos, k1, k2, id)`` of the vocabulary's words, written."""
    keyed = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(F.lit(1), F.col(id_col)).alias("k1"),
        F.xxhash64(F.lit(2), F.col(text_col)).alias("k2"),
        F.array_append(words(F.col(text_col)), F.lit(END)).alias("w"),
    )
    tokens = keyed.select("id", "k1", "k2", F.posexplode("w").alias("pos", "word"))
    vocabulary = sized(found.vocabulary, found.n_terms) if found.vocabulary_bytes <= BROADCAST_BYTES else found.vocabulary
    return written(tokens.join(vocabulary, "word").select("term", "pos", "k1", "k2", "id"), "postings")


def ranked_terms(index: DataFrame, found: Windows) -> DataFrame:
    """The windows' terms with ``rank`` (1: rarest in the index); windows with an absent term go."""
    counts = index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    seen = sized(found.terms, found.n_windows * WINDOW).join(counts, "term")
    by_window = Window.partitionBy("wid")
    ranked = seen.withColumn("here", F.count(F.lit(1)).over(by_window)).where("here = n")
    return written(ranked.withColumn("rank", F.row_number().over(by_window.orderBy("df", "off"))).select("wid", "n", "off", "term", "rank"), "ranked")


def phrase_matches(index: DataFrame, found: Windows) -> DataFrame:
    """``(k1, k2, wid, n, start)`` of every exact occurrence, written."""
    ranked = ranked_terms(index, found)
    first = ranked.where("rank = 1").select("term", "wid", "n", F.col("off").alias("off1"))
    second = ranked.where("rank = 2").select("wid", F.col("off").alias("off2"), F.col("term").alias("term2"))
    plan = sized(first.join(second, "wid", "left"), found.n_windows)
    lists = index.select("term", "pos", *KEY)
    started = lists.join(plan, "term").withColumn("start", F.col("pos") - F.col("off1")).where("start >= 0")
    one = started.where("term2 is null").select(*KEY, "wid", "n", "start")
    wanted = started.where("term2 is not null").select(*KEY, "wid", "n", "start", (F.col("start") + F.col("off2")).alias("pos"), F.col("term2").alias("term"))
    second_lists = lists.join(sized(second.select(F.col("term2").alias("term")).distinct(), found.n_terms), "term", "left_semi")
    two = written(wanted.join(second_lists, [*KEY, "pos", "term"], "left_semi").select(*KEY, "wid", "n", "start").distinct(), "two_terms")
    rest = ranked.where("rank > 2").select("wid", "off", "term")
    picked = written(two.where("n > 2").select(*KEY).distinct(), "picked")
    n_picked = picked.count()
    near = lists.join(sized(rest.select("term").distinct(), found.n_terms), "term", "left_semi")
    if n_picked <= BROADCAST_ROWS:
        near = near.join(F.broadcast(picked), KEY, "left_semi")
    asked = two.where("n > 2").join(sized(rest, found.n_windows * WINDOW), "wid").withColumn("pos", F.col("start") + F.col("off"))
    agreed = (
        asked.join(near, [*KEY, "pos", "term"], "left_semi")
        .groupBy(*KEY, "wid", "n", "start")
        .agg(F.count(F.lit(1)).alias("k"))
        .where("k = n - 2")
        .select(*KEY, "wid", "n", "start")
    )
    return written(one.distinct().union(two.where("n = 2")).union(agreed), "matches")


def proximity_matches(index: DataFrame, found: Windows, distance: int) -> DataFrame:
    """``(k1, k2, wid, pos)``: all distinct terms of a window within ``distance`` of its rarest.

    ``pos`` is the place of the rarest term.  Lists meet by (document, term, block of
    positions), so a long list is not paired off with another.
    """
    ranked = ranked_terms(index, found)
    rarest = ranked.where("rank = 1").select("wid", F.col("term").alias("rare"))
    others = ranked.select("wid", "term").distinct().join(rarest, "wid").where("term <> rare").select("wid", "term")
    n_others = others.groupBy("wid").agg(F.count(F.lit(1)).alias("n_others"))
    lists = index.select("term", "pos", *KEY)
    at = lists.join(sized(rarest.withColumnRenamed("rare", "term"), found.n_windows), "term").select(*KEY, "wid", "pos")
    block = F.expr(f"pos div {max(distance, 1)}")
    asked = at.join(sized(others, found.n_windows * WINDOW), "wid").withColumn("block", F.explode(F.array(block - 1, block, block + 1)))
    held = lists.join(sized(others.select("term").distinct(), found.n_terms), "term", "left_semi").select(*KEY, "term", block.alias("block"), F.col("pos").alias("other"))
    met = asked.join(held, [*KEY, "term", "block"]).where(F.abs(F.col("pos") - F.col("other")) <= distance)
    counted = met.groupBy(*KEY, "wid", "pos").agg(F.count_distinct("term").alias("k"))
    alone = at.join(n_others, "wid", "left_anti").select(*KEY, "wid", "pos").distinct()
    return counted.join(sized(n_others, found.n_windows), "wid").where("k = n_others").select(*KEY, "wid", "pos").union(alone)


def hit_words(spans: Column) -> Column:
    """Words inside any of the sorted (start, n) spans."""
    empty = F.struct(F.lit(0).alias("total"), F.lit(0).alias("end"))

    def add(acc: Column, s: Column) -> Column:
        end = s.start + s.n
        fresh = F.greatest(F.lit(0), end - F.greatest(s.start, acc.end))
        return F.struct((acc.total + fresh).alias("total"), F.greatest(acc.end, end).alias("end"))

    return F.aggregate(spans, empty, add, lambda acc: acc.total)


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, min_items: int = 2) -> DataFrame:
    """Per row ``id_col, k1, k2, n_words, n_hit, n_items, item_ids, contaminated``."""
    found = windows_of(items, item_id_col, item_text_col, window)
    index = build_index(docs, found, id_col, text_col)
    matches = phrase_matches(index, found)
    spans = matches.groupBy(*KEY).agg(hit_words(F.array_sort(F.collect_set(F.struct("start", "n")))).alias("n_hit"))
    held = matches.select(*KEY, "wid").distinct().join(found.items, "wid").select(*KEY, F.col("item").cast("string").alias("item"))
    listed = held.groupBy(*KEY).agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    ends = index.join(F.broadcast(found.vocabulary.where(F.col("word") == END).select("term")), "term", "left_semi")
    none = F.array().cast("array<string>")
    return (
        ends.select(F.col("id"), *KEY, F.col("pos").cast("long").alias("n_words"))
        .join(spans.join(listed, KEY), KEY, "left")
        .select(
            F.col("id").alias(id_col),
            *KEY,
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.size(F.coalesce("item_ids", none)).cast("long").alias("n_items"),
            F.coalesce("item_ids", none).alias("item_ids"),
        )
        .withColumn("contaminated", F.col("n_items") >= min_items)
    )
