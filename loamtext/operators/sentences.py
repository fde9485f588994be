"""Text to sentences: splitting, offsets, merging of list markers, prompt lines.

All tables are keyed by ``doc_id``; the running sums use one exchange by it, which the
operators that follow reuse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamtext.functions import SENTENCE_BREAK, WHITE

#: A sentence ends with end marks and white space, or with line breaks.
TERMINATOR = r"([.!?]+\s+|\n+)"
#: A line that is a list marker and nothing else: numbers, letters, roman numerals,
#: dashes, bullets, section signs.
MARKER = r"(?i)^\s*(?:[0-9]+(?:\.[0-9]+)*[.)]?|[a-z][.)]|[ivxlcdm]+[.)]|[-–—•*·]|§+\s*[0-9]*)\s*$"


def pieces(docs: DataFrame, text_col: str = "text", terminator: str = TERMINATOR) -> DataFrame:
    """``doc_id, pos, raw``: the text cut after every terminator; nothing is lost."""
    marked = F.regexp_replace(F.col(text_col), terminator, "$1" + SENTENCE_BREAK)
    return docs.select("doc_id", F.posexplode(F.split(marked, SENTENCE_BREAK, -1)).alias("pos", "raw"))


def numbered(cut: DataFrame) -> DataFrame:
    """``doc_id, sent_num, text, start, end`` from pieces: blank ones advance offsets only.

    Numbers are dense and start at 1; offsets count code points, half-open; ``end``
    leaves trailing white space out.
    """
    by_doc = Window.partitionBy("doc_id").orderBy("pos")
    body = F.rtrim("raw", F.lit(WHITE))
    # lengths are taken before the exchange, so the text is dealt only to readers of it
    measured = cut.select("doc_id", "pos", F.ltrim(body, F.lit(WHITE)).alias("text"), F.char_length("raw").alias("n"), F.char_length(body).alias("n_body"))
    placed = measured.select(
        "doc_id",
        "text",
        "n_body",
        (F.sum("n").over(by_doc) - F.col("n")).cast("int").alias("start"),
        F.sum(F.when(F.col("n_body") == 0, 0).otherwise(1)).over(by_doc).cast("int").alias("sent_num"),
    )
    return placed.where("n_body > 0").select("doc_id", "sent_num", "text", "start", (F.col("start") + F.col("n_body")).alias("end"))


def split_sentences(docs: DataFrame, text_col: str = "text", terminator: str = TERMINATOR) -> DataFrame:
    """Sentences with offsets in one plan; a blank or null text has none."""
    some = docs.where(F.col(text_col).rlike(r"\S"))
    return numbered(pieces(some, text_col, terminator))


def texts(text: Column, terminator: str = TERMINATOR) -> Column:
    """The texts of :func:`split_sentences` as one array, in order: no exchange, no sort."""
    marked = F.regexp_replace(text, terminator, "$1" + SENTENCE_BREAK)
    return F.filter(F.transform(F.split(marked, SENTENCE_BREAK, -1), lambda x: F.trim(x, F.lit(WHITE))), lambda x: x != "")


def spans(sentences: DataFrame) -> DataFrame:
    """``doc_id, spans``: a document's offsets in the order of its sentences, one row each."""
    listed = sentences.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sent_num", "start", "end"))).alias("l"))
    return listed.select("doc_id", F.transform("l", lambda x: F.struct(x.start.alias("start"), x.end.alias("end"))).alias("spans"))


def split_with(docs: DataFrame, splitter, text_col: str = "text") -> DataFrame:
    """Sentences from a user's splitter: ``splitter(iterator of pandas frames)`` yields
    ``doc_id, pos, raw`` with ``raw`` adding up to the text (a model-based splitter)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return numbered(docs.select("doc_id", text_col).mapInPandas(splitter, f"doc_id {id_type}, pos int, raw string"))


def merge_markers(cut: DataFrame, marker: str = MARKER) -> DataFrame:
    """Pieces whose predecessor is a bare list marker are joined to it (pieces in, pieces out)."""
    by_doc = Window.partitionBy("doc_id").orderBy("pos")
    after = F.coalesce(F.lag(F.col("raw").rlike(marker)).over(by_doc), F.lit(False))
    grouped = cut.withColumn("after", after).withColumn("grp", F.sum(F.when(F.col("after"), 0).otherwise(1)).over(by_doc))
    return grouped.groupBy("doc_id", "grp").agg(
        F.min("pos").alias("pos"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "raw"))), lambda p: p.raw), "").alias("raw"),
    ).select("doc_id", "pos", "raw")


def prompt_lines(sentences: DataFrame, max_sentences: int | None = None) -> DataFrame:
    """``doc_id, lines``: ``Sn: "text"`` per sentence with quotes escaped, in order."""
    some = sentences.where(F.col("sent_num") <= max_sentences) if max_sentences else sentences
    line = F.concat(F.lit("S"), F.col("sent_num").cast("string"), F.lit(': "'), F.replace(F.col("text"), F.lit('"'), F.lit('\\"')), F.lit('"'))
    listed = some.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sent_num", line.alias("line")))).alias("l"))
    return listed.select("doc_id", F.array_join(F.transform("l", lambda x: x.line), "\n").alias("lines"))
