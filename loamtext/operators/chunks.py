"""Sliding windows over a document's sentences, and relative numbers inside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamtext.functions import sentence_id
from loamtext.operators.sentences import texts as split_texts

MAX_SENTENCES = 150
OVERLAP = 30


def check_window(size: int, overlap: int) -> None:
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the window")


def counts(sentences: DataFrame) -> DataFrame:
    return sentences.groupBy("doc_id").agg(F.max("sent_num").alias("n"))


def plain_chunks(totals: DataFrame, size: int = MAX_SENTENCES, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, chunk_no, first_num, last_num`` at a fixed stride (``totals``: doc_id, n)."""
    check_window(size, overlap)
    stride = size - overlap
    steps = F.when(F.col("n") > size, F.ceil((F.col("n") - size) / stride)).otherwise(0).cast("int")
    starts = F.transform(F.sequence(F.lit(0), steps), lambda k: k * stride)
    return (
        totals.where("n > 0")
        .select("doc_id", "n", F.posexplode(starts).alias("chunk_no", "s"))
        .select("doc_id", "chunk_no", (F.col("s") + 1).cast("int").alias("first_num"), F.least(F.col("s") + size, F.col("n")).cast("int").alias("last_num"))
    )


def hinted_chunks(totals: DataFrame, hints: DataFrame, size: int = MAX_SENTENCES, overlap: int = OVERLAP) -> DataFrame:
    """As :func:`plain_chunks`, but a window is cut before the last hinted sentence of its
    tail, and the next one then starts there without overlap (``hints``: doc_id, sent_num).

    Where a window ends depends on where the one before it was cut: a fold.
    """
    check_window(size, overlap)
    listed = hints.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.col("sent_num") - 1)).alias("b"))
    rows = totals.where("n > 0").join(listed, "doc_id", "left").withColumn("b", F.coalesce("b", F.array().cast("array<int>")))
    least = max(1, min(size // 2, size - overlap))
    kind = "struct<s:int,chunks:array<struct<first:int,last:int>>>"
    n, b = F.col("n"), F.col("b")

    def step(acc: Column, _: Column) -> Column:
        end = F.least(acc.s + size, n)
        limit = F.greatest(acc.s + size // 2, end - 3 * overlap)
        cut = F.array_max(F.filter(b, lambda x: (x >= limit) & (x < end)))
        stop = F.when((end < n) & cut.isNotNull(), cut).otherwise(end)
        nxt = F.when(end >= n, n).when(cut.isNotNull(), cut).otherwise(end - overlap)
        chunk = F.struct((acc.s + 1).cast("int").alias("first"), stop.cast("int").alias("last"))
        moved = F.struct(nxt.cast("int").alias("s"), F.concat(acc.chunks, F.array(chunk)).alias("chunks"))
        return F.when(acc.s < n, moved).otherwise(acc).cast(kind)

    start = F.struct(F.lit(0).alias("s"), F.array().cast("array<struct<first:int,last:int>>").alias("chunks")).cast(kind)
    folded = F.aggregate(F.sequence(F.lit(1), F.ceil(n / least).cast("int") + 1), start, step, lambda acc: acc.chunks)
    return rows.select("doc_id", F.posexplode(folded).alias("chunk_no", "c")).select("doc_id", "chunk_no", F.col("c.first").alias("first_num"), F.col("c.last").alias("last_num"))


def chunk_sentences(sentences: DataFrame, chunks: DataFrame, *more: str) -> DataFrame:
    """The sentences of each chunk with ``rel_num`` from 1; ``more`` names carried columns.

    An interval join within a document, keyed by blocks of sentence numbers.
    """
    block = 64
    wide = chunks.withColumn("blk", F.explode(F.sequence(F.expr(f"first_num div {block}"), F.expr(f"last_num div {block}"))))
    keyed = sentences.withColumn("blk", F.expr(f"sent_num div {block}"))
    inside = keyed.join(wide, ["doc_id", "blk"]).where("sent_num between first_num and last_num")
    return inside.select("doc_id", *more, "chunk_no", "sent_num", (F.col("sent_num") - F.col("first_num") + 1).alias("rel_num"), "text")


def chunk_lines(docs: DataFrame, chunks: DataFrame | None, *more: str) -> DataFrame:
    """``doc_id, more, chunk_no, first_num, n, lines``: the prompt lines of each chunk that has
    sentences; without ``chunks`` a document is one.

    ``docs``: ``doc_id`` and ``text``, or ``texts`` of its sentences.  A text is dealt once, by
    document and unsorted, whatever the number of its chunks, and not at all without ``chunks``.
    """
    texts = F.col("texts") if "texts" in docs.columns else split_texts(F.col("text"))
    if chunks is None:
        of = docs.select("doc_id", texts.alias("texts"), F.array(F.struct(F.lit(0).alias("chunk_no"), F.lit(1).alias("first_num"), F.lit(None).cast("int").alias("last_num"))).alias("cs"))
    else:
        listed = chunks.groupBy("doc_id").agg(F.collect_list(F.struct(*more, "chunk_no", "first_num", "last_num")).alias("cs"))
        of = docs.join(listed.hint("shuffle_hash"), "doc_id").select("doc_id", texts.alias("texts"), "cs")
    each = of.select("doc_id", "texts", F.explode("cs").alias("c"))  # texts are cut below this
    first = F.col("c.first_num")
    low = F.greatest(first, F.lit(1))
    n = F.least(F.coalesce("c.last_num", F.size("texts")), F.size("texts")) - low + 1
    some = each.where(n > 0)  # by the size, not by the lines: those are made once
    line = lambda x, i: F.concat(sentence_id(i + low - first + 1), F.lit(': "'), F.replace(x, F.lit('"'), F.lit('\\"')), F.lit('"'))
    shown = F.array_join(F.transform(F.slice("texts", low, n), line), "\n")
    return some.select("doc_id", *(f"c.{m}" for m in more), "c.chunk_no", "c.first_num", n.cast("long").alias("n"), shown.alias("lines"))


def dense_numbers(sentences: DataFrame, *group: str) -> DataFrame:
    """``rel_num``: the rank of a sentence inside its group."""
    return sentences.withColumn("rel_num", F.row_number().over(Window.partitionBy("doc_id", *group).orderBy("sent_num")))


def title_hints(titles: DataFrame, docs: DataFrame, sentences: DataFrame) -> DataFrame:
    """``doc_id, idx, sent_num``: the sentence in which each title first occurs (``titles``: doc_id, idx, title)."""
    from loamtext.functions import first_position
    from loamtext.operators.evaluate import as_of

    placed = titles.join(docs.select("doc_id", F.col("text").alias("_full")), "doc_id")
    placed = placed.select("doc_id", "idx", first_position(F.col("_full"), F.col("title")).alias("pos")).where("pos is not null")
    starts = sentences.select("doc_id", F.col("start").alias("pos"), F.col("sent_num").alias("value"), F.col("end"))
    found = as_of(placed, starts.select("doc_id", "pos", "value"), "idx")
    ends = sentences.select("doc_id", F.col("sent_num").alias("value"), F.col("end").alias("stop"))
    return found.join(ends, ["doc_id", "value"]).where("pos < stop").select("doc_id", "idx", F.col("value").alias("sent_num"))
