"""True segments from articles with marked headings.

A heading line is six or more ``=``, then ``,depth,title`` with an optional full stop.
Lines are cut at ``\\n``.  Depth-1 headings leave the text, deeper ones stay as a bare
title line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed value: the file format's heading line.
HEADING = r"^={6,},([0-9]+),(.+?)\.?\s*$"


def parse_lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``doc_id, line_no, depth, title, line, start``: transformed lines with offsets.

    ``line`` keeps its line break and is empty for a removed heading; depth and title are
    null on lines that are no heading.
    """
    cut = docs.where(F.col(text_col).isNotNull()).select("doc_id", F.posexplode(F.split(text_col, "\n", -1)).alias("line_no", "raw"), F.size(F.split(text_col, "\n", -1)).alias("n"))
    bare = F.regexp_replace("raw", r"\r$", "")
    is_heading = bare.rlike(HEADING)
    marked = cut.select(
        "doc_id",
        "line_no",
        F.when(is_heading, F.regexp_extract(bare, HEADING, 1).cast("int")).alias("depth"),
        F.when(is_heading, F.trim(F.regexp_extract(bare, HEADING, 2))).alias("title"),
        F.when(F.col("line_no") < F.col("n") - 1, F.concat("raw", F.lit("\n"))).otherwise(F.col("raw")).alias("kept"),
    )
    line = F.when(F.col("depth") == 1, "").when(F.col("depth") > 1, F.concat("title", F.lit("\n"))).when(F.col("depth") == 0, F.concat("title", F.lit("\n"))).otherwise(F.col("kept"))
    w = Window.partitionBy("doc_id").orderBy("line_no")
    with_line = marked.withColumn("line", line)
    return with_line.select("doc_id", "line_no", "depth", "title", "line", (F.sum(F.char_length("line")).over(w) - F.char_length("line")).cast("int").alias("start"))


def full_text(lines: DataFrame) -> DataFrame:
    """``doc_id, text``: the transformed text."""
    listed = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    return listed.select("doc_id", F.array_join(F.transform("l", lambda x: x.line), "").alias("text"))


def sections(lines: DataFrame) -> DataFrame:
    """``doc_id, sec_no, depth, title, start, end``: each heading up to the next one."""
    totals = lines.groupBy("doc_id").agg(F.sum(F.char_length("line")).cast("int").alias("total"))
    w = Window.partitionBy("doc_id").orderBy("line_no")
    heads = lines.where("depth is not null").join(totals, "doc_id")
    return heads.select(
        "doc_id", F.row_number().over(w).alias("sec_no"), "depth", "title", "start", F.coalesce(F.lead("start").over(w), F.col("total")).alias("end")
    )


def _items(secs: DataFrame) -> DataFrame:
    """Sections of depth 2 and more with their item's number; those before the first item go."""
    w = Window.partitionBy("doc_id").orderBy("sec_no")
    return secs.where("depth >= 2").withColumn("item_no", F.sum(F.when(F.col("depth") == 2, 1).otherwise(0)).over(w).cast("int")).where("item_no > 0")


def items(secs: DataFrame, extend_first: bool = True) -> DataFrame:
    """``doc_id, item_no, title, start, end``: a depth-2 heading with all that hangs below it."""
    out = _items(secs).groupBy("doc_id", "item_no").agg(
        F.max(F.when(F.col("depth") == 2, F.col("title"))).alias("title"),
        F.max(F.when(F.col("depth") == 2, F.col("start"))).alias("start"),
        F.max("end").alias("end"),
    )
    return out.withColumn("start", F.when(F.col("item_no") == 1, 0).otherwise(F.col("start"))) if extend_first else out


def _extended(subjects: DataFrame) -> DataFrame:
    """The only subject of a document's first item starts at 0."""
    w = Window.partitionBy("doc_id", "item_no")
    alone = (F.col("item_no") == 1) & (F.count(F.lit(1)).over(w) == 1)
    return subjects.withColumn("start", F.when(alone, 0).otherwise(F.col("start")))


def flat_subjects(secs: DataFrame) -> DataFrame:
    """``doc_id, item_no, idx, start, end``: deeper sections as they are; a childless item is its own subject."""
    below = _items(secs)
    deeper = below.where("depth > 2").select("doc_id", "item_no", "sec_no", "start", "end")
    childless = items(secs, extend_first=False).join(deeper.select("doc_id", "item_no").distinct(), ["doc_id", "item_no"], "left_anti")
    every = deeper.union(childless.select("doc_id", "item_no", F.lit(0).alias("sec_no"), "start", "end"))
    w = Window.partitionBy("doc_id", "item_no").orderBy("sec_no")
    return _extended(every.select("doc_id", "item_no", (F.row_number().over(w) - 1).alias("idx"), "start", "end"))


def leaf_subjects(secs: DataFrame) -> DataFrame:
    """As :func:`flat_subjects` with leaves only: no section that a deeper one follows, the
    item's text before the first leaf as a leaf, gaps given to the leaf before."""
    w = Window.partitionBy("doc_id", "item_no").orderBy("sec_no")
    deeper = _items(secs).where("depth > 2")
    leaf = deeper.withColumn("leaf", F.coalesce(F.lead("depth").over(w) <= F.col("depth"), F.lit(True))).where("leaf")
    leaf = leaf.select("doc_id", "item_no", "sec_no", "start", "end")
    whole = items(secs, extend_first=False)
    first = leaf.groupBy("doc_id", "item_no").agg(F.min("start").alias("leaf_start"))
    own = whole.join(first, ["doc_id", "item_no"], "left").where("leaf_start is null or leaf_start > start")
    intro = own.select("doc_id", "item_no", F.lit(0).alias("sec_no"), "start", F.coalesce("leaf_start", "end").alias("end"))
    nxt = F.lead("start").over(w)
    every = leaf.union(intro).withColumn("nxt", nxt).withColumn("n", F.row_number().over(w))
    return _extended(every.select("doc_id", "item_no", (F.col("n") - 1).alias("idx"), "start", F.greatest("end", "nxt").alias("end")))


def section_tree(secs: DataFrame) -> DataFrame:
    """``doc_id, item_no, title, start, end, subsections``: the flat list below each item."""
    sub = F.struct("sec_no", "title", "depth", "start", "end")
    below = _items(secs).where("depth > 2").groupBy("doc_id", "item_no").agg(F.array_sort(F.collect_list(sub)).alias("l"))
    joined = items(secs).join(below, ["doc_id", "item_no"], "left")
    kind = "array<struct<title:string,depth:int,start:int,end:int>>"
    listed = F.transform("l", lambda x: F.struct(x.title.alias("title"), x.depth.alias("depth"), x.start.alias("start"), x.end.alias("end")))
    return joined.withColumn("subsections", F.coalesce(listed.cast(kind), F.array().cast(kind))).drop("l")
