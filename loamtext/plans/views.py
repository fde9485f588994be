"""Inputs derived from the driver's tables: the engine's side, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamtext.functions import WHITE
from loamtext.operators import sentences as sentence_ops


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")


def sentences(spark: SparkSession, sf: str) -> DataFrame:
    return sentence_ops.split_sentences(documents(spark, sf))


def lines(docs: DataFrame, chars: int | None = None) -> DataFrame:
    """Lines of a text that are not blank, as segments (``idx`` from 0); ``line`` cut to ``chars``."""
    w = Window.partitionBy("doc_id").orderBy("no")
    cut = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("no", "line"))
    shown = F.col("line") if chars is None else F.substring("line", 1, chars)
    # measured before the exchange, so the lines are dealt only to readers of them
    measured = cut.select("doc_id", "no", shown.alias("line"), F.char_length("line").alias("n"), (F.trim("line", F.lit(WHITE)) != "").alias("some"))
    placed = measured.withColumn("start", (F.sum(F.col("n") + 1).over(w) - F.col("n") - 1).cast("int")).where("some")
    return placed.select("doc_id", (F.row_number().over(w) - 1).alias("idx"), "start", (F.col("start") + F.col("n")).alias("end"), "line")


def truth(spark: SparkSession, sf: str, chars: int | None = None) -> DataFrame:
    return lines(documents(spark, sf), chars)


def blocks(sents: DataFrame, size: int = 5) -> DataFrame:
    """Blocks of consecutive sentences as segments."""
    return sents.groupBy("doc_id", F.expr(f"cast((sent_num - 1) div {size} as int)").alias("idx")).agg(
        F.min("sent_num").alias("start_num"), F.max("sent_num").alias("end_num"), F.min("start").alias("start"), F.max("end").alias("end")
    )


def pred(spark: SparkSession, sf: str) -> DataFrame:
    return blocks(sentences(spark, sf))


def gappy(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks that end 0 to 4 sentences early, all but a document's last."""
    rows = pred(spark, sf).drop("start", "end")
    last = F.max("idx").over(Window.partitionBy("doc_id")) == F.col("idx")
    cut = F.expr("cast((doc_id + idx) % 5 as int)")
    return rows.withColumn("end_num", F.when(last, F.col("end_num")).otherwise(F.col("end_num") - cut))


def overlapping(spark: SparkSession, sf: str) -> DataFrame:
    rows = pred(spark, sf).drop("start", "end")
    return rows.withColumn("end_num", F.col("end_num") + F.col("idx") % 3).withColumn("theme", F.concat(F.lit("t"), F.col("idx").cast("string")))


def themed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """``pred, gt`` with themes (first 10 characters) and topics."""
    full = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("text").alias("_full"), "lang", "source")
    theme = F.substring(F.substring(F.col("_full"), F.col("start") + 1, F.col("end") - F.col("start")), F.lit(1), F.lit(10)).alias("theme")
    p = pred(spark, sf).join(full, "doc_id").select("doc_id", "idx", "start", "end", theme, F.array("lang").alias("topics"))
    g = truth(spark, sf).join(full, "doc_id").select("doc_id", "idx", "start", "end", theme, F.array("lang", "source").alias("topics"))
    return p, g


def conversation_documents(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``docs, items, subjects``: turns as subjects, pairs of turns as items."""
    said = spark.read.parquet(f"{sf}/conversations.parquet").select(F.col("conv_id").alias("doc_id"), "turn", "text")
    w = Window.partitionBy("doc_id").orderBy("turn")
    n = F.char_length("text")
    subjects = said.select(
        "doc_id", F.expr("cast(turn div 2 as int)").alias("item_no"), F.expr("cast(turn % 2 as int)").alias("idx"), (F.sum(n + 1).over(w) - n - 1).cast("int").alias("start"), (F.sum(n + 1).over(w) - 1).cast("int").alias("end"), "text"
    )
    items = subjects.where("idx = 0").select("doc_id", "item_no", F.substring("text", 1, 20).alias("title"))
    listed = said.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("l"))
    docs = listed.select("doc_id", F.array_join(F.transform("l", lambda x: x.text), "\n").alias("text"))
    return docs, items, subjects


def marked_up(spark: SparkSession, sf: str) -> DataFrame:
    """Every fourth line of a document as a heading."""
    text = F.array_join(
        F.transform(
            F.split("text", "\n", -1),
            lambda x, i: F.when(
                i % 4 == 0,
                F.concat(F.lit("========,"), F.when(i == 0, F.lit("1")).otherwise((2 + (F.expr("0") + F.floor(i / 4) + F.col("doc_id")) % 3).cast("string")), F.lit(","), F.substring(x, 1, 12), F.lit(".")),
            ).otherwise(x),
        ),
        "\n",
    )
    return documents(spark, sf).select("doc_id", text.alias("text"))


def numbered_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a ``k.`` line before every third line."""
    text = F.array_join(
        F.transform(F.split("text", "\n", -1), lambda x, i: F.when(i % 3 == 0, F.concat((F.floor(i / 3) + 1).cast("string"), F.lit(".\n"), x)).otherwise(x)), "\n"
    )
    return documents(spark, sf).select("doc_id", text.alias("text"))


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """One recorded answer per document that lists its blocks, in six styles by doc_id."""
    item = F.concat(F.lit('{"item_title": "T'), F.col("idx").cast("string"), F.lit('", "start_id": "S'), F.col("start_num").cast("string"), F.lit('", "end_id": "S'), F.col("end_num").cast("string"), F.lit('"}'))
    listed = pred(spark, sf).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", item.alias("j")))).alias("l"))
    objects = F.transform("l", lambda x: x.j)
    array = F.concat(F.lit("["), F.array_join(objects, ", "), F.lit("]"))
    style = F.col("doc_id") % 6
    text = (
        F.when(style == 0, array)
        .when(style == 1, F.concat(F.lit("```json\n"), array, F.lit("\n```")))
        .when(style == 2, F.concat(F.lit("Here it is: "), array, F.lit(" as asked.")))
        .when(style == 3, F.array_join(objects, "\n"))
        .when(style == 4, F.concat(F.lit('{"items": '), array, F.lit("}")))
        .otherwise(F.substring(array, F.lit(1), F.char_length(array) - 3))
    )
    return listed.select("doc_id", F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("request_id"), text.alias("response"))


# The same views in SQL, in the order in which they build on each other.

SENT = r"""
pc AS (
  SELECT doc_id, unnest(range(len(p))) AS pos, unnest(p) AS raw FROM (
    SELECT doc_id, string_split(regexp_replace(text, '([.!?]+\s+|\n+)', '\1' || chr(30), 'g'), chr(30)) AS p
    FROM documents WHERE regexp_matches(text, '\S'))),
pn AS (
  SELECT *, sum(length(raw)) OVER w - length(raw) AS start, regexp_matches(raw, '^\s*$') AS blank,
    sum(CASE WHEN regexp_matches(raw, '^\s*$') THEN 0 ELSE 1 END) OVER w AS num
  FROM pc WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
sent AS (
  SELECT doc_id, num::INT AS sent_num, regexp_replace(regexp_replace(raw, '\s+$', ''), '^\s+', '') AS text,
    start::INT AS start, (start + length(regexp_replace(raw, '\s+$', '')))::INT AS "end"
  FROM pn WHERE NOT blank)"""

TRUTH = r"""
ln AS (
  SELECT doc_id, unnest(range(len(l))) AS no, unnest(l) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
lp AS (
  SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY no) - length(line) - 1 AS start FROM ln),
truth AS (
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY no) - 1)::INT AS idx, start::INT AS start,
    (start + length(line))::INT AS "end", line
  FROM lp WHERE regexp_matches(line, '\S'))"""

PRED = """
pred AS (
  SELECT doc_id, ((sent_num - 1) // 5)::INT AS idx, min(sent_num) AS start_num, max(sent_num) AS end_num,
    min(start) AS start, max("end") AS "end"
  FROM sent GROUP BY ALL)"""

GAPPY = """
gappy AS (
  SELECT doc_id, idx, start_num,
    CASE WHEN idx = max(idx) OVER (PARTITION BY doc_id) THEN end_num ELSE end_num - ((doc_id + idx) % 5)::INT END AS end_num
  FROM pred)"""

OVERLAPPING = """
overlapping AS (SELECT doc_id, idx, start_num, end_num + idx % 3 AS end_num, 't' || idx AS theme FROM pred)"""

CONV = """
cs AS (
  SELECT conv_id AS doc_id, (turn // 2)::INT AS item_no, (turn % 2)::INT AS idx,
    (sum(length(text) + 1) OVER w - length(text) - 1)::INT AS start, (sum(length(text) + 1) OVER w - 1)::INT AS "end", text
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
ci AS (SELECT doc_id, item_no, left(text, 20) AS title FROM cs WHERE idx = 0),
cd AS (SELECT conv_id AS doc_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id)"""

MARKUP = """
mt AS (
  SELECT doc_id, array_to_string(list_transform(range(len(l)), lambda i: CASE WHEN i % 4 = 0
    THEN '========,' || CASE WHEN i = 0 THEN '1' ELSE (2 + (i // 4 + doc_id) % 3)::VARCHAR END || ',' || left(l[i + 1], 12) || '.'
    ELSE l[i + 1] END), chr(10)) AS text
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
ml AS (
  SELECT doc_id, unnest(range(len(l))) AS no, unnest(l) AS raw, len(l) AS n
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM mt)),
mh AS (
  SELECT *, CASE WHEN regexp_matches(raw, '^={6,},([0-9]+),(.+?)\\.?\\s*$') THEN regexp_extract(raw, '^={6,},([0-9]+),(.+?)\\.?\\s*$', 1)::INT END AS depth,
    CASE WHEN regexp_matches(raw, '^={6,},([0-9]+),(.+?)\\.?\\s*$') THEN trim(regexp_extract(raw, '^={6,},([0-9]+),(.+?)\\.?\\s*$', 2)) END AS title
  FROM ml),
mk AS (
  SELECT *, CASE WHEN depth = 1 THEN '' WHEN depth IS NOT NULL THEN title || chr(10) WHEN no < n - 1 THEN raw || chr(10) ELSE raw END AS line FROM mh),
mo AS (SELECT *, (sum(length(line)) OVER (PARTITION BY doc_id ORDER BY no) - length(line))::INT AS start FROM mk),
secs AS (
  SELECT h.doc_id, (row_number() OVER w)::INT AS sec_no, depth, title, start, coalesce(lead(start) OVER w, t.total)::INT AS "end"
  FROM mo h JOIN (SELECT doc_id, sum(length(line)) AS total FROM mo GROUP BY 1) t USING (doc_id)
  WHERE depth IS NOT NULL WINDOW w AS (PARTITION BY h.doc_id ORDER BY no)),
below AS (
  SELECT * FROM (SELECT *, (sum((depth = 2)::INT) OVER (PARTITION BY doc_id ORDER BY sec_no))::INT AS item_no FROM secs WHERE depth >= 2) WHERE item_no > 0),
raw_items AS (
  SELECT doc_id, item_no, max(title) FILTER (depth = 2) AS title, max(start) FILTER (depth = 2) AS start, max("end") AS "end"
  FROM below GROUP BY ALL)"""

UNITS = """
su AS (SELECT doc_id, sent_num - 1 AS i, start FROM sent),
truth_u AS (
  SELECT t.doc_id, t.idx, coalesce(a.i, 0) AS start, greatest(coalesce(a.i, 0), coalesce(b.i, 0)) AS "end"
  FROM truth t ASOF LEFT JOIN su a ON t.doc_id = a.doc_id AND t.start >= a.start
    ASOF LEFT JOIN su b ON t.doc_id = b.doc_id AND t."end" >= b.start),
pred_u AS (
  SELECT t.doc_id, t.idx, coalesce(a.i, 0) AS start, greatest(coalesce(a.i, 0), coalesce(b.i, 0)) AS "end"
  FROM pred t ASOF LEFT JOIN su a ON t.doc_id = a.doc_id AND t.start >= a.start
    ASOF LEFT JOIN su b ON t.doc_id = b.doc_id AND t."end" >= b.start)"""

IOU = """
ov AS (
  SELECT doc_id, p, g, x / ((pe - ps) + (ge - gs) - x) AS iou FROM (
    SELECT p.doc_id, p.idx AS p, g.idx AS g, p.start AS ps, p."end" AS pe, g.start AS gs, g."end" AS ge,
      least(p."end", g."end") - greatest(p.start, g.start) AS x
    FROM pred p JOIN truth g ON p.doc_id = g.doc_id AND p.start < g."end" AND g.start < p."end"))"""


def greedy_sql(pairs: str, out: str) -> str:
    """Greedy assignment over ``pairs(doc_id, p, g, cost)`` as a recursive query: one p a step."""
    return f"""
{out}_c AS (
  SELECT doc_id, p, list(g ORDER BY cost, g) AS gs, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS k
  FROM ({pairs}) GROUP BY doc_id, p),
{out}_r AS (
  SELECT doc_id, k, p, list_filter(gs, lambda x: true)[1] AS g, [gs[1]] AS used FROM {out}_c WHERE k = 1
  UNION ALL
  SELECT c.doc_id, c.k, c.p, list_filter(c.gs, lambda x: NOT list_contains(r.used, x))[1] AS g,
    list_append(r.used, list_filter(c.gs, lambda x: NOT list_contains(r.used, x))[1]) AS used
  FROM {out}_r r JOIN {out}_c c ON c.doc_id = r.doc_id AND c.k = r.k + 1),
{out} AS (SELECT doc_id, p, g FROM {out}_r WHERE g IS NOT NULL)"""


MATCHED = greedy_sql(
    """SELECT p.doc_id, p.idx AS p, g.idx AS g, abs(p.start - g.start) + abs(p."end" - g."end") AS cost
    FROM pred_u p JOIN truth_u g ON p.doc_id = g.doc_id AND abs(p.start - g.start) <= 2 AND abs(p."end" - g."end") <= 2""",
    "matched",
)
IOU_MATCHED = greedy_sql("SELECT doc_id, p, g, -iou AS cost FROM ov WHERE iou >= 0.5", "iou_matched")


def sql(select: str, *views: str) -> str:
    return "WITH RECURSIVE " + ",".join(views) + "\n" + select
