"""Scans of corpora and results, and sinks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

MINUTES = (
    "municipalities array<struct<municipality:string,minutes:array<struct<minute_id:string,full_text:string,"
    "agenda_items:array<struct<item_title:string,subjects:array<struct<subject_id:string,theme:string,topics:array<string>,"
    "text:string,start:int,end:int>>>>>>>>"
)
SPLITS = "train_files array<string>, val_files array<string>, test_files array<string>"
RESULT = (
    "agenda_items array<struct<item_id:int,item_title:string,start:int,end:int,text:string,"
    "subjects:array<struct<theme:string,topics:array<string>,start:int,end:int,start_id:string,end_id:string,text:string>>>>, error string"
)
ANSWER = "custom_id string, response string, error string"
#: Files of a folder of articles that are no articles, by ending.
NO_ARTICLES = ("json", "py", "txt", "md", "cfg", "ini")


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def _decoded(path: str) -> Column:
    """A path or name as it was given: Spark's metadata has it percent-encoded."""
    return F.url_decode(F.replace(F.col(path), F.lit("+"), F.lit("%2B")))


def _name() -> Column:
    return _decoded("_metadata.file_name")


def _underscored(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, path, text, size`` of the files with a leading ``_``, which Spark's readers pass over.

    The driver lists the folder, as Spark's readers do; executors read the files.
    """
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, files = [], fs.listFiles(root, True)
    while files.hasNext():
        at = files.next().getPath()
        if at.getName().startswith("_"):
            found.append((at.getName(), at.toString(), at.toUri().toString().replace("file:/", "file:///", 1)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        for b in batches:
            texts, sizes = [], []
            for uri in b.column(2).to_pylist():
                store, inner = FileSystem.from_uri(uri)
                with store.open_input_stream(inner) as f:
                    data = f.readall()
                texts.append(data.decode("utf-8", "replace"))
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(sizes, pa.int64())], ["doc_id", "path", "text", "size"])

    paths = spark.createDataFrame(found, "doc_id string, path string, uri string")
    return paths.mapInArrow(read, "doc_id string, path string, text string, size long")


def read_minutes(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, municipality, full_text, agenda_items``: one row per minute.

    Rows without an id go; of one id the last in file and place order stays; a missing
    municipality is the file's stem.
    """
    files = spark.read.schema(MINUTES).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
    towns = files.select(_name().alias("file"), F.posexplode("municipalities").alias("at", "m"))
    rows = towns.select("file", "at", F.coalesce("m.municipality", _stem(F.col("file"))).alias("municipality"), F.posexplode("m.minutes").alias("no", "x"))
    named = rows.select("file", "at", "no", "municipality", "x.*").where("minute_id <> ''")
    last = Window.partitionBy("minute_id").orderBy(F.desc("file"), F.desc("at"), F.desc("no"))
    kept = named.withColumn("rank", F.row_number().over(last)).where("rank = 1")
    return kept.select(F.col("minute_id").alias("doc_id"), "municipality", F.coalesce("full_text", F.lit("")).alias("full_text"), "agenda_items")


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """``split, ord, doc_id`` of a manifest; ``.json`` is taken out of the names."""
    one = spark.read.schema(SPLITS).option("multiLine", True).json(path)
    parts = [one.select(F.lit(s).alias("split"), F.posexplode(f"{s}_files").alias("ord", "name")) for s in ("train", "val", "test")]
    every = parts[0].union(parts[1]).union(parts[2])
    return every.select("split", "ord", F.replace("name", F.lit(".json"), F.lit("")).alias("doc_id"))


def split_documents(docs: DataFrame, splits: DataFrame, split: str, municipality: str | None = None) -> DataFrame:
    """The documents of a split in manifest order; ValueError if there are none."""
    listed = splits.where(F.col("split") == split).groupBy("doc_id").agg(F.min("ord").alias("ord"))
    out = docs.join(listed, "doc_id")
    if municipality is not None:
        out = out.where(F.lower("municipality") == municipality.lower())
    if out.isEmpty():
        raise ValueError(f"no documents in split {split!r}" + (f" of {municipality!r}" if municipality else ""))
    return out.orderBy("ord").drop("ord")


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, path, text``: one row per article file below a folder.

    The id is the file's name; hidden and empty files and those of NO_ARTICLES are left
    out; of one name the last path stays.
    """
    try:
        files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
        seen = files.select(_name().alias("doc_id"), _decoded("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.col("_metadata.file_size").alias("size"))
        rows = seen.union(_underscored(spark, path))
    except AnalysisException:  # the path is a file that Spark passes over
        rows = _underscored(spark, path)
    ending = F.lower(F.regexp_extract("doc_id", r"[^.]\.([^.]+)$", 1))
    some = rows.where((F.col("size") > 0) & ~F.col("doc_id").startswith(".") & ~ending.isin(*NO_ARTICLES))
    last = Window.partitionBy("doc_id").orderBy(F.desc("path"))
    return some.withColumn("rank", F.row_number().over(last)).where("rank = 1").select("doc_id", "path", "text")


@dataclass(frozen=True)
class Corpus:
    """Documents by id, read when they are asked for.

    ``keys`` limits what is listed (:meth:`ids`, :meth:`rows`, ``len``), not what can be
    looked up (:meth:`get`, ``in``).
    """

    docs: DataFrame
    keys: tuple[str, ...] | None = None

    def get(self, doc_id) -> DataFrame:
        """The document's row; no row for an unknown id."""
        return self.docs.where(F.col("doc_id") == F.lit(doc_id))

    def __contains__(self, doc_id) -> bool:
        return not self.get(doc_id).isEmpty()

    def rows(self) -> DataFrame:
        if self.keys is None:
            return self.docs
        kind = self.docs.schema["doc_id"].dataType
        listed = self.docs.sparkSession.createDataFrame([(k,) for k in self.keys], StructType([StructField("doc_id", kind)]))
        return self.docs.join(listed.distinct(), "doc_id", "left_semi")

    def ids(self) -> DataFrame:
        return self.rows().select("doc_id").orderBy("doc_id")

    def __len__(self) -> int:
        return self.rows().count()


def first_documents(docs: DataFrame, limit: int | None = None) -> DataFrame:
    """Documents by id, the first ``limit`` of them."""
    ordered = docs.orderBy("doc_id")
    return ordered if limit is None else ordered.limit(limit)


def read_result(spark: SparkSession, path: str) -> DataFrame:
    """A result or ground-truth file, nested; ``doc_id`` is the file's stem."""
    df = spark.read.schema(RESULT).option("multiLine", True).json(path)
    return df.select(_stem(_name()).alias("doc_id"), "agenda_items", "error")


def write_requests(requests: DataFrame, path: str, model: str, temperature: float = 0.1, max_tokens: int = 4096) -> None:
    """Batch requests (``request_id, prompt, schema``) as JSON lines; ValueError if there are none."""
    if requests.isEmpty():
        raise ValueError("no requests")
    named = model if model.startswith(("models/", "tunedModels/")) else f"models/{model}"
    config = F.struct(
        F.lit(temperature).alias("temperature"),
        F.lit(max_tokens).alias("max_output_tokens"),
        F.when(F.col("schema").isNotNull(), "application/json").alias("response_mime_type"),
        F.col("schema").alias("response_json_schema"),
    )
    content = F.struct(F.lit("user").alias("role"), F.array(F.struct(F.col("prompt").alias("text"))).alias("parts"))
    body = F.struct(F.lit(named).alias("model"), F.array(content).alias("contents"), config.alias("generation_config"))
    requests.select(F.col("request_id").alias("custom_id"), body.alias("request")).write.json(path)


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """``request_id, response, error`` of JSON lines; blank and unreadable lines are skipped."""
    df = spark.read.schema(ANSWER).option("mode", "DROPMALFORMED").json(path)
    return df.where("custom_id is not null").withColumnRenamed("custom_id", "request_id")
