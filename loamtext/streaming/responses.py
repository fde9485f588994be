"""Answers of asynchronous batches as a stream: files of JSON lines joined to their requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loamtext.sources.corpora import ANSWER


def answer_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """``request_id, response, error`` of answers as their files arrive."""
    df = spark.readStream.schema(ANSWER).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files_per_trigger).json(path)
    return df.where("custom_id is not null").select(F.col("custom_id").alias("request_id"), "response", "error")


def collect_answers(answers: DataFrame, requests: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append the answers to known requests to ``out`` until the folder is read; returns the query."""
    known = answers.join(requests.select("request_id"), "request_id", "left_semi")
    return known.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
