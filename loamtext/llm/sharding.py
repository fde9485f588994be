"""Two-pass external shuffle into shards, with DataFrame functions only.

Pass 1 scatters records uniformly into memory-sized buckets by a seeded hash of the
row's place in the scan, so equal keys and equal rows spread like any others; Spark's
shuffle files are the buckets on disk.  A bucket's number is its task's number
(``repartitionById``), so each task has one bucket and none is idle.  Pass 2 loads the
task's bucket as an array, puts it in key order, draws a Fisher-Yates permutation of it
(``shuffle``) and writes it to the shared folder.  Buckets follow each other, so each
record has one place in the whole order, and shard s holds the places from ceil(s*N/S).

A bucket holds ``BUCKET_BYTES``, and a task about three times that in memory.  There are
at least ``LEAST_BUCKETS``, so that small tables use several executors, and at most
``MOST_BUCKETS``, beyond which buckets grow (1 GB at 100 TB) and executors must too.

The buckets are written before anything is derived from them: a task that is repeated
after the loss of an executor writes its buckets anew as a whole, and later tasks read
the one order that was committed.

Law: ``rows``; shards differ by at most one row.  Defined results: a null text has
size 1 and checksum 0 and stays null; repeated rows are separate records; an empty
table gives no rows.  Other columns, maps included, are carried along under their own names;
a column called ``shard`` or ``slot`` is carried as ``shard_in`` or ``slot_in``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from loamtext.llm.common import carried, new_path, written

BUCKET_BYTES = 64 << 20
LEAST_BUCKETS, MOST_BUCKETS = 32, 100_000
SEED = 1729
#: Buckets whose offsets are summed together in one step of the two-level prefix sum.
SUPER = 1024
#: Bucket offsets (16 bytes each) are broadcast up to this number, else joined by key.
BROADCAST_BUCKETS = 200_000


def shuffled_buckets(rows: DataFrame, n_buckets: int, seed: int = SEED) -> DataFrame:
    """Both passes, written: the rows with ``_bucket`` and ``_at`` (from 0 in a bucket)."""
    cols = rows.columns
    keyed = rows.withColumn("_key", F.xxhash64(F.lit(seed), F.monotonically_increasing_id()))
    keyed = keyed.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "_key"), F.lit(n_buckets)).cast("int"))

    def by_key(a: Column, b: Column) -> Column:
        return F.when(a["_key"] < b["_key"], -1).when(a["_key"] > b["_key"], 1).otherwise(0)

    loaded = (
        keyed.repartitionById(n_buckets, F.col("_bucket"))
        .groupBy("_bucket")
        .agg(F.array_sort(F.collect_list(F.struct("_key", *cols)), by_key).alias("records"))
    )
    drawn = loaded.select("_bucket", F.posexplode(F.shuffle("records", F.lit(seed))).alias("_at", "r"))
    return written(drawn.select("_bucket", "_at", *(F.col(f"r.{c}").alias(c) for c in cols)), "buckets")


def bucket_offsets(buckets: DataFrame) -> DataFrame:
    """(bucket, first place): a two-level prefix sum, so that no task sees all buckets."""
    counts = written(buckets.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n")), "bucket_counts")
    counts = counts.withColumn("super", F.floor(F.col("_bucket") / SUPER))
    supers = counts.groupBy("super").agg(F.sum("n").alias("super_n"))
    before = supers.select("super", (F.sum("super_n").over(Window.orderBy("super")) - F.col("super_n")).alias("super_at"))
    inside = counts.withColumn("at", F.sum("n").over(Window.partitionBy("super").orderBy("_bucket")) - F.col("n"))
    return inside.join(before, "super").select("_bucket", (F.col("super_at") + F.col("at")).alias("_first"))


def shuffled(docs: DataFrame, n_shards: int, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> DataFrame:
    """The rows with ``shard`` and ``slot`` (gapless from 0 in a shard)."""
    inner = {c: f"_in_{k}" for k, c in enumerate(docs.columns)}
    strings = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) for f in docs.schema.fields if isinstance(f.dataType, StringType)]
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(sum(strings, F.lit(8 * len(inner)))).alias("b")).first()
    n = size.n
    n_buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, math.ceil((size.b or 0) / bucket_bytes)))
    buckets = shuffled_buckets(docs.toDF(*inner.values()), n_buckets, seed)
    offsets = bucket_offsets(buckets)
    if n_buckets <= BROADCAST_BUCKETS:
        offsets = F.broadcast(offsets)
    placed = (
        buckets.join(offsets, "_bucket")
        .withColumn("_place", F.col("_first") + F.col("_at"))
        .withColumn("_shard", F.expr(f"_place * {n_shards} div {max(n, 1)}"))
        .withColumn("_slot", F.expr(f"_place - (_shard * {n} + {n_shards - 1}) div {n_shards}"))
    )
    back = [F.col(v).alias(c) for c, v in zip(carried(docs.columns, "shard", "slot"), inner.values())]
    return placed.select(*back, F.col("_shard").cast("int").alias("shard"), F.col("_slot").alias("slot"))


def write_shards(docs: DataFrame, n_shards: int, path: str | None = None, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> str:
    """Write the shards as folders ``shard=k``, rows in slot order; returns the path."""
    path = path or new_path(docs.sparkSession, "shards")
    out = shuffled(docs, n_shards, bucket_bytes, seed)
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return path
