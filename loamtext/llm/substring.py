"""Substring dedup by content-defined chunking.

A gear rolling hash (h = 2h + G[byte], 32 bits) marks a byte where h is zero under a mask
of four bits, the highest of which depends on the last 20 bytes.  A mark is a border if
no other mark lies in the ``GAP`` bytes before it.  Both rules look at a few bytes only and
not at earlier borders, so an insertion shifts the chunks around it and no others.
Stretches without a border are cut every ``MAX_BYTES``.  Chunks are told apart by a
96-bit digest: of 10^13 chunks any two are taken for one with a chance under 0.001.

A chunk repeats when two or more different texts hold it, or one text holds it twice;
neighbouring repeated chunks form a span, and spans of at least ``MIN_SPAN`` bytes are
reported.  The occurrence with the least (id, text hash, offset) is the first one; later
ones are marked for removal.

Digests are joined by key with counts made beforehand, so a chunk that a third of all
rows hold costs each row one join row.

Defined results: a null or empty text has no chunks; a text without a border
is one chunk (if short); repeated rows hold each other's chunks twice, and the later are marked;
rows with a null id are compared like others; an empty table gives an empty table.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamtext.llm.common import in_arrow, written

GAP = 16
MAX_BYTES = 96
#: Bits that are zero at a mark: one mark in 16 bytes.
MASK = 0b1111 << 16
MIN_SPAN = 96
#: The gear table is drawn from this seed.
GEAR_SEED = 20_081
_GEAR = np.random.default_rng(GEAR_SEED).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear_hashes(data: bytes) -> np.ndarray:
    """h after each byte: the sum of G[byte i] << age over the last 32 bytes, by doubling."""
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for k in range(5):
        age = 1 << k
        if age >= len(h):
            break
        older = h[:-age] << np.uint32(age)
        h[age:] += older
    return h


def chunk_ends(data: bytes) -> list[int]:
    if not data:
        return []
    marks = np.nonzero(gear_hashes(data) & np.uint32(MASK) == 0)[0] + 1
    borders = marks[np.diff(marks, prepend=-GAP) >= GAP]
    ends, at = [], 0
    for p in [*borders.tolist(), len(data)]:
        while p - at > MAX_BYTES:
            at += MAX_BYTES
            ends.append(at)
        if p > at:
            ends.append(p)
            at = p
    return ends


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, k, at, n, digest)`` for each chunk, written.

    k tells rows with one id apart: a hash of the text in its upper half, which orders them,
    and a number for the place in the scan in its lower half, for rows that are equal.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, starts, sizes, digests = [], [], [], []
            for k, text in enumerate(b.column(2).to_pylist()):
                data = (text or "").encode("utf-8", "surrogatepass")
                edges = [0, *chunk_ends(data)]
                for a, e in pairwise(edges):
                    digests.append(blake2b(data[a:e], digest_size=12).digest())
                    starts.append(a)
                    sizes.append(e - a)
                row.extend([k] * (len(edges) - 1))
            at = pa.array(row, pa.int64())
            parts = np.frombuffer(b"".join(digests), np.dtype([("d1", "<i8"), ("d2", "<i4")]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), pa.array(starts, pa.int32()), pa.array(sizes, pa.int32()), *(pa.array(np.ascontiguousarray(parts[d])) for d in ("d1", "d2"))],
                ["id", "k", "at", "n", "d1", "d2"],
            )

    upper = F.xxhash64(F.lit(2), F.col(text_col)).bitwiseAND(F.lit(-1 << 32))
    lower = F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << 32) - 1))
    rows = docs.select(F.col(id_col).alias("id"), upper.bitwiseOR(lower).alias("k"), F.col(text_col).alias("t"))
    return written(in_arrow(rows, run, f"id {id_type}, k long, at int, n int, d1 long, d2 int"), "chunks")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_span: int = MIN_SPAN) -> DataFrame:
    """One row per span: ``id, k, start, end`` (bytes), ``removed_bytes`` and ``first_ids``.

    ``removed_bytes`` counts the chunks of the span that occur earlier elsewhere;
    ``first_ids`` lists the ids that hold their first occurrences.
    """
    cut = chunks(docs, id_col, text_col)
    place = F.struct("id", "k", "at")
    seen = cut.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("times"), F.min(place).alias("first")).where("times > 1")
    repeated = cut.join(seen, ["d1", "d2"]).select("id", "k", "at", "n", F.col("first.id").alias("first_id"), (place != F.col("first")).alias("later"))
    by_doc = Window.partitionBy("id", "k").orderBy("at")
    apart = F.coalesce(F.col("at") > F.lag(F.col("at") + F.col("n")).over(by_doc), F.lit(True))
    runs = repeated.withColumn("run", F.sum(apart.cast("int")).over(by_doc))
    spans = runs.groupBy("id", "k", "run").agg(
        F.min("at").alias("start"),
        F.max(F.col("at") + F.col("n")).alias("end"),
        F.sum(F.when(F.col("later"), F.col("n")).otherwise(0)).alias("removed_bytes"),
        F.array_sort(F.collect_set("first_id")).alias("first_ids"),
    )
    return spans.where(F.col("end") - F.col("start") >= min_span).select("id", "k", "start", "end", "removed_bytes", "first_ids")


def repeated_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_span: int = MIN_SPAN) -> DataFrame:
    """One row per document with repeated spans: ``id, n_spans, span_bytes, removed_bytes, spans``."""
    spans = repeated_spans(docs, id_col, text_col, min_span)
    return spans.groupBy("id", "k").agg(
        F.count(F.lit(1)).alias("n_spans"),
        F.sum(F.col("end") - F.col("start")).alias("span_bytes"),
        F.sum("removed_bytes").alias("removed_bytes"),
        F.array_sort(F.collect_list(F.struct("start", "end", "removed_bytes", "first_ids"))).alias("spans"),
    ).drop("k").withColumnRenamed("id", id_col)
