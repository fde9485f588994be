"""SentencePiece encoding and decoding by way of a table of distinct marked words.

After the marker U+2581 has taken the place of spaces (and one has been put in front),
a text is a sequence of chunks ``marker+ non-marker*``.  No piece of the vocabulary
holds a marker after another character (checked when the model is loaded), and BPE only
ever forms pieces of the vocabulary, so no piece crosses from one chunk into the next:
the ids of a text are the ids of its chunks, one after the other.

1. ``in_blocks(..., "chunks")``: each task numbers the distinct chunks of its rows, block by block,
   frequent ones first, and packs them into buckets by a hash of the chunk.
2. ``segmented``: the rows of a bucket meet in one task, which holds the bucket's part of the
   table of distinct chunks: a chunk is segmented when it is first met, whatever the
   number of blocks that hold it.  Ids go back under the block's numbers.
3. ``in_blocks(..., "texts")`` writes each text as the sequence of its chunks' numbers; texts
   and ids meet by block, and ids and decoded chunks are set in by position.

A frequent word is one entry for a block, not one for each occurrence, so no key is hot.
Blocks end at ``BLOCK_CHUNKS`` distinct chunks or ``BLOCK_CHARS`` characters, and a bucket's part of
the table is emptied at ``TABLE_CHUNKS``; both bound memory and change no result.  Input is read
twice and must give the same rows in the same order, as files do; other input
(``files=False``) is written to the shared folder first.  A checksum of each block's chunks
travels with both readings, and a difference is an error.

Defined results: null counts as the empty text, which has no ids; special strings in a
text are ordinary characters, as in the library; repeated rows are encoded row by row;
an empty table gives an empty table.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamtext.llm.common import in_arrow, written

MARK = "▁"
BLOCK_CHUNKS = 400_000
BLOCK_CHARS = 1 << 26
TABLE_CHUNKS = 1_000_000
#: Input bytes for each bucket, and bounds of the number of buckets.
BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS = 1 << 24, 32, 20_000
SLICE_CHARS = 1 << 20


@lru_cache(maxsize=2)
def load(path: str):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    for i in range(sp.get_piece_size()):
        if MARK in sp.id_to_piece(i).lstrip(MARK):
            raise ValueError("a piece crosses a whitespace marker; chunks are not independent")
    if sp.encode("  a") != sp.encode(" " + MARK + "a") or sp.encode("a b") == sp.encode("a  b"):
        raise ValueError("the model normalises white space; chunks are not independent")
    return sp


class Numbers(dict):
    """chunk -> number, given in order of first appearance."""

    def __missing__(self, chunk: str) -> int:
        self[chunk] = n = len(self)
        return n


def pack(numbers: np.ndarray) -> bytes:
    """Numbers as four compressed planes of bytes."""
    return zstandard.compress(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


_NEXT = re.compile(f"{MARK}({MARK}*[^{MARK}]*)")


def chunks_of(text: str) -> list[str]:
    """Chunks of a text, each without its first marker; none for the empty text."""
    marked = text.replace(" ", MARK)
    if not marked:
        return []
    if MARK + MARK not in marked and marked[0] != MARK:
        return marked.split(MARK)
    return _NEXT.findall(MARK + marked)


def segment(sp, chunks: list[str]) -> list[str]:
    """The ids, joined by commas, of chunks that are given without their first marker."""
    mark = [sp.piece_to_id(MARK)]
    return [",".join(map(str, i or mark)) for i in sp.encode(chunks, num_threads=1)] if chunks else []


def decode_chunks(sp, ids: list[str]) -> list[str]:
    """Decoded chunks; after another id, decoding keeps a chunk's first space."""
    mark = sp.piece_to_id(MARK)
    return sp.decode([[mark, *map(int, i.split(","))] for i in ids]) if ids else []


def set_in(ids_of: list[str], decoded_of: list[str], numbers: list[int]) -> tuple[str, int, str]:
    """A text's ids joined by commas, their number, and the decoded text, from its chunks' numbers."""
    ids = ",".join([ids_of[n] for n in numbers])
    decoded = "".join([decoded_of[n] for n in numbers])
    # decoding drops the space of the marker that was put in front
    return ids, ids.count(",") + 1 if ids else 0, decoded[1:] if decoded[:1] == " " else decoded


def slices(texts: pa.Array, chars: int) -> Iterator[list[str]]:
    """The texts in order, in lists of about so many characters; null as empty."""
    some, size = [], 0
    for t in texts:
        some.append(t.as_py() or "")
        size += len(some[-1])
        if size >= chars:
            yield some
            some, size = [], 0
    if some:
        yield some


class Block:
    """Rows whose chunks are numbered together."""

    def __init__(self, of: int):
        self.of, self.numbers, self.chars = of, Numbers(), 0
        self.ids: list[pa.Array] = []
        self.texts: list[np.ndarray] = []

    def add(self, ids: pa.Array, texts: list[str]) -> None:
        for t in texts:
            chunks = chunks_of(t)
            self.texts.append(np.fromiter(map(self.numbers.__getitem__, chunks), np.int32, len(chunks)))
            self.chars += len(t)
        self.ids.append(ids)

    def ranked(self) -> tuple[list[str], np.ndarray, int]:
        """Chunks by falling frequency, the rank of each first number, and a checksum."""
        chunks = list(self.numbers)
        times = np.bincount(np.concatenate(self.texts), minlength=len(chunks)) if chunks else np.zeros(0, np.int64)
        order = np.argsort(-times, kind="stable")
        rank = np.empty(len(chunks), np.int32)
        rank[order] = np.arange(len(chunks), dtype=np.int32)
        chunks = [chunks[k] for k in order.tolist()]
        return chunks, rank, zlib.crc32(" ".join(chunks).encode())

    def chunk_rows(self, buckets: int) -> pa.RecordBatch:
        chunks, _, check = self.ranked()
        held: dict[int, list[int]] = {}
        for n, c in enumerate(chunks):
            held.setdefault(zlib.crc32(c.encode()) % buckets, []).append(n)
        k = len(held)
        # chunks hold no spaces
        words = [zstandard.compress(" ".join([chunks[n] for n in of]).encode()) for of in held.values()]
        numbers = [pack(np.diff(np.array(of, np.int32), prepend=0)) for of in held.values()]
        return pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([self.of] * k, pa.int64()), pa.array([check] * k, pa.int64()), pa.array(numbers, pa.binary()), pa.array(words, pa.binary())], ["bucket", "block", "crc", "numbers", "words"])

    def text_rows(self) -> Iterator[pa.RecordBatch]:
        _, rank, check = self.ranked()
        at = 0
        for ids in self.ids:
            k = len(ids)
            numbers = [pack(rank[t]) for t in self.texts[at : at + k]]
            yield pa.RecordBatch.from_arrays([pa.array([self.of] * k, pa.int64()), pa.array([check] * k, pa.int64()), ids, pa.array(numbers, pa.binary())], ["block", "crc", "id", "numbers"])
            at += k


def in_blocks(rows: DataFrame, give: str, buckets: int = 0, block_chunks: int = BLOCK_CHUNKS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """From (id, t): ``(bucket, block, crc, numbers, words)`` or ``(block, crc, id, numbers)``."""

    def made(block: Block) -> Iterator[pa.RecordBatch]:
        if give == "texts":
            yield from block.text_rows()
        elif block.numbers:
            yield block.chunk_rows(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for b in batches:
            if not b.num_rows:
                continue
            at = 0
            block = block or Block(b.column(2)[0].as_py() << 32)
            for some in slices(b.column(1), min(block_chars, SLICE_CHARS)):
                block.add(b.column(0).slice(at, len(some)), some)
                at += len(some)
                if len(block.numbers) >= block_chunks or block.chars >= block_chars:
                    yield from made(block)
                    block = Block(block.of + 1)
        if block:
            yield from made(block)

    # a task's own number is another one when its stage is part of a union
    rows = rows.select("id", "t", F.spark_partition_id().alias("p"))
    if give == "texts":
        return in_arrow(rows, run, f"block long, crc long, id {rows.schema['id'].dataType.simpleString()}, numbers binary")
    return in_arrow(rows, run, "bucket int, block long, crc long, numbers binary, words binary")


def segmented(chunks: DataFrame, model: str, table_chunks: int = TABLE_CHUNKS) -> DataFrame:
    """``(block, crc, numbers, ids)`` for the buckets' rows; a chunk is segmented once for its bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, now, table = load(model), None, {}
        for b in batches:
            ids = []
            for bucket, packed in zip(b.column(0).to_pylist(), b.column(4)):
                if bucket != now or len(table) > table_chunks:
                    now, table = bucket, {}
                words = zstandard.decompress(packed.as_py()).decode().split(" ")
                new = [w for w in words if w not in table]
                table.update(zip(new, segment(sp, new)))
                ids.append(zstandard.compress(" ".join([table[w] for w in words]).encode()))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), b.column(3), pa.array(ids, pa.binary())], ["block", "crc", "numbers", "ids"])

    return in_arrow(chunks.repartition("bucket").sortWithinPartitions("bucket"), run, "block long, crc long, numbers binary, ids binary")


def bucket_count(docs: DataFrame) -> int:
    """By the optimizer's estimate of the input's size."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(LEAST_BUCKETS, min(MOST_BUCKETS, size // BUCKET_BYTES))


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = True, files: bool = False, **blocks: int) -> DataFrame:
    """Per row ``n_tokens`` and either digests, or the ids (array) and decoded text themselves.

    ``files`` says that ``docs`` comes from files by projections and filters alone.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    kinds = [pa.string(), pa.string()] if digests else [pa.list_(pa.int32()), pa.string()]
    names = ["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    rows = rows if files else written(rows, "rows")
    found = segmented(in_blocks(rows, "chunks", bucket_count(rows), **blocks), model)
    texts = in_blocks(rows, "texts", **blocks)
    both = found.select("block", F.lit(0).alias("kind"), "crc", F.lit(None).cast(id_type).alias("id"), "numbers", "ids").unionByName(
        texts.select("block", F.lit(1).alias("kind"), "crc", "id", "numbers", F.lit(None).cast("binary").alias("ids"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, block, crc = load(model), None, 0
        ids_of: list[str] = []
        decoded_of: list[str] = []
        for b in batches:
            kind = b.column(3).type
            made: list[list] = [[], [], [], []]
            size = 0
            for at, (of, chunks, check) in enumerate(zip(b.column(0).to_pylist(), (k == 0 for k in b.column(1).to_pylist()), b.column(2).to_pylist())):
                if of != block:
                    block, crc, ids_of, decoded_of = of, check, [], []
                if check != crc:
                    raise ValueError("the input gave other rows when it was read again")
                numbers = unpack(b.column(4)[at].as_py())
                if chunks:
                    ids = zstandard.decompress(b.column(5)[at].as_py()).decode().split(" ")
                    numbers = np.cumsum(numbers).tolist()
                    for table in (ids_of, decoded_of):
                        table.extend([""] * (numbers[-1] + 1 - len(table)))
                    for n, i, d in zip(numbers, ids, decode_chunks(sp, ids)):
                        ids_of[n], decoded_of[n] = i, d
                    continue
                ids, k, decoded = set_in(ids_of, decoded_of, numbers.tolist())
                if digests:
                    out = hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()
                else:
                    out = list(map(int, ids.split(","))) if ids else [], decoded
                    size += k
                for column, value in zip(made, (b.column(3)[at].as_py(), k, *out)):
                    column.append(value)
                if size >= SLICE_CHARS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(made, (kind, pa.int64(), *kinds))], ["id", "n_tokens", *names])
                    made, size = [[], [], [], []], 0
            if made[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(made, (kind, pa.int64(), *kinds))], ["id", "n_tokens", *names])

    types = "string, {} string" if digests else "array<int>, {} string"
    schema = f"id {id_type}, n_tokens long, {names[0]} {types.format(names[1])}"
    placed = both.repartition("block").sortWithinPartitions("block", "kind")
    return in_arrow(placed, run, schema).withColumnRenamed("id", id_col)
