"""Line dedup by a log-template tree.

A line's tokens are cut at white space; tokens that hold a digit, an @ or :// are
variable fields and become ``<*>``.  The tree has a fixed depth: token count, then the
first ``LEADING`` tokens; what arrives at one leaf is grouped into templates by
comparing token by token (hashes of 32 bits).  Within a leaf, lines join the first
template that shares at least ``SIMILARITY`` of its tokens; tokens that differ become
variable.  Tokens are shuffled once, by leaf, for each distinct line of a task.

A leaf is grouped as a whole, whatever its size: lines arrive in order of their keys and
only templates are held.  A line and a template that may differ in d places share at least
one of any d + 1 blocks of places, so templates are looked up by such blocks and each one
found is compared in full; the result is that of a comparison with all of them.

A template recurs when ``MIN_DOCS`` different texts hold it: rows with one text count
once, so copies of a document are no reason to drop its lines.  Lines of a recurring
template are dropped from every document but the first text that holds it (by least id,
then text hash; null ids come first), which keeps one example in the corpus.

Defined results: a null text stays null and has no lines; blank lines and lines of fewer
than ``MIN_TOKENS`` tokens are never dropped; lines of fewer than ``TREE_TOKENS`` tokens
are templates of their own; repeated rows lose the same lines; a document whose lines
are all dropped stays, with an empty text; an empty table gives an empty table.  Other
columns are carried along under their own names; one called ``_dropped`` as ``_dropped_in``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from itertools import pairwise
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamtext.llm.common import carried, in_arrow, written

LEADING = 3
SIMILARITY = 0.75
MIN_DOCS = 3
MIN_TOKENS = 3
TREE_TOKENS = 5
#: Templates a task remembers, to write the tokens of a template once for many lines.
SEEN = 200_000
KEY = ["k1", "k2"]
_VARIABLE = re.compile(r"\S*(?:[0-9@]|://)\S*")
_SOME_VARIABLE = re.compile(r"[0-9@]|://")


def _number(data: bytes) -> int:
    return int.from_bytes(blake2b(data, digest_size=8).digest(), "little", signed=True)


def _describe(line: str) -> tuple[int, int, list[bytes]] | None:
    """Template key, leaf key and tokens (none if the line is a template of its own)."""
    tokens = (_VARIABLE.sub("<*>", line) if _SOME_VARIABLE.search(line) else line).encode("utf-8", "surrogatepass").split()
    n = len(tokens)
    if n < MIN_TOKENS:
        return None
    template = _number(b" ".join(tokens))
    if n < TREE_TOKENS:
        return template, template, []
    return template, _number(b"%d " % n + b" ".join(tokens[:LEADING])), tokens


def hash_tokens(tokens: list[bytes]) -> bytes:
    """Four bytes for each token."""
    import xxhash

    return b"".join(map(xxhash.xxh32_digest, tokens))


def describe_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line that may be dropped, written: keys of its document and of itself.

    ``tokens`` is null where the task has written those of an equal template before, and
    for templates that no other can join.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    names = ["id", *KEY, "line_no", "template", "leaf", "tokens"]
    kinds = [pa.int64()] * 2 + [pa.int32()] + [pa.int64()] * 2 + [pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            rows, at = [], []
            keys = zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist())
            for k, (k1, k2, text) in enumerate(keys):
                for no, line in enumerate(text.split("\n") if text else ()):
                    made = _describe(line)
                    if made:
                        template, leaf, tokens = made
                        new = bool(tokens) and template not in seen
                        if new:
                            if len(seen) >= SEEN:
                                seen.clear()
                            seen.add(template)
                        rows.append((k1, k2, no, template, leaf, hash_tokens(tokens) if new else None))
                        at.append(k)
            cols = list(zip(*rows)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds))], names)

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.lit(1), id_col).alias("k1"), F.xxhash64(F.lit(2), text_col).alias("k2"), F.col(text_col).alias("t"))
    schema = f"id {id_type}, k1 long, k2 long, line_no int, template long, leaf long, tokens binary"
    return written(in_arrow(rows, run, schema), "lines")


class Templates:
    """The templates of one leaf in the order they were founded; a line joins the first that fits.

    ``lead`` positions at the start are equal in all lines of the leaf.
    """

    STEP = 256

    def __init__(self, width: int, similarity: float = SIMILARITY, lead: int = 0):
        self.needed = ceil(similarity * width)
        parts = width - self.needed + 1
        # fewer places than that: no block need be shared, and a line is compared with all templates
        self.edges = [lead + (width - lead) * i // parts for i in range(parts + 1)] if parts <= width - lead else None
        self.held = np.empty((4, width), np.int32)
        self.fixed = np.empty((4, width), bool)
        self.names: list[int] = []
        self.at: dict[tuple[int, bytes], list[int]] = {}

    def _keys(self, row: np.ndarray) -> list[tuple[int, bytes]]:
        data, edges = row.astype(np.int32, copy=False).tobytes(), self.edges
        return [(a, data[4 * a : 4 * b]) for a, b in pairwise(edges)]

    def join(self, name: int, row: np.ndarray) -> int:
        """The key of the template the line joins: its own, if it founds one."""
        n = len(self.names)
        keys = self._keys(row) if self.edges else []
        found = sorted({j for k in keys for j in self.at.get(k, ())}) if self.edges else range(n)
        for a in range(0, len(found), self.STEP):
            some = np.array(found[a : a + self.STEP])
            same = (self.held[some] == row) & self.fixed[some]
            enough = np.nonzero(same.sum(1) >= self.needed)[0]
            if len(enough):
                j = some[enough[0]]
                self.fixed[j] = same[enough[0]]
                return self.names[j]
        if n == len(self.held):
            self.held = np.concatenate([self.held, np.empty_like(self.held)])
            self.fixed = np.concatenate([self.fixed, np.empty_like(self.fixed)])
        self.held[n], self.fixed[n] = row, True
        self.names.append(name)
        for k in keys:
            self.at.setdefault(k, []).append(n)
        return name


def group_leaf(templates: np.ndarray, blocks: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """For each line of a leaf (in template-key order) the key of the template it joins."""
    found = Templates(blocks.shape[1], similarity)
    return np.array([found.join(t, row) for t, row in zip(templates.tolist(), blocks)], np.int64)


def merged_templates(lines: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``(template, merged)`` for the lines that have joined another line's template, written."""
    held = lines.where("tokens is not null").select("leaf", "template", "tokens")
    sorted_leaves = held.repartition("leaf").sortWithinPartitions("leaf", "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last, first, found = None, None, None, None
        for b in batches:
            joined: list[tuple[int, int]] = []
            for leaf, template, row in shared_leaves(b):
                if leaf != at:
                    at, first, found = leaf, (template, row.copy()), None
                elif template != last:  # else another task's copy of the line
                    if found is None:  # most leaves hold one line and need no templates
                        found = Templates(len(row), similarity, LEADING)
                        found.join(*first)
                    merged = found.join(template, row)
                    if merged != template:
                        joined.append((template, merged))
                last = template
            cols = list(zip(*joined)) if joined else [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["template", "merged"])

    return written(in_arrow(sorted_leaves, run, "template long, merged long"), "merged")


def shared_leaves(b: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    """Leaf, template and token hashes of the rows of a batch sorted by leaf, but for rows inside
    the batch whose neighbours are of other leaves."""
    leaves, templates, tokens = (b.column(c) for c in ("leaf", "template", "tokens"))
    leaves, templates = leaves.to_numpy(), templates.to_numpy()
    if not len(leaves):
        return
    equal = leaves[1:] == leaves[:-1]
    shared = np.ones(len(leaves), bool)
    shared[1:-1] = equal[:-1] | equal[1:]
    ends = np.frombuffer(tokens.buffers()[1], np.int32)[tokens.offset : tokens.offset + len(leaves) + 1]
    for k in np.nonzero(shared)[0].tolist():
        yield int(leaves[k]), int(templates[k]), np.frombuffer(tokens.buffers()[2], np.int32, (ends[k + 1] - ends[k]) // 4, ends[k])


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, similarity: float = SIMILARITY) -> DataFrame:
    """``(k1, k2, lines)``: the numbers of the lines to drop from each document."""
    lines = describe_lines(docs, id_col, text_col)
    merged = merged_templates(lines, similarity)
    named = lines.join(merged, "template", "left").select("id", *KEY, "line_no", F.coalesce("merged", "template").alias("template"))
    # a text counts once, and the first to hold a template is the one with the least id
    holders = named.groupBy("template", "k2").agg(F.min(F.struct("id", *KEY)).alias("holder"))
    recurring = holders.groupBy("template").agg(F.count(F.lit(1)).alias("n"), F.min("holder").alias("first")).where(F.col("n") >= min_docs)
    # written, so that both sides of the next join are dealt anew and a hot template can be split
    first = written(recurring.select("template", F.col("first.k1").alias("first1"), F.col("first.k2").alias("first2")), "recurring")
    gone = named.join(first, "template").where("k1 <> first1 or k2 <> first2")
    return gone.groupBy(*KEY).agg(F.collect_set("line_no").alias("lines"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows with ``text_col`` less its dropped lines, and the line numbers in ``_dropped``."""
    inner = {c: f"_in_{k}" for k, c in enumerate(docs.columns)}
    rows = docs.toDF(*inner.values())
    the_id, text = inner[id_col], inner[text_col]
    gone = dropped_lines(rows, the_id, text, **settings)
    keyed = rows.withColumns({"k1": F.xxhash64(F.lit(1), the_id), "k2": F.xxhash64(F.lit(2), text)}).join(gone, KEY, "left")
    left = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains("lines", i)), "\n")
    cleaned = F.when(F.col("lines").isNull(), F.col(text)).otherwise(left)
    names = carried(docs.columns, "_dropped")
    back = [(cleaned if c == text_col else F.col(v)).alias(name) for name, (c, v) in zip(names, inner.items())]
    return keyed.select(*back, F.coalesce(F.array_sort("lines"), F.array().cast("array<int>")).alias("_dropped"))
