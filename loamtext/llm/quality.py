"""Quality rules as a short-circuit cascade.

The base rule comes first: its counts are part of the result, so every row pays for them.
The other rules' costs and selectivities are estimated on a bounded sample, drawn by a hash
of the rows; a cost is what a rule takes beyond the base counts, on the sample rows that the
base rule lets pass.  Rules are then ordered greedily by rejection per cost, each measured
on the rows that the rules before it let pass.  A document stops at the first rule that
rejects it, so the verdict (the conjunction of all rules) does not depend on the order.

Defined results: a null text has no words; a text without words fails the base
rule; repeated rows are judged row by row; an empty table gives an empty table.
Only ``id_col`` and ``text_col`` are read, so other columns may have any name.
"""

from __future__ import annotations

import copy
import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamtext.llm.common import in_arrow

SYMBOLS = b"#*$%&|<>"
SAMPLE_ROWS = 1000
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Features:
    """Counts over one text, each made when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def raw(self) -> bytes:
        return self.text.encode("utf-8", "surrogatepass")

    @cached_property
    def words(self) -> list[bytes]:
        # without an argument, bytes are split at exactly space, \t, \n, \v, \f and \r
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        spaces = len(self.raw) - len(self.raw.translate(None, b" \t\n\v\f\r"))
        return len(self.text) - spaces

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside 3-word windows that the text holds twice or more."""
        w = self.words
        grams = list(zip(w, w[1:], w[2:]))
        if len(set(grams)) == len(grams):
            return 0
        seen, covered, end = Counter(grams), 0, 0
        for i, gram in enumerate(grams):
            if seen[gram] > 1:
                covered += i + 3 - max(i, end)
                end = i + 3
        return covered


def base_counts(d: Features) -> tuple[list[int], bool]:
    """The counts of the result, and whether the base rule rejects the text."""
    counts = [getattr(d, name) for name in BASE]
    return counts, d.n_words < MIN_WORDS or 100 * d.n_repeat_words > MAX_REPEAT_PERCENT * d.n_words


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Features], bool]


#: Integer comparisons, so that SQL gives the same verdicts.
RULES = (
    Rule("word_length", lambda d: d.word_chars < 2 * d.n_words or d.word_chars > 15 * d.n_words),
    Rule("symbols", lambda d: 10 * d.n_symbols > d.n_words),
    Rule("exclamations", lambda d: 2 * d.raw.count(b"!") > d.n_words),
    Rule("repeated_lines", lambda d: 10 * d.n_dup_lines > 4 * len(d.lines)),
    Rule("distinct_words", lambda d: 10 * len(set(d.words)) < d.n_words),
    Rule("commonest_word", lambda d: 4 * max(Counter(d.words).values(), default=0) > d.n_words),
    Rule("repeated_windows", lambda d: 100 * d.n_repeat_words > 30 * d.n_words),
)


def order_rules(sample: list[tuple[int, list[float]]], names: list[str]) -> list[str]:
    """``sample``: per row a bit mask of the rules that reject it, and each rule's seconds."""
    left, todo, order = list(sample), list(range(len(names))), []
    while todo:

        def gain(k: int) -> tuple[float, int]:
            cost = sum(s[k] for _, s in left) + 1e-9
            return sum(m >> k & 1 for m, _ in left) / cost, -k

        best = max(todo, key=gain)
        order.append(names[best])
        todo.remove(best)
        left = [x for x in left if not x[0] >> best & 1]
    return order


def estimate_order(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """The order by rejection per cost on at most ``sample_rows`` rows, those of the least hashes.

    The rows are measured on the executors; a mask and a few numbers per sampled
    row come to the driver.
    """
    n = docs.count()
    if not n:
        return [r.name for r in rules]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            masks, costs = [], []
            for text in b.column(0).to_pylist():
                mask, row, d = 0, [], Features(text)
                if base_counts(d)[1]:
                    continue
                for k, rule in enumerate(rules):
                    # knows the base counts, as in the cascade, but nothing that another rule has made
                    own = copy.copy(d)
                    began = time.perf_counter()
                    mask |= bool(rule.rejects(own)) << k
                    row.append(time.perf_counter() - began)
                masks.append(mask)
                costs.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(masks, pa.int64()), pa.array(costs, pa.list_(pa.float64()))], ["mask", "cost"])

    # a third of the rows may be one text: the place in the scan enters the hash
    mark = F.xxhash64(F.lit(7), F.monotonically_increasing_id(), F.col(text_col))
    share = min(1.0, 2.0 * sample_rows / n)
    some = docs.select(F.col(text_col).alias("t"), mark.alias("mark")).where(F.col("mark") <= min(2**63 - 1, int((2 * share - 1) * 2**63)))
    sample = some.orderBy("mark").limit(sample_rows).select("t")
    rows = in_arrow(sample, measure, "mask long, cost array<double>").collect()
    return order_rules([(r.mask, list(r.cost)) for r in rows], [r.name for r in rules])


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, order: list[str] | None = None) -> DataFrame:
    """One row per document: base counts, ``base_failed`` and ``kept``.

    The base counts are asked for of every row; the cascade runs on rows that pass
    the base rule and makes only what its next rule needs.
    """
    order = estimate_order(docs, text_col, rules) if order is None else order
    by_name = {r.name: r for r in rules}
    ordered = [by_name[n] for n in order]
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for text in b.column(1).to_pylist():
                d = Features(text)
                counts, failed = base_counts(d)
                kept = not failed and not any(r.rejects(d) for r in ordered)
                for col, v in zip(out, (*counts, failed, kept)):
                    col.append(v)
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, t) for c, t in zip(out, kinds))],
                ["id", *BASE, "base_failed", "kept"],
            )

    schema = f"id {id_type.simpleString()}, {', '.join(f'{name} long' for name in BASE)}, base_failed boolean, kept boolean"
    return in_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), run, schema).withColumnRenamed("id", id_col)
