"""Token counts with overlap resynchronisation for huge documents.

A text of at most ``CHUNK`` characters is encoded as it is.  A longer one is encoded in
overlapping chunks with offsets; two neighbouring chunks are spliced at a border that
is proven stable, and the overlap is widened until there is one.

A position p is proven stable for the model of a ``.json`` tokenizer that splits words
first, when p lies between two whole pre-tokens in both chunks and one white-space
character stands at p - 1 in the text, away from the chunks' own cut edges: white space
always ends a pre-token and is dropped, so what is on either side of it is encoded
independently.  Both encodings then have the border p, the tokens before p come from
the left chunk and those from p on from the right chunk.

Defined results: null counts as the empty text, which has no tokens; a text without
any white space in reach widens its overlap up to the last border, and is then encoded
from there in one piece of twice the length, so all tries together cost little more than the
last; repeated rows are counted row by row; an empty table gives an
empty table.  Other columns are not read.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamtext.llm.common import in_arrow

CHUNK = 32_768
OVERLAP = 256
#: Texts encoded in one call of the library.
BATCH_CHARS = 1 << 20


#: With the normaliser below, any other text is left to the library as a whole.  Up to
#: U+024F every character is its own NFC form, and lower-casing keeps positions but for
#: U+0130.
_ODD = re.compile("[^\x00-\u012f\u0131-\u024f]")
_NORMALISER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]


class Library:
    """A tokenizer file, and the same without its normaliser where that is plain.

    The library's normaliser tracks alignments character by character, a third of its
    time.  If it is NFC, white-space folding and lower-casing, and the words are cut by
    a pattern that drops white space, then lower-casing a text of plain characters
    first gives the same tokens.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.specials = tuple(t.content for t in self.full.get_added_tokens_decoder().values())
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cut = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        folds = (spec.get("normalizer") or {}).get("normalizers") == _NORMALISER
        drops = cut.get("behavior") == "Removed" and cut.get("invert") and "[^\\s\\p{L}\\p{N}]+" in str(cut.get("pattern", {}).get("Regex"))
        self.plain = None
        if folds and drops:
            self.plain = Tokenizer.from_file(path)
            self.plain.normalizer = None

    def prepared(self, text: str) -> tuple[object, str]:
        """The tokenizer to use and the text to give to it; positions are kept."""
        if self.plain is None or _ODD.search(text):
            return self.full, text
        lower = text.lower()
        # lower-casing can make a special string of a text that has none
        if any(s in text or s in lower for s in self.specials):
            return self.full, text
        return self.plain, lower


def encode_spans(tok, text: str) -> list[tuple[int, int]]:
    return tok.encode(text, add_special_tokens=False).offsets


@lru_cache(maxsize=2)
def load(path: str) -> Library:
    return Library(path)


def stable_border(text: str, left: list[int], right: list[int], lo: int, hi: int, specials: tuple[str, ...] = ()) -> int | None:
    """The last position in (lo, hi) that is proven stable, or None.

    ``left`` and ``right`` are the sorted token starts of the two chunks, as text
    positions.  The position starts a token in both, and follows white space.
    """
    shared = set(left) & set(right)
    for p in sorted((p for p in shared if lo < p < hi), reverse=True):
        if text[p - 1] in " \n\t\r" and not any(s in text[max(0, p - len(s)) : p + len(s)] for s in specials):
            return p
    return None


def count_huge(library: Library, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text longer than ``chunk``, spliced from overlapping chunks."""
    tok, text = library.prepared(text)
    total, at = 0, 0  # tokens before ``at`` are counted; ``at`` is a stable border
    end = min(len(text), chunk)
    left = [at + s for s, _ in encode_spans(tok, text[at:end])]
    while end < len(text):
        back, border = overlap, None
        while border is None:
            start = max(at, end - back)
            if start == at:  # the overlap has reached the last border: encode twice as much in one piece
                end = min(len(text), 2 * end - at)
                left = [at + s for s, _ in encode_spans(tok, text[at:end])]
                break
            stop = min(len(text), start + chunk)
            right = [start + s for s, _ in encode_spans(tok, text[start:stop])]
            # the first token of the right chunk and the last of the left one may be cut
            border = stable_border(text, left, right, start, end, library.specials)
            back *= 2
        else:
            total += bisect_left(left, border)
            left = right[bisect_left(right, border) :]
            at, end = border, stop
    return total + len(left)


def count_batch(library: Library, texts: list[str], chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    out = [0] * len(texts)
    some: dict[int, list[tuple[int, str]]] = {}
    size = 0

    def flush() -> None:
        for tok in (library.full, library.plain):
            rows = some.pop(id(tok), [])
            if rows:
                for (k, _), e in zip(rows, tok.encode_batch_fast([t for _, t in rows], add_special_tokens=False)):
                    out[k] = len(e)

    for k, t in enumerate(texts):
        if len(t) > chunk:
            out[k] = count_huge(library, t, chunk, overlap)
            continue
        tok, text = library.prepared(t)
        some.setdefault(id(tok), []).append((k, text))
        size += len(t)
        if size > BATCH_CHARS:
            flush()
            size = 0
    flush()
    return out


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` for each row."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        library = load(vocabulary)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            counts = count_batch(library, texts, chunk, overlap)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes"))
    out = in_arrow(rows, run, f"id {id_type}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit).withColumnRenamed("id", id_col)
