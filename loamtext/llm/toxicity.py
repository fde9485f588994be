"""Toxicity by a linear-chain conditional random field over words.

Fitting (on the driver, on a bounded sample of labelled rows: ``SAMPLE_ROWS`` rows of at
most ``SAMPLE_CHARS`` characters; of their stretches of ``STRETCH`` words at most
``MAX_STRETCHES``, those with a toxic token first and then by a hash; at most
``MAX_FEATURES`` features, the most strongly associated):

1. Words and beginnings of words are associated with the label by the number of distinct
   neighbour pairs that they occur between in toxic and in other rows, so copies of a
   text count once.  A token's feature is its word, else its longest known beginning.
2. Tokens of toxic rows whose feature is strongly associated are the toxic labelled
   tokens, all others the clean ones.
3. The field (feature weights, bias, transitions, start) is fitted to stretches of labelled
   tokens by maximum likelihood, forward-backward giving the gradients.
4. A logistic regression turns a document's marginals (largest, sum, share of words)
   into its score.

Scoring runs over every whole text.  Words without a feature share one potential, so the
chain between words that have one is a power of one matrix, whatever its length; the
marginals of the latter are exact, and no other word can be an offending one.  Scores use
the text only.

Defined results: a null text is scored as the empty one, which has no words; with no
labelled rows, or only one class of them, every score is the share of toxic rows (0
without rows); repeated rows get equal scores; rows of labels with a null are left out,
and a document with conflicting labels counts as toxic; an empty table gives an empty
table.  Other columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamtext.llm.common import in_arrow

SAMPLE_ROWS = 4000
SAMPLE_CHARS = 20_000
STRETCH = 32
MAX_STRETCHES = 6000
MAX_FEATURES = 2000
#: Lengths of beginnings, longest first, and the distinct words that one must stand for.
BEGINNINGS = (9, 8, 7, 6, 5, 4)
MIN_FORMS = 4
#: Characters of a word that decide whether its features are looked up at all.
GATE = 4
#: Toxic rows and distinct neighbour pairs in them from which a word may have a weight,
#: the log odds for a weight, and those that mark a token as toxic.
MIN_ROWS = 4
MIN_PAIRS = 5
KEPT_ODDS = 1.5
MIN_ODDS = 3.0
#: Powers of the background matrix that are made beforehand; higher ones when they are met.
POWERS = 256
THRESHOLD = 0.7
_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def feature_of(word: str, known) -> str | None:
    """``word`` itself, else ``beginning*`` for its longest known one."""
    if word in known:
        return word
    for n in BEGINNINGS:
        if len(word) > n and (key := word[:n] + "*") in known:
            return key
    return None


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    start: tuple[float, float] = (0.0, 0.0)
    transitions: tuple[tuple[float, float], tuple[float, float]] = ((0.0, 0.0), (0.0, 0.0))
    #: Of the document score: intercept, largest marginal, log of 1 + their sum, log of their share.
    document: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)
    constant: float | None = None


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.step = np.exp(np.array(model.transitions))
        ground = self.step * np.array([1.0, math.exp(model.bias)])
        power, self.powers = np.eye(2), []
        for _ in range(POWERS + 1):
            self.powers.append(power / power.sum())
            power = self.powers[-1] @ ground
        # its largest eigenvalue is 1, so no power of it runs over or vanishes
        self.whole = self.powers[POWERS] / np.abs(np.linalg.eigvals(self.powers[POWERS])).max()
        self.higher: dict[int, np.ndarray] = {}
        self.first = np.exp(np.array(model.start))
        self.gate = {f.rstrip("*")[:GATE] for f in model.weights}

    def gap(self, n: int) -> np.ndarray:
        """The n-th power of the background matrix, but for a factor."""
        if n > POWERS and n not in self.higher:
            if len(self.higher) >= 10_000:
                self.higher.clear()
            power = self.powers[n % POWERS] @ np.linalg.matrix_power(self.whole, n // POWERS)
            self.higher[n] = power / power.sum()
        return self.powers[n] if n <= POWERS else self.higher[n]

    def marginals(self, at: list[int], weights: list[float], n_words: int) -> list[float]:
        """P(toxic) at the given word positions, by forward-backward over the whole chain."""
        ground = np.array([1.0, math.exp(self.model.bias)])
        here = [np.array([1.0, math.exp(self.model.bias + w)]) for w in weights]
        forward = []
        for k, p in enumerate(at):
            if k:
                a = forward[-1] @ self.gap(p - at[k - 1] - 1) @ self.step
            elif p:
                a = (self.first * ground) @ self.gap(p - 1) @ self.step
            else:
                a = self.first
            a = a * here[k]
            forward.append(a / a.sum())
        out = [0.0] * len(at)
        back = self.gap(n_words - 1 - at[-1]) @ np.ones(2)
        for k in range(len(at) - 1, -1, -1):
            both = forward[k] * back
            out[k] = float(both[1] / both.sum())
            if k:
                back = self.gap(at[k] - at[k - 1] - 1) @ self.step @ (here[k] * back)
                back = back / back.sum()
        return out

    def document_score(self, marginals: list[float], n_words: int) -> float:
        if self.model.constant is not None:
            return self.model.constant
        c = self.model.document
        x = document_features(marginals, n_words)
        z = c[0] + sum(a * b for a, b in zip(c[1:], x))
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """The score and the offending spans (start, end, marginal) in code points."""
        text = text or ""
        at, weights, n = self.tokens(words_of(text))
        if not at:
            return self.document_score([], n), []
        p = self.marginals(at, weights, n)
        found = list(_WORD.finditer(text))
        return self.document_score(p, n), [(*found[k].span(), q) for k, q in zip(at, p) if q >= 0.5]

    def tokens(self, words: list[str]) -> tuple[list[int], list[float], int]:
        """Positions and weights of the words that have a feature, and the number of words."""
        gate, weights = self.gate, self.model.weights
        at, found = [], []
        for k in [k for k, w in enumerate(words) if w[:GATE] in gate]:
            key = feature_of(words[k], weights)
            if key is not None:
                at.append(k)
                found.append(weights[key])
        return at, found, len(words)


def document_features(marginals: list[float], n_words: int) -> tuple[float, float, float]:
    total = sum(marginals)
    return max(marginals, default=0.0), math.log1p(total), math.log((total + 0.05) / (n_words + 50))


def keyed_tokens(words: list[str]) -> Iterator[tuple[list[str], int]]:
    """The keys of each word (itself and its beginnings) and a hash of its neighbours."""
    for a, b, c in zip(["", *words], words, [*words[1:], ""]):
        yield [b, *(b[:n] + "*" for n in BEGINNINGS if len(b) > n)], hash((a, c))


def associated(rows: list[tuple[str, int]]) -> tuple[dict[str, int], set[str]]:
    """The features (key -> number) and those that mark a token as toxic.

    Neighbour pairs in other rows are gathered for keys that toxic rows suggest, and only
    until there are too many of them, which bounds memory.
    """
    split: list[list[list[str]]] = [[], []]
    for text, toxic in sorted(set(rows)):
        split[toxic].append(words_of(text))
    total = [sum(map(len, texts)) for texts in split]
    pairs: dict[str, set] = defaultdict(set)
    forms: dict[str, set] = defaultdict(set)
    holders: Counter = Counter()
    for words in split[1]:
        here: set[str] = set()
        for keys, around in keyed_tokens(words):
            for key in keys:
                pairs[key].add(around)
            for key in keys[1:]:
                forms[key].add(keys[0])
            here.update(keys)
        holders.update(here)
    seen = {k: len(v) for k, v in pairs.items() if len(v) >= MIN_PAIRS and holders[k] >= MIN_ROWS and (k[-1] != "*" or len(forms[k]) >= MIN_FORMS)}
    most = {k: (n + 0.5) / (total[1] + 1) * (total[0] + 1) / math.exp(KEPT_ODDS) - 0.5 for k, n in seen.items()}
    rest: dict[str, set] = {k: set() for k in seen}
    for words in split[0]:
        for keys, around in keyed_tokens(words):
            for key in keys:
                if key in rest:
                    rest[key].add(around)
                    if len(rest[key]) > most[key]:
                        del rest[key]
    odds = {k: math.log((seen[k] + 0.5) / (total[1] + 1)) - math.log((len(r) + 0.5) / (total[0] + 1)) for k, r in rest.items()}
    kept = sorted(odds, key=lambda k: (-odds[k], k))[:MAX_FEATURES]
    return {w: k for k, w in enumerate(kept)}, {w for w in kept if odds[w] >= MIN_ODDS}


def stretches(rows: list[tuple[str, int]], vocabulary: dict[str, int], marked: set[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids (-1: none) and labels of stretches of STRETCH tokens, those with a mark first, then by a hash."""
    with_mark, without = [], []
    for text, toxic in rows:
        w = words_of(text)
        for at in range(0, len(w) - STRETCH + 1, STRETCH):
            part = w[at : at + STRETCH]
            keys = [feature_of(x, vocabulary) for x in part]
            ids = [-1 if x is None else vocabulary[x] for x in keys]
            labels = [int(toxic and x in marked) for x in keys]
            (with_mark if any(labels) else without).append((zlib.crc32(" ".join(part).encode("utf-8", "surrogatepass")), ids, labels))
    chosen = (sorted(with_mark) + sorted(without))[:MAX_STRETCHES]
    return np.array([c[1] for c in chosen], np.int64).reshape(-1, STRETCH), np.array([c[2] for c in chosen], np.int64).reshape(-1, STRETCH)


def fit_field(ids: np.ndarray, labels: np.ndarray, n_words: int, rounds: int = 80, ridge: float = 1e-5) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """Feature weights, bias, start (2) and transitions (2 x 2) by maximum likelihood (Adam)."""
    theta = np.zeros(n_words + 1 + 2 + 4)
    theta[n_words] = -2.0
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    n, length = ids.shape
    known = ids >= 0
    slots = np.where(known, ids, 0)
    rows = np.arange(n)
    for step in range(1, rounds + 1):
        weights, bias, start, moves = theta[:n_words], theta[n_words], theta[n_words + 1 : n_words + 3], theta[n_words + 3 :].reshape(2, 2)
        emit = np.zeros((n, length, 2))
        emit[:, :, 1] = bias + np.where(known, weights[slots] if n_words else 0.0, 0.0)
        node, edge = np.exp(emit), np.exp(moves)
        forward, backward = np.empty((n, length, 2)), np.ones((n, length, 2))
        a = np.exp(start) * node[:, 0]
        forward[:, 0] = a / a.sum(1, keepdims=True)
        for t in range(1, length):
            a = (forward[:, t - 1] @ edge) * node[:, t]
            forward[:, t] = a / a.sum(1, keepdims=True)
        for t in range(length - 2, -1, -1):
            b = (node[:, t + 1] * backward[:, t + 1]) @ edge.T
            backward[:, t] = b / b.sum(1, keepdims=True)
        gamma = forward * backward
        gamma /= gamma.sum(2, keepdims=True)
        grad = np.zeros_like(theta)
        miss = gamma[:, :, 1] - labels
        if n_words:
            grad[:n_words] = np.bincount(slots[known], weights=miss[known], minlength=n_words)
        grad[n_words] = miss.sum()
        np.add.at(grad, n_words + 1 + labels[:, 0], -1.0)
        grad[n_words + 1 : n_words + 3] += gamma[:, 0].sum(0)
        pair = np.einsum("nti,ij,ntj->ntij", forward[:, :-1], edge, node[:, 1:] * backward[:, 1:])
        pair /= pair.sum((2, 3), keepdims=True)
        expected = pair.sum((0, 1))
        seen = np.zeros((2, 2))
        np.add.at(seen, (labels[:, :-1].ravel(), labels[:, 1:].ravel()), 1.0)
        grad[n_words + 3 :] = (expected - seen).ravel()
        grad = grad / len(rows) + ridge * theta
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        theta = theta - 0.2 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return theta[:n_words], float(theta[n_words]), theta[n_words + 1 : n_words + 3], theta[n_words + 3 :].reshape(2, 2)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, rounds: int = 30) -> np.ndarray:
    """Intercept and coefficients by Newton's method; the intercept is not penalised."""
    design = np.hstack([np.ones((len(x), 1)), x])
    c = np.zeros(design.shape[1])
    penalty = np.diag([0.0] + [ridge] * x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ c, -30, 30)))
        grad = design.T @ (p - y) / len(y) + penalty @ c
        hess = (design * (p * (1 - p))[:, None]).T @ design / len(y) + penalty + 1e-9 * np.eye(len(c))
        move = np.linalg.solve(hess, grad)
        c = c - move * min(1.0, 5.0 / (np.abs(move).max() + 1e-12))
    return c


def fit(rows: list[tuple[str, int]]) -> Model:
    toxic = sum(y for _, y in rows)
    if not rows or toxic in (0, len(rows)):
        return Model(constant=toxic / len(rows) if rows else 0.0)
    vocabulary, marked = associated(rows)
    ids, labels = stretches(rows, vocabulary, marked)
    model = Model()
    if len(ids) and vocabulary:
        weights, bias, start, moves = fit_field(ids, labels, len(vocabulary))
        model = Model({w: float(weights[k]) for w, k in vocabulary.items()}, bias, tuple(map(float, start)), tuple(tuple(map(float, r)) for r in moves))
    scorer = Scorer(model)
    x = []
    for text, _ in rows:
        at, weights, n = scorer.tokens(words_of(text))
        x.append(document_features(scorer.marginals(at, weights, n) if at else [], n))
    model.document = tuple(map(float, fit_logistic(np.array(x), np.array([y for _, y in rows], float))))
    return model


def held_out(id_col: str = "doc_id"):
    """Rows that labels are never learnt from: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = SAMPLE_ROWS) -> list[tuple[str, int]]:
    """At most ``rows`` labelled rows that are not held out, by a hash of their ids."""
    known = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).where("i is not null and y in (0, 1)")
    known = known.groupBy("i").agg(F.max("y").alias("y")).where(~held_out("i"))
    chosen = known.orderBy(F.xxhash64("i"), "i").limit(rows)
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where(F.char_length("t") <= SAMPLE_CHARS)
    found = texts.join(F.broadcast(chosen), "i").select("t", "y").limit(rows).collect()
    return sorted((r.t, r.y) for r in found)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``id_col, score, spans`` for each row; ``keep`` names more columns to carry along."""
    carried = [id_col, *(keep or [])]
    fields = ", ".join(f"c{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(carried))
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            made = [scorer.score(t) for t in b.column(len(carried)).to_pylist()]
            spans = [[{"start": s, "end": e, "marginal": p} for s, e, p in m[1]] for m in made]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k) for k in range(len(carried))), pa.array([m[0] for m in made], pa.float64()), pa.array(spans, span)],
                [*(f"c{k}" for k in range(len(carried))), "score", "spans"],
            )

    rows = docs.select(*(F.col(c).alias(f"c{k}") for k, c in enumerate(carried)), F.col(text_col).alias("t"))
    out = in_arrow(rows, run, f"{fields}, score double, spans array<struct<start: int, end: int, marginal: double>>")
    return out.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(carried)), "score", "spans")
