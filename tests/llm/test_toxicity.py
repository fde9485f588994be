import math
import random
import zlib

import numpy as np
import pytest

from loamtext.llm import toxicity as tox


@pytest.fixture(scope="module")
def model():
    r = random.Random(8)
    clean = ["".join(r.choices("abcdefgh", k=r.randrange(3, 8))) for _ in range(300)]
    rows = []
    for k in range(300):
        w = r.choices(clean, k=r.randrange(40, 120))
        if k % 5 == 0:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(["vile", "nasty", "grim" + r.choice(clean)]))
        rows.append((" ".join(w), int(k % 5 == 0)))
    return tox.fit(sorted(rows)), clean


def test_marginals_equal_the_plain_recursion(model):
    m, clean = model
    s = tox.Scorer(m)
    r = random.Random(2)
    for _ in range(40):
        words = [r.choice(["vile", "nasty", "grimabc", *clean[:5]]) for _ in range(r.randrange(1, 30))]
        emit = []
        for w in words:
            key = tox.feature_of(w, m.weights)
            emit.append(np.array([1.0, math.exp(m.bias + (m.weights[key] if key else 0.0))]))
        step = np.exp(np.array(m.transitions))
        fwd = [np.exp(np.array(m.start)) * emit[0]]
        for e in emit[1:]:
            fwd.append((fwd[-1] @ step) * e)
        back = [np.ones(2)]
        for e in reversed(emit[1:]):
            back.insert(0, step @ (e * back[0]))
        want = [float((f * b)[1] / (f * b).sum()) for f, b in zip(fwd, back)]
        at, weights, n = s.tokens(words)
        if at:
            assert np.allclose(s.marginals(at, weights, n), [want[k] for k in at], atol=1e-9)


def test_spans_and_scores(model):
    m, clean = model
    s = tox.Scorer(m)
    text = f"İ {clean[0]} {clean[1]} Vile, {clean[2]} grimabab"
    score, spans = s.score(text)
    assert score >= 0.7
    assert [text[a:b] for a, b, _ in spans] == ["Vile", "grimabab"]
    assert s.score(" ".join(clean[:40]))[0] < 0.3
    assert 0 <= s.score("")[0] <= 1 and s.score(None) == s.score("")


def test_one_class_or_no_rows():
    assert tox.Scorer(tox.fit([])).score("x")[0] == 0.0
    assert tox.Scorer(tox.fit([("a", 1), ("b", 1)])).score("x")[0] == 1.0


def test_held_out_rows_teach_nothing(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    texts = {}
    for r in docs.join(labels, "doc_id").collect():
        texts.setdefault(r.text, []).append(r.doc_id)
    got = tox.sample(docs, labels)
    assert got and all(any(zlib.crc32(str(i).encode()) % 3 != 1 for i in texts[t]) for t, _ in got)
    assert len(got) == sum(zlib.crc32(str(r.doc_id).encode()) % 3 != 1 for r in labels.join(docs, "doc_id").collect())
    assert len(tox.sample(docs, labels, rows=5)) <= 5


def test_accuracy_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = tox.score(docs, tox.fit(tox.sample(docs, labels))).join(labels, "doc_id").where(tox.held_out()).collect()
    picked = [r for r in out if r.score >= tox.THRESHOLD]
    assert sum(r.toxic for r in picked) >= 0.95 * len(picked)
    assert len(picked) >= 0.7 * sum(r.toxic for r in out)


def test_odd_rows(model, odd, odd_rows, none):
    out = tox.score(odd, model[0], keep=["score", "id"] if False else ["id", "k1"])
    assert sorted((r.doc_id for r in out.collect()), key=repr) == sorted((r[0] for r in odd_rows), key=repr)
    assert tox.score(none, model[0]).count() == 0


def test_marginals_over_long_gaps_equal_the_plain_recursion(model):
    m, clean = model
    s = tox.Scorer(m)
    for gap in (3, tox.POWERS, tox.POWERS + 1, 2000):
        words = ["vile", *[clean[k % 50] for k in range(gap)], "nasty", clean[1]]
        emit = [np.array([1.0, math.exp(m.bias + (m.weights[key] if (key := tox.feature_of(w, m.weights)) else 0.0))]) for w in words]
        step = np.exp(np.array(m.transitions))
        fwd, back = [np.exp(np.array(m.start)) * emit[0]], [np.ones(2)]
        for e in emit[1:]:
            f = (fwd[-1] @ step) * e
            fwd.append(f / f.sum())
        for e in reversed(emit[1:]):
            b = step @ (e * back[0])
            back.insert(0, b / b.sum())
        want = [float((f * b)[1] / (f * b).sum()) for f, b in zip(fwd, back)]
        at, weights, n = s.tokens(words)
        assert np.allclose(s.marginals(at, weights, n), [want[k] for k in at], atol=1e-9)


def chain_likelihood(theta, ids, labels, n_words, ridge):
    """Mean negative log-likelihood of the field, by enumeration of all labellings."""
    from itertools import product

    weights, bias, start, moves = theta[:n_words], theta[n_words], theta[n_words + 1 : n_words + 3], theta[n_words + 3 :].reshape(2, 2)
    total = 0.0
    for row, y in zip(ids, labels):
        def energy(tags):
            e = start[tags[0]] + sum(moves[a, b] for a, b in zip(tags, tags[1:]))
            return e + sum(t * (bias + (weights[k] if k >= 0 else 0.0)) for t, k in zip(tags, row))

        total += math.log(sum(math.exp(energy(t)) for t in product((0, 1), repeat=len(row)))) - energy(tuple(y))
    return total / len(ids) + ridge / 2 * float(theta @ theta)


def test_fitting_finds_a_minimum_of_the_likelihood():
    r = np.random.default_rng(3)
    ids = r.integers(-1, 3, (12, 6))
    labels = ((ids == 0) | (r.random((12, 6)) < 0.15)).astype(int)
    w, bias, start, moves = tox.fit_field(ids, labels, 3, rounds=600, ridge=0.05)
    theta = np.concatenate([w, [bias], start, moves.ravel()])
    best = chain_likelihood(theta, ids, labels, 3, 0.05)
    assert best < chain_likelihood(np.zeros_like(theta), ids, labels, 3, 0.05) - 0.5
    for k in range(len(theta)):
        for move in (-0.05, 0.05):
            other = theta.copy()
            other[k] += move
            assert chain_likelihood(other, ids, labels, 3, 0.05) > best - 1e-3


def test_logistic_fit_has_no_gradient_left():
    r = np.random.default_rng(5)
    x = r.normal(size=(200, 2))
    y = (x[:, 0] + 0.5 * r.normal(size=200) > 0).astype(float)
    c = tox.fit_logistic(x, y, ridge=0.01)
    design = np.hstack([np.ones((200, 1)), x])
    p = 1 / (1 + np.exp(-design @ c))
    assert np.abs(design.T @ (p - y) / 200 + np.array([0, 0.01, 0.01]) * c).max() < 1e-6


def test_columns_of_the_query(spark, small):
    from loamtext.llm import queries

    rows = queries.op9_toxicity(spark, small).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


def test_stretches_are_chosen_by_their_hash(monkeypatch):
    rows = sorted((" ".join(f"{c}{k}" for k in range(tox.STRETCH)), 0) for c in "abcdefghijklmnopqrst")
    monkeypatch.setattr(tox, "MAX_STRETCHES", 8)
    vocabulary = {f"{c}0": n for n, c in enumerate("abcdefghijklmnopqrst")}
    ids, _ = tox.stretches(rows, vocabulary, set())
    assert len(ids) == 8 and sorted(ids[:, 0].tolist()) != list(range(8))
