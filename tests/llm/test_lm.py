import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import lm
from ledgerline.llm.lm import END, LogBilinear, Shape, score_texts, shared_class, tokens

SMALL = Shape(own=6, shared=4, head=12, dims=4, noise=5, batch=64)


def rows():
    rng = random.Random(8)
    de, en = ["der", "die", "ist", "ein", "Haus", "ñu"], ["the", "of", "is", "a", "house", "x"]
    out = [(i, " ".join(rng.choices(rng.choice([de, en]) + [f"r{rng.randrange(40)}"], k=rng.randrange(1, 60)))) for i in range(200)]
    return [*out, (200, None), (201, ""), (202, " \t\n"), (203, "THE the the"), (204, "neverseen neverseen"), (205, "the " * 30_000), (3, out[3][1]), (None, "the of")]


def counted(docs, learn):
    counts = Counter()
    for i, t in docs:
        if learn(i):
            counts.update(tokens(t.encode() if t is not None else None))
    return counts


@pytest.mark.parametrize("shape", [SMALL, Shape(own=6, shared=4, head=10_000, dims=4, noise=5, batch=64)])
def test_counts_and_base_match_brute_force(spark, shape):
    docs = spark.createDataFrame([(a, b, "clash", 1) for a, b in rows()], "doc_id long, text string, word string, row long").repartition(3)
    got = score_texts(docs, F.coalesce(F.col("doc_id") % 5 != 1, F.lit(True)), shape).collect()
    counts = counted(rows(), lambda i: i is None or i % 5 != 1)
    total, kinds = sum(counts.values()), len(counts)
    expected = []
    for i, t in rows():
        words = tokens(t.encode() if t is not None else None)
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in words)
        expected.append((i is None, i, i is None or i % 5 != 1, len(words), sum(counts[w] > 0 for w in words), total, round(base, 4)))
    assert sorted((r.doc_id is None, r.doc_id, r.learnt_from, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == sorted(expected)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_model_is_normalised_and_learns():
    shape = Shape(own=12, shared=4, dims=4, noise=8, batch=256)
    rng = np.random.default_rng(1)
    model = LogBilinear(shape, np.full(16, 1 / 16))
    a = rng.integers(0, 16, 60_000)
    c = (a + 3) % 16  # the class two before decides
    b = rng.integers(0, 16, 60_000)
    score = lambda: (((model.predict(a, b) * model.o[c]).sum(1) + model.bias[c]) - model.normalisers(np.arange(16))[a, b]).mean()
    before = score()
    for i in range(0, 60_000, 256):
        model.train(a[i : i + 256], b[i : i + 256], c[i : i + 256], rng, 0.3)
    assert abs(before + math.log(16)) < 0.1 < score() - before
    z, every = model.normalisers(np.array([3])), np.arange(16)
    p = np.exp(model.predict(np.full(16, 3), np.full(16, 5)) @ model.o.T + model.bias - z[0, 5])[0]
    assert abs(p.sum() - 1) < 1e-4 and len(p) == len(every)


def test_words_share_a_class_by_their_first_letters():
    assert shared_class(b"house", SMALL) == shared_class(b"hour", SMALL) >= SMALL.own
    assert tokens(None) == tokens(b"") == [END]


def test_nothing_to_learn_from_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in score_texts(docs, F.lit(False), SMALL).collect()}
    assert (got[1].n_tokens, got[1].n_known, got[1].train_tokens, got[1].base_score) == (3, 0, 0, 0.0) and got[2].n_tokens == 1
    assert score_texts(docs.limit(0), F.lit(True), SMALL).collect() == []


@pytest.mark.parametrize("shape", [SMALL, Shape(own=30, shared=4, head=10_000, dims=4, noise=5, batch=64, block=500)])
def test_scores_are_those_of_a_plain_softmax(spark, monkeypatch, shape):
    """Word by word: the class's softmax over all classes in plain Python, times the word's share of its class."""
    docs = spark.createDataFrame(rows(), "doc_id long, text string").repartition(3)
    learn = F.coalesce(F.col("doc_id") % 5 != 1, F.lit(True))
    fit = lm.fitted(docs, learn, shape)
    monkeypatch.setattr(lm, "fitted", lambda *_: fit)
    got = {(r.doc_id, r.n_tokens): r.score for r in score_texts(docs, learn, shape).collect()}
    counts = counted(rows(), lambda i: i is None or i % 5 != 1)
    own = {w: k for k, w in enumerate(sorted(counts, key=lambda w: (-counts[w], w))[: shape.own])}
    cls = lambda w: own.get(w, shared_class(w, shape))
    mass, types = Counter(), Counter()
    for w, c in counts.items():
        mass[cls(w)] += c
        types[cls(w)] += 1
    inside = lambda w, c: 1.0 if w in own else (c + 0.5) / (mass[cls(w)] + 0.5 * (types[cls(w)] + 1))
    m = fit.model

    def softmax(a, b):
        z = [sum(float((m.mix[0][d] * m.r[a][d] + m.mix[1][d] * m.r[b][d]) * m.o[k][d]) for d in range(shape.dims)) + float(m.bias[k]) for k in range(shape.classes)]
        e = [math.exp(x - max(z)) for x in z]
        return [x / sum(e) for x in e]

    for i, t in rows()[:20] + rows()[200:205]:
        words = tokens(t.encode() if t is not None else None)
        at = [cls(END)] * 2 + [cls(w) for w in words]
        plain = sum(math.log10(softmax(at[k], at[k + 1])[at[k + 2]] * inside(w, counts[w])) for k, w in enumerate(words))
        assert got[(i, len(words))] == pytest.approx(plain, rel=1e-4)
    p = softmax(0, shape.own)
    unseen = {k: 0.5 / (mass[k] + 0.5 * (types[k] + 1)) for k in range(shape.own, shape.classes)}
    assert sum(p[cls(w)] * inside(w, c) for w, c in counts.items()) + sum(p[k] * u for k, u in unseen.items()) == pytest.approx(1, abs=1e-5)


def test_partitions_do_not_matter(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string")
    shape = Shape(own=6, shared=4, head=12, dims=4, noise=5, batch=64, block=2000)
    a, b = ({(str(r.doc_id), r.n_tokens, round(r.score, 3)) for r in score_texts(docs.repartition(n), F.lit(True), shape).collect()} for n in (1, 7))
    assert a == b


def test_head_is_bounded_by_a_threshold(spark):
    counts = spark.createDataFrame([(bytes([65 + i]), c) for i, c in enumerate([1, 1, 1, 2, 3, 4, 9, 17])], "word binary, c long")
    for most, size, least in ((8, 8, 1), (7, 5, 2), (4, 3, 4), (1, 1, 16), (0, 0, 32)):
        head, bound = lm.head_of(counts, most)
        assert (len(head), bound) == (size, least) and [r.c for r in head] == sorted((r.c for r in head), reverse=True)
