import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm.mixing import fit, learn_words, mix, rate, with_posteriors

WORDS = {"de": ["der", "und", "ist"], "en": ["the", "and", "is"], "fr": ["les", "qui", "est"]}


def corpus(n=300):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        lang = rng.choices(["en", "de", "fr"], [7, 2, 1])[0]
        rows.append((i, " ".join(rng.choices([*WORDS[lang], f"x{rng.randrange(50)}"], k=rng.randrange(3, 60))), lang))
    return rows


def frames(spark, extra=()):
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t, _ in [*corpus(), *extra]], "doc_id long, text string, word string, domain int").repartition(3)
    labelled = spark.createDataFrame([(i, d) for i, _, d in corpus() if i % 3] + [(None, "en"), (2, None)], "doc_id long, domain string")
    return docs, labelled


def test_expected_tokens_match_targets(spark):
    docs, labelled = frames(spark, [(900, None, ""), (901, "", ""), (902, "the and " * 20_000, ""), (5, corpus()[5][1], ""), (None, "der und", "")])
    weights = {"en": 2.0, "de": 1.0, "fr": 1.0, "zz": 0.0}
    out = mix(docs, labelled, weights)
    rows = out.collect()
    assert len(rows) == 305 and {"word", "domain", "text"} <= set(out.columns)
    by = {r.doc_id: r for r in rows}
    assert sum(by[i].mix_domain == d for i, _, d in corpus()) >= 290
    assert by[900].mix_tokens == by[901].mix_tokens == 0 and by[902].mix_tokens == 40_000 and by[902].mix_domain == "en"
    assert all(r.mix_rate >= 0 for r in rows)
    domains, odds, left = learn_words(docs, labelled)
    again = with_posteriors(docs, domains, odds, left).persist()
    steps, miss = fit(again, None, [0.25, 0.5, 0.25])
    assert miss <= 1e-6
    got = again.agg(*[F.sum(rate(steps) * F.col("mix_tokens") * F.col("mix_posteriors")[j]) for j in range(3)]).first()
    assert [x / sum(got) for x in got] == pytest.approx([0.25, 0.5, 0.25], rel=1e-5)
    assert min(r.mix_rate for r in rows) > 0.9


def test_projection_and_brute_force(spark):
    """Against projected gradient steps in plain Python, with a target that drives rates to zero."""
    data = [(10, [0.9, 0.1]), (20, [0.6, 0.4]), (5, [0.05, 0.95]), (0, [0.5, 0.5])]
    frame = spark.createDataFrame(data, "mix_tokens long, mix_posteriors array<double>")
    targets = [3.0, 40.0]
    steps, left = fit(frame, targets, [0.5, 0.5], close=0)
    assert left < 1e-3
    r, size = [1.0] * 4, None
    for s in steps:
        now = [sum(x * t * p[j] for x, (t, p) in zip(r, data, strict=True)) for j in range(2)]
        gram = [[sum(t * p[j] * p[k] for x, (t, p) in zip(r, data, strict=True) if x > 0) for k in range(2)] for j in range(2)]
        move = np.linalg.inv(gram) @ (np.array(now) - targets)
        share = s[0] / move[0]
        assert s == pytest.approx(list(share * move), rel=1e-6, abs=1e-9) and np.log2(share) == pytest.approx(round(np.log2(share)))
        r = [max(0.0, x - sum(a * b for a, b in zip(p, s, strict=True))) for x, (_, p) in zip(r, data, strict=True)]
        before, size = size, max(abs(sum(x * t * p[j] for x, (t, p) in zip(r, data, strict=True)) - targets[j]) for j in range(2))
        assert before is None or size <= before * (1 + 1e-9) + 1e-9
    assert [x[0] for x in frame.select(rate(steps)).collect()] == pytest.approx(r)
    assert min(r) < 1e-9


def test_what_cannot_be_met_is_said(spark):
    frame = spark.createDataFrame([(10, [1.0, 0.0]), (20, [1.0, 0.0])], "mix_tokens long, mix_posteriors array<double>")
    steps, left = fit(frame, [10.0, 10.0], [0.5, 0.5])
    assert left == pytest.approx(0.5) and len(steps) <= 11


def test_classifier_is_naive_bayes(spark):
    docs, labelled = frames(spark, [(900, None, ""), (901, "ist ist the zzz", "")])
    domains, odds, left = learn_words(docs, labelled)
    lang = {i: d for i, _, d in corpus() if i % 3}
    lang[2] = dict((i, d) for i, _, d in corpus())[2]
    has = lambda t: set(re.split(r"[^a-z]+", (t or "").lower())) - {""}
    own = {d: [has(t) for i, t, _ in corpus() if lang.get(i) == d] for d in domains}
    total = sum(map(len, own.values()))
    p = {w: [(sum(w in x for x in own[d]) + 0.5) / (len(own[d]) + 1) for d in domains] for w in odds}
    assert {w for ws in WORDS.values() for w in ws} <= set(odds)
    for r in with_posteriors(docs, domains, odds, left).collect():
        logs = [math.log(len(own[d]) / total) + sum(math.log(p[w][j] if w in has(r.text) else 1 - p[w][j]) for w in odds) for j, d in enumerate(domains)]
        top = [math.exp(x - max(logs)) for x in logs]
        assert r.mix_posteriors == pytest.approx([x / sum(top) for x in top], rel=1e-6, abs=1e-12)
        assert r.mix_tokens == len((r.text or "").split())


def test_clashing_names_are_replaced(spark):
    docs, labelled = frames(spark)
    out = mix(docs.withColumns({"mix_rate": F.lit("x"), "kept": F.lit(1), "mix_posteriors": F.lit(2)}), labelled, {"en": 1.0, "de": 1.0})
    assert out.columns == ["doc_id", "text", "word", "domain", "kept", "mix_posteriors", "mix_tokens", "mix_domain", "mix_posterior", "mix_rate"]
    assert out.count() == 300


def test_no_labels_and_empty(spark):
    docs, labelled = frames(spark)
    assert {(r.mix_rate, r.mix_domain) for r in mix(docs, labelled.limit(0), {"en": 1.0}).collect()} == {(1.0, None)}
    assert mix(docs.limit(0), labelled, {"en": 1.0}).collect() == []
