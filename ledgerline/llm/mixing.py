"""Mixing documents to target weights by domain, in DataFrame operations only.

A naive Bayes model over the presence of telling words, learnt from a labelled table, gives each document posteriors over the domains. Each document then gets a
nonnegative rate (how often it is to be read) by projected-gradient least squares: starting from one, rates go down the gradient of the squared misses of the domains' expected tokens,
in the metric of the domains' Gram matrix, and never below zero. An iteration passes over a few numbers a document and returns one total per domain.
"""

from __future__ import annotations

import warnings
from math import log

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import hashed_sample, written


ADDED = ("mix_tokens", "mix_domain", "mix_posterior", "mix_rate")


def n_tokens(text: Column) -> Column:
    """Runs of other characters than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _words(text: Column) -> Column:
    return F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+"))


def learn_words(docs: DataFrame, labelled: DataFrame, rows: int = 20_000, words: int = 32) -> tuple[list[str], dict[str, list[float]], list[float]]:
    """(domains, word -> log-odds of its presence per domain, what is left per domain) from labelled(doc_id, domain).

    A bounded sample: at most `rows` labelled documents, picked by a hash of their id, and `words` words per domain, those whose share of
    documents differs most between the domain and the rest. A document with several domains counts for the first in order.
    """
    sample = hashed_sample(labelled.where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain")), "doc_id", rows)
    own = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("domain", F.explode(F.concat(_words(F.coalesce("text", F.lit(""))), F.array(F.lit(" ")))).alias("word"))
    counts = written(own.where("word <> ''").groupBy("word", "domain").agg(F.count("*").alias("n")), "mix-words")
    of = {r.domain: r.n for r in counts.where("word = ' '").collect()}  # every document has this one
    domains, total = sorted(of), sum(of.values())
    wide = counts.where("word <> ' '").groupBy("word").agg(F.sum("n").alias("all"), *[F.coalesce(F.sum(F.when(F.col("domain") == d, F.col("n"))), F.lit(0)).alias(f"n{j}") for j, d in enumerate(domains)])
    chosen: dict[str, list[int]] = {}
    for j, d in enumerate(domains):
        apart = F.col(f"n{j}") / of[d] - (F.col("all") - F.col(f"n{j}")) / max(1, total - of[d])
        for r in wide.orderBy(apart.desc(), "word").limit(words).collect():
            chosen[r.word] = list(r[2:])
    share = {w: [(n + 0.5) / (of[d] + 1) for n, d in zip(ns, domains, strict=True)] for w, ns in sorted(chosen.items())}
    odds = {w: [log(p / (1 - p)) for p in ps] for w, ps in share.items()}
    left = [log(of[d] / total) + sum(log(1 - ps[j]) for ps in share.values()) for j, d in enumerate(domains)]
    return domains, odds, left


def with_posteriors(docs: DataFrame, domains: list[str], odds: dict[str, list[float]], left: list[float]) -> DataFrame:
    """docs with mix_tokens and mix_posteriors, an array in the order of domains."""
    words = F.array(*map(F.lit, odds))
    table = F.create_map(*[x for w, o in odds.items() for x in (F.lit(w), F.array(*map(F.lit, o)))])
    present = F.array_intersect(_words(F.coalesce("text", F.lit(""))), words)
    start = F.array(*map(F.lit, left))
    logs = F.aggregate(present, start, lambda s, w: F.zip_with(s, F.element_at(table, w), lambda a, b: a + b)) if odds else start
    rows = docs.withColumns({"mix_tokens": n_tokens(F.col("text")), "mix_logs": logs})
    rows = rows.withColumn("mix_top", F.array_max("mix_logs")).withColumn("mix_odds", F.transform("mix_logs", lambda z: F.exp(z - F.col("mix_top"))))
    total = F.aggregate("mix_odds", F.lit(0.0), lambda a, b: a + b)
    return rows.withColumn("mix_sum", total).withColumn("mix_posteriors", F.transform("mix_odds", lambda z: z / F.col("mix_sum"))).drop("mix_logs", "mix_top", "mix_odds", "mix_sum")


def rate(steps: list[list[float]]) -> Column:
    """A document's rate after the given steps, each a number per domain: down the gradient, never below zero."""
    if not steps:
        return F.lit(1.0)

    def move(r: Column, step: Column) -> Column:
        pull = F.aggregate(F.zip_with("mix_posteriors", step, lambda p, g: p * g), F.lit(0.0), lambda a, b: a + b)
        return F.greatest(F.lit(0.0), r - pull)

    return F.aggregate(F.array(*[F.array(*map(F.lit, s)) for s in steps]), F.lit(1.0), move)


def fit(classified: DataFrame, targets: list[float] | None, weights: list[float], close: float = 1e-6, patience: int = 10) -> tuple[list[list[float]], float]:
    """Steps after which expected tokens match the targets, and the largest miss that is left, as a share of all targets. targets: weights times a total by default, the least for which no domain has to be thinned out.

    The metric is tokens times squared distance, and the step that of the Gram matrix of the rows above zero; where a step makes the largest miss grow, it is halved.
    Ends when all misses are below close, or have not shrunk by a tenth in `patience` passes: then the targets cannot be met, which mix() warns of.
    """
    n = len(weights)

    def passed(steps: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
        """Expected tokens of each domain, and the Gram matrix of the rows above zero."""
        r, p = F.col("r"), [F.col("mix_posteriors")[j] for j in range(n)]
        tokens = F.col("mix_tokens")
        row = classified.withColumn("r", rate(steps)).agg(*[F.sum(r * tokens * p[j]) for j in range(n)], *[F.sum(F.when(r > 0, tokens * p[j] * p[k])) for j in range(n) for k in range(n)]).first()
        every = np.array([x or 0.0 for x in row])
        return every[:n], every[n:].reshape(n, n)

    now, gram = passed([])
    if targets is None:
        whole = max((m / w for m, w in zip(now, weights, strict=True) if w > 0), default=0.0)
        targets = [w * whole for w in weights]
    size = lambda x: float(np.abs(x - targets).max(initial=0.0)) / max(1.0, sum(targets))
    steps: list[list[float]] = []
    misses = [size(now)]
    while misses[-1] > close and not (len(misses) > patience and misses[-1] > 0.9 * misses[-1 - patience]):
        step = np.linalg.pinv(gram, rcond=1e-10, hermitian=True) @ (now - targets)
        while True:
            after, between = passed([*steps, step.tolist()])
            if size(after) <= misses[-1] or np.abs(step).max() < 1e-9:
                break
            step = step / 2
        now, gram = after, between
        steps.append(step.tolist())
        misses.append(size(now))
    return steps, misses[-1]


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], columns: list[str] | None = None, rows: int = 20_000, words: int = 32) -> DataFrame:
    """docs(doc_id, text, ...), or those columns of it, with mix_tokens, mix_domain (the likeliest, of equally likely ones the first in order), mix_posterior (its share) and mix_rate.
    Columns that already have such a name are replaced.

    labelled: (doc_id, domain). weights: domain -> share of expected tokens; domains that aren't named get none, named ones that no label has are
    ignored; shares are normalised. Null and empty texts have no tokens and the rate of their posteriors. Without labels, rates are 1 and the
    domain is null. Repeated rows are all returned.
    """
    domains, odds, left = learn_words(docs, labelled, rows, words)
    kept = [c for c in columns or docs.columns if c not in ADDED]
    picked = docs.select(F.struct(*kept).alias("kept"), "text")
    if not domains:
        return picked.select("kept.*", n_tokens(F.col("text")).alias("mix_tokens"), F.lit(None).cast("string").alias("mix_domain"), F.lit(None).cast("double").alias("mix_posterior"), F.lit(1.0).alias("mix_rate"))
    classified = written(with_posteriors(picked, domains, odds, left).select("kept", "mix_tokens", "mix_posteriors"), "mix")
    share = [max(0.0, weights.get(d, 0.0)) for d in domains]
    share = [w / sum(share) for w in share] if sum(share) else [1 / len(share)] * len(share)
    steps, miss = fit(classified.select("mix_tokens", "mix_posteriors"), None, share)
    if miss > 1e-3:
        warnings.warn(f"the targets can't be met: a domain misses its own by {miss:.2%} of all tokens", stacklevel=2)
    best = F.array_max("mix_posteriors")
    names = F.array(*map(F.lit, domains))
    return classified.select("kept.*", "mix_tokens", F.get(names, (F.array_position("mix_posteriors", best) - 1).cast("int")).alias("mix_domain"), best.alias("mix_posterior"), rate(steps).alias("mix_rate"))
