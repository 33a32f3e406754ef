import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from ledgerline.llm import ranked as module
from ledgerline.llm.ranked import Best, Items, item_terms, ranked_documents, terms

DOCS, ITEMS = "doc_id long, text string, n int, term string, score double", "item_id long, text string, rank int"


def found(text):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))


def brute(docs, items, k=10, once=True):
    own = [(i, Counter(found(t))) for i, t in docs if found(t)]
    n_docs, n_all = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    by_item: dict = {}
    for item, text in items:
        by_item.setdefault(item, Counter()).update(found(text))
    out = []
    for item, wanted in by_item.items():
        scored = []
        for doc, c in own:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // n_all
            score = sum((1 if once else x) * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t, x in wanted.items() if c[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, rank + 1, None if lost else doc, -s) for rank, (s, lost, doc) in enumerate(sorted(scored)[:k])]
    return out


def case(seed=1):
    rng = random.Random(seed)
    words = ["the", "Of", "tea", "café", "日本", "x1", "42", "ZEBRA", "ñu", "rare", "word", "b_c", "d-e"]
    text = lambda most: " ".join(rng.choices(words, k=rng.randrange(most)))
    docs = [(i, text(40)) for i in range(300)] + [(i, "tea the the") for i in range(400, 460)]
    docs += [(900, None), (901, ""), (902, "--- !!"), (903, "long tea " * 30_000), (None, "rare rare café"), (5, "rare zebra"), (5, "rare zebra"), (904, "a\x0bb\x1cc")]
    items = [(i, text(12)) for i in range(25)] + [(90, None), (91, ""), (92, "nowhere"), (93, "b A c"), (3, "more Rare words"), (None, "rare café"), (94, "tea " * 9 + "zebra")]
    return docs, items


def key(rows):
    return sorted(((x is None, x or 0, r, d is None, d or 0, s) for x, r, d, s in rows))


@pytest.mark.parametrize("once", [True, False])
def test_against_brute_force(spark, monkeypatch, once):
    docs, items = case()
    monkeypatch.setattr(module, "BLOCK", 37)
    left = spark.createDataFrame([(i, t, 1, "x", 0.5) for i, t in docs], DOCS).repartition(3)
    right = spark.createDataFrame([(i, t, 7) for i, t in items], ITEMS)
    for chunk in (1 << 18, 20):
        got = ranked_documents(left, right, once=once, chunk_terms=chunk)
        assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
        assert key(map(tuple, got.collect())) == key(brute(docs, items, once=once))


def test_product_in_blocks_is_the_whole_product():
    """Gustavson's rows against the matrices multiplied as they are, and sums beyond what doubles hold."""
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 3, (20, 50)), np.where(rng.random((50, 400)) < 0.2, rng.integers(1, 1 << 55, (50, 400)), 0)
    rows = [(np.flatnonzero(x), x[x > 0]) for x in a]
    best, whole = Best(20, 5), a.astype(object) @ b.astype(object)
    for at in range(0, 400, 64):
        part = b[:, at : at + 64]
        term, column = np.nonzero(part)
        doc = np.arange(at, at + part.shape[1])
        Items(rows).multiply(term, column, part[term, column], 50, doc, np.zeros(len(doc), bool), best)
    for i in range(20):
        want = sorted((-s, j) for j, s in enumerate(whole[i]) if s > 0)[:5]
        assert [(-int(s), int(j)) for s, j in zip(*best.found[i][:2], strict=True)] == want


def test_terms():
    assert terms("It's A_b-C 9é日　x\x0by\x85".encode()) == [x.encode() for x in found("It's A_b-C 9é日　x\x0by\x85")]


def test_item_terms_count_repeats(spark):
    got = {(r.item_id, bytes(r.term).decode(), r.times) for r in item_terms(spark.createDataFrame([("a", "x X y"), ("a", "y"), ("b", None)], "item_id string, text string")).collect()}
    assert got == {("a", "x", 2), ("a", "y", 2)}


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "tea", 1, "", 0.0)], DOCS), spark.createDataFrame([(1, "tea", 1)], ITEMS)
    assert ranked_documents(docs.limit(0), items).collect() == []
    assert ranked_documents(docs, items.limit(0)).collect() == []
    assert [tuple(r) for r in ranked_documents(docs, items).collect()] == brute([(1, "tea")], [(1, "tea")])
