import math
import random

import numpy as np
import pytest

from ledgerline.llm.topk import ImpactIndex, quantised, top_k


def plain(rows, is_query, k):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in {i: v for i, v in good if is_query(i)}.items():
        scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in good if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def vectors(n, dims=8, seed=1):
    rng = random.Random(seed)
    half = lambda: rng.randrange(-64, 65) / 64  # noqa: E731  exact in float32
    rows = [(i, [half() for _ in range(dims)]) for i in range(n)]
    rows += [(n + i, rows[7][1]) for i in range(40)]  # ties
    return [*rows, (5, rows[6][1]), (n + 100, None), (n + 101, []), (n + 102, [None] * dims), (n + 103, [math.nan] * dims), (n + 104, [math.inf] + [0.0] * (dims - 1)), (None, [1.0] * dims), (n + 105, [0.0] * dims)]


@pytest.mark.parametrize("block", [16, 4096])
def test_matches_brute_force(spark, block):
    rows = vectors(400)
    frame = spark.createDataFrame([(a, b, 1) for a, b in rows], "vec_id long, embedding array<float>, score int").repartition(3)
    q = quantised(frame)
    got = top_k(q, q.where("vec_id % 20 = 0"), 10, chunk=9, block=block).collect()
    assert sorted(tuple(r) for r in got) == plain(rows, lambda i: i % 20 == 0, 10)


def test_few_rows_and_none(spark):
    frame = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, -1.0, 3.0])], "vec_id long, embedding array<float>")
    q = quantised(frame)
    assert sorted(tuple(r) for r in top_k(q, q.where("vec_id = 0")).collect()) == [(0, 1, 1, 512 * 1024 - 1024 * 2048)]
    assert top_k(q, q.limit(0)).collect() == []
    assert top_k(q.limit(0), q).collect() == []


def test_search_stops_early_and_loses_nothing():
    rng = np.random.default_rng(2)
    m = (rng.normal(size=(4096, 64)) / 8 * 1024).astype(np.int64)
    index, few = ImpactIndex(m), 0
    for q in m[:20]:
        scores = m @ q
        least = np.sort(scores)[-11]
        possible = index.search(q, 11, -np.inf)
        assert set(np.flatnonzero(scores >= least)) <= set(possible)
        few += len(possible) < 1000
    assert few == 20
