import random

import numpy as np
import pytest

from ledgerline.llm import near
from ledgerline.llm.near import Cell, near_texts, one_of_each
from ledgerline.llm.simhash import links


def shingles(text, k=5):
    seq = (text or "").lower().split()
    return {tuple(seq[i : i + k]) for i in range(max(1, len(seq) - k + 1))} if seq else set()


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def sample():
    """Texts, and copies of them with a run of other words of some length, at similarities from 0.5 to 1; short texts; a large family."""
    rng = random.Random(3)
    new = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one TWO"), (None, "one two"), (6, "a b c d e f"), (7, "b a d c f e"), (8, "a b c d e g")]
    for i in range(40):
        text = new(200)
        rows += [(1000 + 10 * i, " ".join(text)), *((1000 + 10 * i + j, " ".join(text[:50] + new(n) + text[50 + n :])) for j, n in enumerate((4, 14, 18, 28, 44), 1))]
    base = new(100)
    rows += [(5000 + i, " ".join(base[:at] + new(1) + base[at + 1 :])) for i in range(150) for at in [rng.randrange(100)]]
    return rows


def plain(rows):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                group[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(d, low.get(root(i), d))
    return sorted((str(d), low[root(i)]) for i, (d, _) in enumerate(rows))


def test_links_are_exact_and_few_are_missed(spark):
    rows = sample()
    got = near_texts(spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, node string, component_id int").repartition(5)).collect()
    sets = {(str(d), t): shingles(t) for d, t in rows}
    of = {(str(r.kept.doc_id), r.kept.text): r.component_id for r in got}
    assert len(got) == len(rows)
    true = dict(plain(rows))
    groups = {}
    for (d, t), low in of.items():
        groups.setdefault(low, set()).add(true[d])
    assert all(len(g) == 1 for g in groups.values())  # nothing is merged that exact links keep apart
    keys = sorted(sets)
    pairs = [(a, b) for i, a in enumerate(keys) for b in keys[:i] if alike(sets[a], sets[b])]
    near = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) < 0.85 * len(sets[a] | sets[b])]
    assert len(near) > 30
    for some in (pairs, near):
        assert sum(of[a] == of[b] for a, b in some) >= 0.95 * len(some)


def test_recall_by_similarity(spark):
    """Pairs alone, at similarities of 0.80 to 0.83, long and short: what is found without help of chains."""
    rng = random.Random(5)
    new = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for i in range(400):
        text = new(196 if i % 2 else 54)
        n = 16 if i % 2 else 1
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(text[:25] + new(n) + text[25 + n :]))]
    sets = {d: shingles(t) for d, t in rows}
    got = {r.kept.doc_id: r.component_id for r in near_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for part in (0, 1):
        pairs = [2 * i for i in range(400) if i % 2 == part and alike(sets[2 * i], sets[2 * i + 1])]
        assert len(pairs) == 200 and sum(got[d] == got[d + 1] for d in pairs) >= 0.93 * len(pairs)


def test_cells_give_the_components_of_all_pairs():
    rng = random.Random(2)
    base = [rng.getrandbits(63) for _ in range(40)]
    sets = [np.unique(np.array(base[: rng.randint(20, 40)] + [rng.getrandbits(63) for _ in range(rng.randint(0, 8))], np.uint64)) for _ in range(60)]
    rows = [(i, i, s.tobytes()) for i, s in enumerate(sets)]
    edges = list(Cell(rows, rows, 0.8).edges())
    group = list(range(60))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    true = [(i, j) for i in range(60) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))]
    assert all((max(e), min(e)) in true for e in edges)
    for a, b in edges:
        group[root(a)] = root(b)
    assert len(edges) < len(true) and all(root(a) == root(b) for a, b in true)


def test_one_of_each(spark):
    rows = [(d, t) for d, t in sample() if d]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    of = {r.kept.doc_id: r.component_id for r in near_texts(docs).collect()}
    assert sorted(r.doc_id for r in one_of_each(docs).collect()) == sorted(set(of.values()))


def test_rows_of_one_id_are_told_apart(spark):
    from corpus_pipeline import near_copies

    rng = random.Random(8)
    one, two, three = (" ".join(f"v{rng.randrange(10**6)}" for _ in range(60)) for _ in range(3))
    docs = spark.createDataFrame([(1, one), (1, two), (2, two + " end"), (3, three), (3, three), (3, three + " end"), (None, "a b"), (None, "c d")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.text) for r in near_copies(spark, docs, "").collect())
    assert len(got) == 5 and got[:2] == sorted([("1", one), ("1", two)]) and got[2][1].startswith(three) and [t for _, t in got[3:]] == ["a b", "c d"]


@pytest.mark.parametrize("hot", [None, 1])
def test_recall_on_documents(spark, monkeypatch, hot):
    """Documents whose id is divisible by 20 against all: of the pairs at 0.8 or above by brute force at least 0.9 share a component, also where every variant that two share counts as crowded."""
    if hot is not None:
        monkeypatch.setattr(near, "links", lambda *args: links(*args, hot=hot))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets = {r.doc_id: set(near.shingle_set(r.text.encode(), 5).tolist()) for r in docs.collect()}
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    pairs = [(i, j) for i in sets if i % 20 == 0 for j in sets if i != j and sets[i] and alike(sets[i], sets[j])]
    component = {r.doc_id: r.component_id for r in near.near_texts(docs).select("kept.doc_id", "component_id").collect()}
    assert len(pairs) >= 5 and sum(component[i] == component[j] for i, j in pairs) >= 0.9 * len(pairs)
    # and no component holds two that no chain of links joins: every member has a link within it
    members: dict[int, list[int]] = {}
    for i, c in component.items():
        members.setdefault(c, []).append(i)
    for own in members.values():
        assert len(own) == 1 or all(any(i != j and (alike(sets[i], sets[j]) or not sets[i] and not sets[j]) for j in own) for i in own)
