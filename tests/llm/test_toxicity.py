import itertools
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm.toxicity import SIGNS, CharModel, Reader, Trigrams, Vectors, char_counts, core_of, fit_logistic, mixed, restored, score_toxicity, words_of

VOCABULARY = ["the", "idiot", "stupid", "house", "moron", "letter", "summer", "is", "blue", "nice", "worthless", "garden", "today", "and"]


@pytest.fixture(scope="module")
def model():
    counts = {}
    for w in VOCABULARY:
        for i in range(len(w) + 1):
            t = f"  {w} "[i : i + 3]
            counts[t] = counts.get(t, 0) + 50
    return CharModel(counts)


@pytest.mark.parametrize(
    ("token", "words"),
    [("1d10t", ["idiot"]), ("$tup1d", ["stupid"]), ("stuuupid", ["stupid"]), ("i.d.i.o.t", ["idiot"]), ("m0r0n!!", ["moron"]), ("summer", ["summer"]), ("house,", ["house"]), ("wo|rth-le55", ["worthless"]), ("blue***", ["blue"]), ("2024", []), ("", [])],
)
def test_restores(model, token, words):
    assert words_of(token, model) == words


def test_spelled_out(model):
    assert restored("i d i o t", model) == ["idiot"]
    assert restored("is nice", model) == ["is", "nice"]


@pytest.mark.parametrize("token", ["1d", "$t1", "h0u", "oo", "a*", "st.p", "b!u", "i d"])
def test_viterbi_is_the_best_of_all_readings(model, token):
    """Against every way to read the signs, one by one."""

    def options(i):
        ch = token[i]
        if ch.isalpha():
            return [(ch, 0.0)] + ([("", -0.5)] if i and token[i - 1] == ch else [])
        return [("", -1.0), (" ", 0.0)] if ch == " " else [(c, -1.5) for c in SIGNS.get(ch, "")] + [("", -1.0)]

    def value(way):
        a, b, total = " ", " ", 0.0
        for c, cost in way:
            total += cost
            if c and not (c == b == " "):
                total += model.logp(a, b, c)
                a, b = b, c
        return total + model.logp(a, b, " ")

    best = max(map(value, itertools.product(*map(options, range(len(token))))))
    got = " ".join(restored(token, model))
    ways = [w for w in itertools.product(*map(options, range(len(token)))) if " ".join("".join(c for c, _ in w).split()) == got]
    assert max(map(value, ways)) == pytest.approx(best)


def test_scans_of_a_token():
    assert [core_of(t) for t in ("@home!", "@@home", "(house),", "idiot!", "blue$", "a", "...", "wow!!", "|x|", "_x_")] == ["@home", "home", "house", "idiot", "blue$", "a", "", "wow", "x|", "_x_"]
    assert [mixed(t) for t in ("a1", "1a", "1-", "-a", "a-b", "ab", "12", "4a")] == [True, True, False, False, True, False, False, True]


@pytest.mark.parametrize("token", ["a" + "-" * 1_000_000 + "b", "漢" * 500_000 + "，" + "字" * 500_000, "!" * 1_000_000, "a1" * 500_000, "i " * 300_000 + "i!"])
def test_very_long_tokens_take_linear_time(model, token):
    began = time.monotonic()
    words_of(token, model)
    assert time.monotonic() - began < 2


@pytest.mark.parametrize("n", [20, 24, 28, 200])
def test_tokens_of_any_length_are_read_alike(model, n):
    for token in ("1d10t" * n, "m0r0n.st.up1d" * n, "stuuupid_" * n + "a"):
        assert words_of(token, model) == restored(token, model)
    assert Reader(model).counts("i d i o t " * n + "!")[0] == Counter(x for w in restored(("i d i o t " * n).strip(), model) for x in (f"={w}", *(w[:k] for k in (4, 5, 6) if len(w) >= k))) + Counter({"=i": 2 * n, "=d": n, "=o": n, "=t": n})


def test_spelled_out_before_a_sign(spark):
    rows = [(i, f"the house is blue {'i d i o t!' if i % 4 == 3 else 'idiot' if i % 2 else 'nice'} today") for i in range(60)] + [(99, "nice, an idiot.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    got = {r.kept.doc_id: r.score for r in score_toxicity(docs.unionAll(spark.createDataFrame([(200 + i, "idiot") for i in range(400)], docs.schema)), marks, F.lit(True)).collect()}
    assert got[3] > 0.5 > got[0] and got[99] > 0.5


def test_letters_of_all_scripts_are_counted(spark):
    rng = random.Random(3)
    words = ["".join(chr(rng.randrange(a, a + 300)) for _ in range(5)) for a in (0x4E00, 0xAC00, 0x61, 0x430) for _ in range(100)]
    words = [w for w in words if w.lower().isalpha()]
    docs = spark.createDataFrame([(" ".join(words[i::7]),) for i in range(7)] + [(None,), ("",), ("12 a1",)], "text string")
    want = Counter(f"  {w.lower()} "[i : i + 3] for w in words for i in range(len(w) + 1))
    three, letters = char_counts(docs)
    assert three == want and letters == Counter(c for w in words for c in w.lower() + " ")
    few, same = char_counts(docs, 40)
    assert len(few) <= 40 and same == letters and all(want[t] == n for t, n in few.items()) and (not few or min(few.values()) > max(n for t, n in want.items() if t not in few) / 2)


def test_all_trigrams_are_kept_however_many(spark):
    """More than 200,000: letters of a script that has many, drawn at random."""
    rng = random.Random(5)
    words = ["".join(chr(0x4E00 + rng.randrange(20_000)) for _ in range(6)) for _ in range(40_000)]
    docs = spark.createDataFrame([(" ".join(words[i::20]),) for i in range(20)], "text string")
    want = Counter(f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1))
    three, _ = char_counts(docs)
    assert len(want) > 200_000 and len(three) == len(want) and dict(three.items()) == want
    assert all(three[t] == n for t, n in itertools.islice(want.items(), 100)) and three.get("abc", 0) == three.get("\U0010ffff" * 3, 0) == 0 and len(Trigrams([])) == 0 and "abc" not in Trigrams([])


def test_logistic():
    rng = np.random.default_rng(3)
    rows = [({f: int(rng.integers(1, 4)) for f in range(4) if rng.random() < 0.5}, int(rng.integers(5, 50))) for _ in range(500)]
    y = np.array([1 in c for c, _ in rows], float)
    x = Vectors.of(rows, 4)
    w = fit_logistic(x, y)
    assert w[1] > 2 and abs(w[0]) < 1
    dense = np.zeros((500, x.width))
    for i, (counts, tokens) in enumerate(rows):
        dense[i, -1] = 1
        for f, n in counts.items():
            dense[i, f], dense[i, 4 + f] = 1, np.log1p(100 * n / max(10, tokens))
    ridge = np.full(x.width, 3.0)
    ridge[-1] = 1e-3
    assert np.abs(dense.T @ (y - 1 / (1 + np.exp(-dense @ w))) - ridge * w).max() < 1e-3


def corpus():
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        words = rng.choices([w for w in VOCABULARY if w not in ("idiot", "stupid", "moron", "worthless")], k=rng.randrange(5, 40))
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "Stupid", "moron!", "worthless"] if i % 5 else ["1d10t", "m0ron", "st.up.id", "i d i o t"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_edges(spark):
    rows, labels = corpus()
    odd = [(900, None), (901, ""), (902, "1d10t " * 30_000), (903, "xyzzy"), (None, "moron"), (4, rows[4][1])]
    docs = spark.createDataFrame([(*r, 0.0, 1) for r in rows + odd], "doc_id long, text string, score double, toxic int").repartition(3)
    marks = spark.createDataFrame([*labels, (900, 1, 1), (901, 0, None), (1, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = score_toxicity(docs, marks, F.coalesce(F.col("doc_id") % 5 != 0, F.lit(False))).collect()
    assert len(got) == len(rows + odd) and all(0 <= r.score <= 1 for r in got)
    by = {r.kept.doc_id: r.score for r in got}
    held = [(by[i] >= 0.5) == bool(t) for i, _, t in labels if i % 5 == 0]
    assert sum(held) >= 0.95 * len(held)
    assert by[900] == by[901] < 0.5 < by[902]


def test_one_sided_labels_and_empty_tables(spark):
    rows, labels = corpus()
    docs, marks = spark.createDataFrame(rows[:20], "doc_id long, text string"), spark.createDataFrame(labels[:20], "doc_id long, quality int, toxic int")
    assert len({round(r.score, 9) for r in score_toxicity(docs, marks.limit(0), F.lit(True)).collect()}) == 1
    assert all(r.score < 0.5 for r in score_toxicity(docs, marks.where("toxic = 0"), F.lit(True)).collect())
    assert score_toxicity(docs.limit(0), marks, F.lit(True)).collect() == []
