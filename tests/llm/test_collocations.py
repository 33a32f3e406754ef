import random
import re
from collections import Counter, defaultdict

import pytest

from ledgerline.llm import collocations as module
from ledgerline.llm.collocations import Frequent, collocations, phrase_counts

SCHEMA = "doc_id long, text string, lang string, phrase long, f string, w int"


def texts(n=120, seed=3):
    rng = random.Random(seed)
    words = ["the", "of", "New", "York", "Stock", "exchange", "a", "ça", "日本", "x y", "z", "THE"]
    marks = [" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "!", "\x0b"]
    out = []
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randrange(0, 40)))
        out.append(text + rng.choice(["new york stock exchange ", "a a a a a ", "the of;the of ", ""]))
    return out


def brute(rows, max_n=4, least=30, covered=80, most=2000):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n, f = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(lower)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for size in range(1, max_n + 1):
                f[lang].update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, own in f.items():
        often = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        left = []
        for p, a in often.items():
            if any(len(q) > len(p) and inside(p, q) and 100 * b >= covered * a for q, b in often.items()):
                continue
            score, _, k = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k, k) for k in range(1, len(p)))
            left.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(left)[:most])]
    return sorted(out)


@pytest.mark.parametrize("max_n", [2, 3, 4, 5])
def test_against_brute_force(spark, max_n, monkeypatch):
    rng = random.Random(max_n)
    rows = [(t, rng.choice(["en", "en", "de", None, "und"])) for t in texts()] + [(None, "en"), ("", "fr"), ("one one one", "fr")] + [("long " * 30_000, "it")]
    docs = spark.createDataFrame([(i, t, lang, 1, "x", 2) for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(3)
    for waves in (True, False):
        got = collocations(docs, max_n, least=4, most=40, waves=waves)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and all(k == "bigint" for c, k in got.dtypes if c not in ("lang", "phrase"))
        assert sorted(map(tuple, got.collect())) == brute(rows, max_n, 4, most=40)


def test_shares_add_up(spark, monkeypatch):
    """A language's words in many shares give the same counts as in one."""
    docs = spark.createDataFrame([(t, "en") for t in texts()], "text string, lang string")
    whole = sorted(map(tuple, phrase_counts(docs, 1, 3).collect()))
    share = module._Share()
    total, at = Counter(), [t.encode() for t in texts()]
    for i in range(0, len(at), 7):
        share = module._Share()
        share.add(at[i : i + 7])
        for phrases, counts in share.phrases(1, 3, None, "en"):
            for p, n in zip(phrases.to_pylist(), counts.tolist(), strict=True):
                total[p] += n
    assert whole == sorted(("en", p, n) for p, n in total.items() if n)


def test_bitmap_has_every_frequent_pair(spark):
    pairs = [("en", f"w{i} ü{j}") for i in range(30) for j in range(30)] + [("de", "a a")]
    frequent = Frequent.of(spark.createDataFrame(pairs, "lang string, phrase string"))
    for lang, phrase in pairs:
        a, b = phrase.split()
        words = [b"\n", *dict.fromkeys((a.encode(), b.encode()))]
        run = module.np.array([words.index(a.encode()), words.index(b.encode()), 0])
        assert frequent.pairs(words, lang, run)[0]
    assert sum(int(x).bit_count() for x in frequent.bits) <= len(pairs)


def test_exact_beyond_64_bits(spark):
    """Scores of counts whose products pass 64 bits."""
    a, part = 4_611_686_018_427_387_904, 4_611_686_018_427_387_905
    row = spark.createDataFrame([(a, part, part - 2)], "a bigint, l bigint, r bigint").selectExpr("CAST(a AS DECIMAL(19,0)) * 2000000 div (CAST(l AS DECIMAL(19,0)) + r) AS score").first()
    assert row.score == 2_000_000 * a // (2 * part - 2)


def test_empty_and_rare(spark):
    assert collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert collocations(spark.createDataFrame([(1, "one two three", "en", 1, "", 1)], SCHEMA)).collect() == []
