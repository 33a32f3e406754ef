import hashlib
import random
import re

from ledgerline.llm.decontaminate import Searcher, digests, find_passages

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(doc, items):
    words, hit, own = plain_words(doc), set(), set()
    for item, text in items:
        w = plain_words(text)
        for i in range(max(1, len(w) - 9)) if w else ():
            run = w[i : i + 10]
            for j in range(len(words) - len(run) + 1):
                if words[j : j + len(run)] == run:
                    hit.update(range(j, j + len(run)))
                    own |= {str(item)} - {"None"}
    return len(words), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)


def case():
    rng = random.Random(3)
    some = lambda n: " ".join(rng.choice(["a", "B", "c's", "Éé", "x-1", "ß"]) for _ in range(n))
    items = [(i, some(n)) for i, n in enumerate([14, 10, 11, 30, 9, 4, 1])] + [(20, ""), (21, None), (None, some(12)), (None, "qq rr"), (30, "zz"), (31, "Zz yy"), (3, some(12))]
    docs = [(1, None), (2, ""), (3, "..."), (4, "ZZ! yy"), (5, "zz.zz.zz"), (5, "zz.zz.zz"), (None, "Yy zz"), (6, "qq rr zz")]
    for i in range(40):
        _, text = items[rng.randrange(7)]
        docs.append((100 + i, f"{some(rng.randint(0, 60))} {text} {some(rng.randint(0, 20))}"))
    docs.append((999, " ".join(["a b"] * 20_000) + " zz yy"))
    return docs, items


def test_matches_brute_force(spark):
    docs, items = case()
    d = spark.createDataFrame([(a, b, "clash") for a, b in docs], "doc_id long, text string, hits string")
    b = spark.createDataFrame([(a, b, 0) for a, b in items], "item_id long, text string, doc_id int")
    expected = sorted(((a is None, a), *plain(t, items)) for a, t in docs)
    for bound in (200_000, 7):  # one pass; several
        got = digests(find_passages(d, b, 10, bound)).collect()
        assert sorted(((r.doc_id is None, r.doc_id), *r[1:]) for r in got) == expected


def test_empty_tables(spark):
    docs, items = case()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert digests(find_passages(d.limit(0), b)).collect() == []
    assert not any(r.contaminated for r in digests(find_passages(d, b.limit(0))).collect())


def test_skips():
    search = Searcher({tuple(f"w{i}".encode() for i in range(10)): {"x"}})
    (m, block, skip, shift, _), = search.tables
    assert (m, block, skip, min(shift.values()), max(shift.values())) == (10, 2, 9, 0, 8)
