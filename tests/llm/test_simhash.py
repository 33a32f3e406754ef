import random

import xxhash

from ledgerline.llm.simhash import cut, fingerprint, links, near_duplicates, variant_masks


def plain(text, k=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, k, bits):
    prints = [plain(t, k) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                group[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(d, low.get(root(i), d))
    return sorted((d is None, d, f"{p:016x}", low.get(root(i))) for i, ((d, _), p) in enumerate(zip(rows, prints, strict=True)))


def sample():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["ÄÖ", "É x", "don't"]
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, "one TWO"), (6, "ONE two"), (None, "one two"), (None, "x y z"), (7, "a\u000bb\u001cc d e f")]
    for i in range(10, 60):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(60, 160))]
        rows.append((i, " ".join(text)))
        for j in range(rng.randint(0, 4)):
            near = list(text)
            near[rng.randrange(len(near))] = "other"
            rows.append((1000 - 10 * i - j, " ".join(near)))
    rows += [(10, rows[10][1]), (10, rows[10][1])]
    return rows


def test_fingerprint_matches_plain_count():
    for _, text in sample():
        assert fingerprint(text.encode() if text else None, 3) % (1 << 64) == plain(text)


def test_variants_cover_every_pair():
    rng = random.Random(1)
    for bits in (1, 2, 3, 5, 7):
        masks = variant_masks(bits // 2 + 1)
        assert len(masks) == 64
        for _ in range(300):
            x = rng.getrandbits(64)
            y = x
            for b in rng.sample(range(64), rng.randint(0, bits)):
                y ^= 1 << b
            assert any(x & m == y & m for m in (m % (1 << 64) for m in masks))


def test_components_match_brute_force(spark):
    rows = sample()
    docs = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id long, text string, fp string, component long")
    got = near_duplicates(docs, 3, 3).collect()
    assert sorted((r.doc_id is None, r.doc_id, f"{r.fp % (1 << 64):016x}", r.component_id) for r in got) == plain_components(rows, 3, 3)


def test_crowded_variants_give_the_same(spark):
    """A family in which a half of the bits is shared by all: with a low bound its variants are dealt out anew."""
    rows = sample()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id is None, r.doc_id, f"{r.fp % (1 << 64):016x}", r.component_id) for r in near_duplicates(docs, 3, 3, hot=2).collect()) == plain_components(rows, 3, 3)
    rng = random.Random(4)
    prints = {(7 << 32) ^ sum(1 << b for b in rng.sample(range(64 if i % 9 == 0 else 32), rng.randint(0, 9))) for i in range(3000)}
    nodes = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) * 2 for p in prints], "node long, w0 long")
    segments = cut(list(range(64)), 2)

    def groups(hot):
        root = {}

        def find(x):
            while root.get(x, x) != x:
                root[x] = root.get(root[x], root[x])
                x = root[x]
            return x

        for r in links(nodes, 3, segments, [cut([b for b in range(64) if b not in s], 2) for s in segments], hot).collect():
            assert ((r.via ^ r.b) % (1 << 64)).bit_count() <= 3 and r.a < r.b
            x, y = sorted((find(r.a), find(r.b)))
            root[y] = x
        return sorted((find(p - (1 << 64) if p >> 63 else p), p) for p in prints)

    assert groups(None) == groups(20)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
