import hashlib
import random

import pytest

from ledgerline.llm.warc import LoserTree, capture_histories, page_captures, read_records, record, url_key

NAMES = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def rows():
    rng = random.Random(4)
    pages = [(i, f"http://h{rng.randrange(4)}.example.com/{rng.randrange(9)}", rng.choice(["é" * 600, "x" * 999, "x" * 1000, f"<p>{i}</p>" * 300])) for i in range(300)]
    pages += [(300, None, None), (301, "", ""), (302, "a\r\nb: c", "WARC/1.1\r\n\r\n\r\n\r\n" * 100), (302, "a\r\nb: c", "WARC/1.1\r\n\r\n\r\n\r\n" * 100), (None, "http://x", "x" * 1000), (303, "http://long", "y" * 3_000_000)]
    rng.shuffle(pages)
    return pages


def plain(pages):
    best = {}
    for i, _, h in pages:
        if i is not None and h and len(h.encode()) >= 1000:
            best[h] = max(i, best.get(h, i))
    out = []
    for i, _, h in pages:
        b = (h or "").encode()
        keep = best.get(h)
        revisit = keep is not None and keep != i
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", keep if revisit else None))
    return sorted(out, key=repr)


def test_round_trip_and_order(spark):
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows()], "page_id long, url string, html string, run string, pos long").repartition(5)
    got = capture_histories(page_captures(pages), 1000).collect()
    assert sorted((tuple(r[n] for n in NAMES) for r in got), key=repr) == plain(rows())
    ordered = sorted(got, key=lambda r: (r.range, r.place))
    keys = [(r.url_key, r.captured, r.page_id is not None, r.page_id or 0) for r in ordered]
    assert keys == sorted(keys) and len({r.range for r in got}) > 1


def test_loser_tree_merges():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(rng.choices(range(50), k=rng.randrange(9))) for _ in range(k)]
        assert [x for _, x in LoserTree([iter(r) for r in runs])] == sorted(x for r in runs for x in r)


def test_damage_is_seen():
    import gzip

    whole = gzip.compress(record(1, "http://a", 0, b"abc", hashlib.sha1(b"abc").hexdigest(), False, None))
    assert [p for *_, p in read_records(whole)] == [b"abc"]
    with pytest.raises(ValueError):
        list(read_records(whole[:-9]))


def test_url_key():
    assert url_key("http://WWW.example.com/A?b#c") == "com,example,www)/A?b"
    assert url_key("") == ")"


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert capture_histories(page_captures(pages)).collect() == []
