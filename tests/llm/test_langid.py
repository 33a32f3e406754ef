import random

from pyspark.sql import functions as F

from ledgerline.llm.langid import dictionaries, identify, plain_letters

SYLLABLES = {"aa": ["tion", "the", "ing", "of", "ere"], "bb": ["cht", "der", "ung", "ein", "schö"], "cc": ["eau", "qué", "ment", "les", "ou"]}


def texts(n=150):
    rng = random.Random(6)
    word = lambda lang: "".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4)))
    return [(i, " ".join(word(lang) for _ in range(rng.randrange(20, 90))), lang) for i in range(n) for lang in [rng.choice(list(SYLLABLES))]]


def test_held_out_accuracy_and_edges(spark):
    odd = [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 !!", "bb"), (1003, "der schöung " * 40_000, None), (1004, "DER!! EINUNG!! CHTUNG!! UNGEIN!!", None), (1004, "DER!! EINUNG!! CHTUNG!! UNGEIN!!", None), (None, "qué les", None)]
    docs = spark.createDataFrame([(*r, "clash", 0.5) for r in texts() + odd], "doc_id long, text string, lang string, lang_pred string, score double").repartition(3)
    got = identify(docs, F.coalesce(F.col("doc_id") % 3 != 1, F.lit(False))).collect()
    assert len(got) == len(texts() + odd)
    by = {r.doc_id: r for r in got}
    held = [(by[i].lang_pred, lang) for i, _, lang in texts() if i % 3 == 1]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert [by[i].lang_pred for i in (1000, 1001, 1002, 1003, 1004)] == ["und", "und", "und", "bb", "bb"]
    assert by[1000].rejected and by[1000].score == 0 and all(0 <= r.score <= 1 for r in got)


def test_bounds_of_dictionaries(spark):
    docs = spark.createDataFrame(texts() + [(i, "the same text", "aa") for i in range(500)], "doc_id long, text string, lang string")
    out = dictionaries(docs, dict_bytes=1000, slots=64)
    assert list(out)[0] == "aa" and all(len(d) <= 1000 for d in out.values()) and out["aa"].count(b"the same text") <= 1
    assert all(len(d) <= 10 for d in dictionaries(docs, total_bytes=30).values())


def test_nothing_learnt_and_empty(spark):
    docs = spark.createDataFrame(texts(5), "doc_id long, text string, lang string")
    assert {r.lang_pred for r in identify(docs, F.lit(False)).collect()} == {"und"}
    assert identify(docs.limit(0), F.lit(True)).collect() == []


def test_plain_letters():
    assert plain_letters("Ab1-É!c") == "ab é c".encode()


def test_dictionaries_hold_common_texts_and_all_of_a_text(spark):
    rows = [(f"{'ÿ odd' if i % 20 == 0 else 'plain'} number{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i // 100]}", "aa") for i in range(800)]
    rows += [("head " * 1000 + "tail " * 3000 + "x" * i, "bb") for i in range(60)]
    out = dictionaries(spark.createDataFrame(rows, "text string, lang string"), slots=16)
    assert out["aa"].count(b"number") == 16 and out["aa"].count(b"odd") <= 4
    assert out["bb"].count(b"tail") > out["bb"].count(b"head") > 0


def test_sizes_are_those_of_plain_compression(spark):
    """Every prediction against the sizes of fresh compressors, one language at a time."""
    import zstandard

    docs = spark.createDataFrame(texts(60) + [(900, "der", "bb"), (901, "the " * 5000, "aa")], "doc_id long, text string, lang string")
    contents = dictionaries(docs)

    def sizes(data, level, **more):
        out = []
        for c in contents.values():
            how = zstandard.ZstdCompressionParameters.from_level(level, write_content_size=0, write_checksum=0, write_dict_id=0, **more)
            out.append(len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how).compress(data)))
        return out

    langs = list(contents)
    text = {i: t for i, t, _ in texts(60)} | {900: "der", 901: "the " * 5000}
    for r in identify(docs, F.lit(True)).collect():
        data = plain_letters(text[r.doc_id])
        quick = sizes(data, 3)
        a, b = sorted(quick)[:2]
        last = quick if b / a - 1 >= 0.06 else sizes(data, 12, min_match=3)
        a, b = sorted(last)[:2]
        assert r.lang_pred == langs[last.index(a)] and r.rejected == (b / a - 1 < 0.01)
