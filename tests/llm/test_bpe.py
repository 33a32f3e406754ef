import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerline.llm.bpe import byte_letters, compile_merges, decode_ids, encode_texts, read_automaton, splitter

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "a", "  two  spaces ", "it's I'LL we've", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", "日本語 テキスト", "naïve café x", "\u0085\x1c\t\n\r\n", "x" * 3000, " " * 700 + "y", "=-" * 500, "٣½ⅧⅨ²", "á​﻿😀👍🏽", "\x00\x7f", "1234567 89", "...!!!???"]


def numbers(ids: bytes) -> list[int]:
    return np.frombuffer(ids, "<u4").tolist()


def library_file(path, vocabulary, merges):
    path.write_text(json.dumps({
        "version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "post_processor": None,
        "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True},
        "decoder": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True},
        "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": vocabulary, "merges": [list(m) for m in merges]},
    }))
    return str(path)


def made_up(seed: int, most: int = 60):
    """A vocabulary of random merges over three letters: overlaps, doubled tokens, and merges that can never apply."""
    rng = random.Random(seed)
    vocabulary = {c: i for i, c in enumerate(byte_letters())}
    tokens, merges = ["a", "b", "c"], []
    while len(merges) < most:
        u, v = rng.choice(tokens), rng.choice(tokens)
        if u + v not in vocabulary and len(u + v) < 12:
            merges.append((u, v))
            vocabulary[u + v] = len(vocabulary)
            tokens.append(u + v)
    return vocabulary, merges


@pytest.mark.parametrize("seed", range(12))
def test_random_merges_against_the_library(tmp_path, seed):
    vocabulary, merges = made_up(seed)
    library, automaton = Tokenizer.from_file(library_file(tmp_path / "t.json", vocabulary, merges)), compile_merges(vocabulary, merges)
    rng = random.Random(seed)
    words = ["".join(rng.choices("abc", k=rng.randrange(1, 30))) for _ in range(800)] + ["a" * i for i in range(1, 40)] + ["ab" * 30, "abc" * 40]
    for word, got in zip(words, automaton.encode([w.encode() for w in words]), strict=True):
        assert numbers(got) == library.encode(word).ids, (seed, word)


def test_every_prefix_has_one_path():
    """What the automaton takes, told without it: of all spellings of a word in tokens, exactly one has an arc at every step."""
    vocabulary, merges = made_up(5, 25)
    automaton = compile_merges(vocabulary, merges)
    labels = {automaton.labels[t]: t for t in range(256, len(vocabulary))} | {x: vocabulary[x.decode()] for x in (b"a", b"b", b"c")}

    def spellings(word: bytes, state: int):
        if not word:
            yield []
        for label, t in labels.items():
            if word.startswith(label) and t in automaton.found and automaton._arcs(np.array([state]), np.array([t]))[0]:
                for rest in spellings(word[len(label) :], int(automaton.after[t])):
                    yield [t, *rest]

    rng = random.Random(2)
    for _ in range(60):
        word = "".join(rng.choices("abc", k=rng.randrange(1, 11))).encode()
        assert list(spellings(word, 0)) == [numbers(automaton.encode([word])[0])]


def test_texts_against_the_library(spark):
    library = Tokenizer.from_file(PATH)
    rng = random.Random(4)
    letters = [*map(chr, range(0x20, 0x7F)), *"\n\t\r éßñ中文日٣½²", "the ", "'ll", "  "]
    texts = ODD + ["".join(rng.choices(letters, k=rng.randrange(1, 60))) for _ in range(1500)] + ["word " * 40_000 + "z" * 5000]
    rows = [(i, t, "en", -1, b"x") for i, t in enumerate(texts)] + [(None, None, None, None, None), (3, texts[3], None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_tokens int, ids binary").repartition(3)
    encoded = encode_texts(docs, PATH)
    assert encoded.columns == ["doc_id", "ids", "n_tokens"]
    got = decode_ids(encoded, PATH).collect()
    assert len(got) == len(rows)
    for r in got:
        text = texts[r.doc_id] if r.doc_id is not None else ""
        want = library.encode(text, add_special_tokens=False).ids
        assert numbers(r.ids) == want and r.n_tokens == len(want)
        assert r.decoded == library.decode(want, skip_special_tokens=False) == text


def test_decoding_cut_characters_and_nulls(spark):
    library = Tokenizer.from_file(PATH)
    rng = random.Random(9)
    lists = [[rng.randrange(50_257) for _ in range(rng.randrange(1, 30))] for _ in range(200)]
    rows = [(i, np.array(x, "<u4").tobytes()) for i, x in enumerate(lists)] + [(900, None), (901, b"")]
    for chosen in (rows, rows[-2:]):
        got = {r.k: r.decoded for r in decode_ids(spark.createDataFrame(chosen, "k int, ids binary").repartition(2), PATH).collect()}
        assert got[900] is None and got[901] == "" and len(got) == len(chosen)
        assert all(got[i] == library.decode(x, skip_special_tokens=False) for i, x in enumerate(lists) if i in got)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id string, text string")
    assert decode_ids(encode_texts(docs, PATH), PATH).collect() == []


def test_other_vocabularies_are_errors(tmp_path):
    vocabulary, merges = made_up(1)
    for wrong in ([*merges, merges[0]], [("a", "zz")], [("a", "b"), ("ab", "cc")]):
        with pytest.raises(ValueError):
            compile_merges(vocabulary, wrong)
    with pytest.raises(ValueError):
        compile_merges({"a": 0}, [])
    config = json.loads(open(library_file(tmp_path / "t.json", vocabulary, merges)).read())
    for part, key, value in (("pre_tokenizer", "add_prefix_space", True), ("model", "ignore_merges", True)):
        changed = config | {part: config[part] | {key: value}}
        (tmp_path / "u.json").write_text(json.dumps(changed))
        with pytest.raises(ValueError):
            read_automaton(str(tmp_path / "u.json"))


def test_cutting_near_and_far_is_the_same():
    cut = splitter()
    for text in ODD:
        assert "".join(cut(text)) == text
        far = cut(text + " 日")
        assert far[-1] == " 日" or not text.strip() or far[:-1] == cut(text)[: len(far) - 1]


def test_query_digests(spark, tmp_path):
    from ledgerline.llm.queries import op11_bpe

    documents = [(1, "Some text of <|endoftext|> two parts"), (2, None), (3, ""), (1, "Some text of <|endoftext|> two parts")]
    spark.createDataFrame(documents, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    library = Tokenizer.from_file(PATH)
    want = []
    for i, text in documents:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    got = op11_bpe(spark, str(tmp_path)).orderBy("doc_id", F.desc("n_tokens")).collect()
    assert sorted(map(tuple, got)) == sorted(want)
