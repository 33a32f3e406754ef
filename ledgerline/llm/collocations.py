"""Phrases whose words belong together: n-grams counted per language, scored by what their parts occur, without those that a longer phrase explains.

Words are exploded into rows of all phrases of 1 to max_n words, with their counts within a share of a task's words, and added up by Spark. That is done in two waves, as a phrase can't
occur more often than any two words in it: the first counts words and pairs, the second the longer phrases all of whose pairs occur often enough, which a bitmap of bounded size tells. Pairs
that share a bit with a frequent one only cost rows: what is rare is left out by its own count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import LOWER, UPPER, written

#: A task adds up the phrases of so many words at a time, and parts so many bytes of texts into words at a time.
TOGETHER, BYTES = 1 << 21, 1 << 20
#: The bitmap of frequent pairs has 2**BITS bits: 8 MB.
BITS = 26
#: Rows that are passed on at a time.
ROWS = 1 << 16
#: Phrases of a language are ranked in so many groups before they are ranked together.
GROUPS = 64

_CUTS = ".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes.maketrans((UPPER + _CUTS + "\t").encode(), (LOWER + "\n" * len(_CUTS) + " ").encode())


class _Ids(dict):
    """Words by number, in the order in which they come; 0 stands between two pieces."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class _Share:
    """A language's words since they were last added up."""

    def __init__(self) -> None:
        self.ids, self.parts = _Ids({b"\n": 0}), []

    def add(self, texts: list[bytes]) -> int:
        pieces = b"\n".join(texts).translate(_PLAIN).replace(b"\n", b" \n ").split(b" ")
        found = np.fromiter(map(self.ids.__getitem__, filter(None, pieces)), np.int32)
        self.parts.append(np.append(found, np.int32(0)))
        return np.count_nonzero(found)

    def phrases(self, low: int, high: int, frequent: Frequent | None, lang: str) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """(phrases, how often each occurs) for each number of words; the empty phrase stands for every word."""
        run = np.concatenate([*self.parts, np.zeros(high, np.int32)])
        names = pa.array(list(self.ids), pa.binary()).cast(pa.string())
        at = np.flatnonzero(run)
        if low == 1:
            yield pa.array([""]), np.array([len(at)])
            counts = np.bincount(run, minlength=len(self.ids))
            counts[0] = 0
            there = np.flatnonzero(counts)
            yield names.take(pa.array(there)), counts[there]
        good = frequent.pairs(list(self.ids), lang, run) if frequent else None
        columns, number = [np.arange(len(self.ids))], run[at].astype(np.int64)
        for n in range(2, high + 1):
            on = run[at + n - 1] > 0
            if good is not None:
                on &= good[at + n - 2]
            at, number = at[on], number[on]
            key = number * len(self.ids) + run[at + n - 1]
            distinct, *number, counts = np.unique(key, return_inverse=n < high, return_counts=True)
            number = number[0] if number else None
            columns = [*(c[distinct // len(self.ids)] for c in columns), distinct % len(self.ids)]
            if n >= low and len(distinct):
                yield pc.binary_join_element_wise(*(names.take(pa.array(c)) for c in columns), " "), counts


class Frequent:
    """Which pairs of words may be frequent: a bit for every slot that a frequent pair falls into."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def pairs(self, words: list[bytes], lang: str, run: np.ndarray) -> np.ndarray:
        """For each place of run whether the pair of words that begins there may be frequent."""
        import xxhash

        hashed = np.fromiter((xxhash.xxh64_intdigest(w, seed=42) for w in words), np.uint64, len(words))
        turned, own = _turn(hashed, 21), _turn(np.array([xxhash.xxh64_intdigest(lang.encode(), seed=42)], np.uint64), 42)
        slot = (hashed[run[:-1]] ^ turned[run[1:]] ^ own) >> np.uint64(64 - BITS)
        return np.append((self.bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) > 0, False)

    @classmethod
    def of(cls, pairs: DataFrame) -> Frequent:
        """pairs(lang, phrase of two words). The driver gets at most 2**BITS bits, in rows of 64."""
        turn = lambda c, n: F.shiftleft(c, n).bitwiseOR(F.shiftrightunsigned(c, 64 - n))
        of = lambda c: F.xxhash64(c)
        hashed = of(F.split_part("phrase", F.lit(" "), F.lit(1))).bitwiseXOR(turn(of(F.split_part("phrase", F.lit(" "), F.lit(2))), 21)).bitwiseXOR(turn(of(F.col("lang")), 42))
        slots = pairs.select(F.shiftrightunsigned(hashed, 64 - BITS).alias("slot"))
        rows = slots.groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")).alias("bits")).toArrow()
        bits = np.zeros(1 << (BITS - 6), np.uint64)
        bits[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
        return cls(bits)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return x << np.uint64(n) | x >> np.uint64(64 - n)


def phrase_counts(docs: DataFrame, low: int, high: int, frequent: Frequent | None = None) -> DataFrame:
    """(lang, phrase, f): how often each phrase of low to high words occurs in docs(lang, text), overlaps included; the phrase without words has the number of all words, if low is 1.

    frequent: phrases with a pair that isn't among these are left out. A task holds the numbers of TOGETHER words and one batch of texts."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent.bits) if frequent else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Frequent(shared.value) if shared else None
        shares: dict[str, _Share] = {}
        words = 0

        def counted() -> Iterator[pa.RecordBatch]:
            for lang, share in shares.items():
                for phrases, counts in share.phrases(low, high, known, lang):
                    for at in range(0, len(phrases), ROWS):
                        some = phrases.slice(at, ROWS)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), some, pa.array(counts[at : at + ROWS], pa.int64())], ["lang", "phrase", "f"])

        for b in batches:
            langs, size = b.column(0).to_pylist(), np.cumsum(pc.binary_length(b.column(1)).to_numpy())
            at = 0
            while at < len(langs):
                to = max(at + 1, int(np.searchsorted(size, BYTES + (size[at - 1] if at else 0), "right")))
                texts: dict[str, list[bytes]] = {}
                for lang, text in zip(langs[at:to], b.column(1).slice(at, to - at).to_pylist(), strict=True):
                    texts.setdefault(lang, []).append(text)
                for lang, own in texts.items():
                    words += shares.setdefault(lang, _Share()).add(own)
                at = to
                if words >= TOGETHER:
                    yield from counted()
                    shares, words = {}, 0
        yield from counted()

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, "lang string, phrase string, f bigint").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _ranked(rows: DataFrame, most: int) -> DataFrame:
    """The first `most` rows of each language, ranked. Groups of phrases are ranked first, so that no task has all phrases of a language."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(GROUPS))).orderBy(*order))).where(F.col("rank") <= most)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most)


def _words(first: int | Column, count: Column) -> Column:
    return F.array_join(F.slice("w", first, count), " ")


def collocations(docs: DataFrame, max_n: int = 4, least: int = 30, covered: int = 80, most: int = 2000, waves: bool = True) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of docs(lang, text): each language's `most` phrases of 2 to max_n words that occur `least` times or more.

    a, l and r are how often the phrase and its two parts occur, at the cut that gives the lowest score, floor(2000000 * a / (l + r)); n is the number of words. A phrase goes if one that
    has it and more words occurs at least covered / 100 as often; a phrase of one more word tells, since it occurs at least as often as longer ones. Null languages are `und`; null and empty texts have no words;
    repeated rows count each; columns beside lang and text don't matter. waves=False explodes all phrases at once, to the same result.
    """
    counts = written(phrase_counts(docs, 1, min(2, max_n) if waves else max_n).where((F.col("f") >= least) | (F.col("phrase") == "")), "phrases")
    n_words = F.when(F.col("phrase") == "", 0).otherwise(F.size("w"))
    often = counts.where(F.col("phrase") != "")
    if waves and max_n > 2:
        frequent = Frequent.of(often.where(F.instr("phrase", " ") > 0))
        often = often.unionByName(written(phrase_counts(docs, 3, max_n, frequent).where(F.col("f") >= least), "phrases"))
    long = often.withColumn("w", F.split("phrase", " ")).withColumn("size", n_words).where("size > 1").withColumnRenamed("f", "a")
    cuts = long.select("lang", "phrase", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _words(1, F.col("k")).alias("head"), _words(F.col("k") + 1, F.col("size") - F.col("k")).alias("tail"))
    part = lambda name, count: often.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    scored = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"]).withColumn("score", F.expr("CAST(a AS DECIMAL(19,0)) * 2000000 div (CAST(l AS DECIMAL(19,0)) + r)"))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("s")).select("lang", "phrase", "a", "s.l", "s.r", "s.score")
    shorter = F.explode(F.array(_words(1, F.col("size") - 1), _words(2, F.col("size") - 1))).alias("phrase")
    extended = long.where("size > 2").select("lang", "a", shorter).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    explained = long.select("lang", "phrase", "a").join(extended, ["lang", "phrase"]).where(F.expr(f"100 * CAST(longer AS DECIMAL(19,0)) >= {covered} * CAST(a AS DECIMAL(19,0))"))
    kept = _ranked(lowest.join(explained.select("lang", "phrase"), ["lang", "phrase"], "left_anti"), most)
    total = counts.where(F.col("phrase") == "").select("lang", F.col("f").alias("n"))
    return kept.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
