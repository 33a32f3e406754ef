"""Toxicity scores of texts whose words may be disguised.

A noisy channel is undone first: suspicious tokens (signs or digits among letters, letters said thrice or more, letters spelled out
one by one) become lattices of what each sign can stand for, and Viterbi search under a character language model picks
the likeliest reading. A logistic model over words and word beginnings scores the restored text.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import drop_written, hashed_sample, written

#: The letters that signs commonly stand for.
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "*": "aeiou", "#": "h"}
#: Log-probabilities of the channel: a letter written by a sign, a sign or gap put between letters, a letter said again.
_SIGN, _NOISE, _AGAIN = -1.5, -1.0, -0.5

_THRICE = re.compile(r"([^\W\d_])\1\1")
_SPELLED = re.compile(r"(?<![^\s])[^\W_](?:[ ._*-]+[^\W_]){2,}(?![^\s.,;:!?)\"'])")
_LETTERS = re.compile(r"[^\W\d_]+")
#: Signs that make a token suspicious beside letters, and those that do so only after a letter.
_STRONG, _WEAK = frozenset("0123456789@$!|+€(*#"), frozenset("._-")
#: So many stages of searches are remembered at a time.
_REMEMBERED = 8192


def core_of(token: str) -> str:
    """A token without the signs around it. One @ or $ may begin it and one of @ $ | + may end it, for such stand for letters; what is said twice does not."""
    if token.isalnum():
        return token
    i, n = 0, len(token)
    while i < n and not (token[i].isalnum() or token[i] == "_"):
        j = i + 1
        while j < n and token[j] == token[i]:
            j += 1
        if j == i + 1 and token[i] in "@$":
            break
        i = j
    end = n
    while end > i and not (token[end - 1].isalnum() or token[end - 1] == "_"):
        end -= 1
    if n - end == 1 and token[end] in "@$|+":
        end = n
    return token[i:end]


def mixed(core: str) -> bool:
    """Whether a letter stands before a sign, or a strong sign before a letter."""
    letter = strong = False
    for ch in core:
        if ch.isalpha():
            if strong:
                return True
            letter = True
        elif ch in _STRONG:
            if letter:
                return True
            strong = True
        elif letter and ch in _WEAK:
            return True
    return False


class Trigrams(Mapping):
    """Counts of trigrams as two arrays in order of the trigrams, 16 bytes each, so that all that a corpus has can be sent to the tasks."""

    def __init__(self, counts: Iterable[tuple[str, int]]):
        codes, n = array("q"), array("q")
        for t, k in counts:
            codes.append(self._code(t))
            n.append(k)
        at = np.argsort(np.frombuffer(codes, np.int64))
        self.codes, self.n = (np.frombuffer(x, np.int64)[at] for x in (codes, n))

    @staticmethod
    def _code(t: str) -> int:
        return ord(t[0]) << 42 | ord(t[1]) << 21 | ord(t[2])

    def __getitem__(self, t: str) -> int:
        at = int(np.searchsorted(self.codes, code := self._code(t)))
        if at == len(self.codes) or self.codes[at] != code:
            raise KeyError(t)
        return int(self.n[at])

    def __len__(self) -> int:
        return len(self.codes)

    def __iter__(self) -> Iterator[str]:
        return (chr(c >> 42) + chr(c >> 21 & 0x1FFFFF) + chr(c & 0x1FFFFF) for c in map(int, self.codes))

    def items(self) -> Iterator[tuple[str, int]]:
        return zip(self, map(int, self.n))


class CharModel:
    """Interpolated trigram model of the letters in words; a space stands for either end."""

    def __init__(self, counts: Mapping[str, int], letters: dict[str, int] | None = None):
        """counts: of trigrams; letters: of single letters, where counts lacks rare trigrams."""
        self.three = counts
        self.two: Counter = Counter()
        self.one: Counter = Counter(letters or {})
        self.before: Counter = Counter()
        for t, n in counts.items():
            self.two[t[1:]] += n
            self.before[t[:2]] += n
            if letters is None:
                self.one[t[2]] += n
        self.two_before: Counter = Counter()
        for t, n in self.two.items():
            self.two_before[t[0]] += n
        self.total = sum(self.one.values())
        self.logp = lru_cache(500_000)(self._logp)
        self.stages: dict[tuple, Stage] = {}

    def _logp(self, a: str, b: str, c: str) -> float:
        p = (self.one[c] + 0.1) / (self.total + 0.1 * (len(self.one) + 1))
        p = (self.two[b + c] + 5 * p) / (self.two_before[b] + 5)
        return log((self.three.get(a + b + c, 0) + 5 * p) / (self.before[a + b] + 5))


class Stage:
    """Where a search stands: the letter read last, and each state (two letters before) with its log-probability below that of the best."""

    __slots__ = ("last", "states", "to")

    def __init__(self, last: str, states: tuple):
        self.last, self.states = last, states
        #: what follows by the next sign: a stage, and for each of its states the place of the state before and the letter read
        self.to: dict[str, tuple[Stage, tuple]] = {}


def _stage(last: str, states: tuple, model: CharModel) -> Stage:
    """One stage for the same state of affairs, so that what repeats itself, in a token or between tokens, is searched once."""
    if len(model.stages) >= _REMEMBERED:
        for s in model.stages.values():
            s.to = {}
        model.stages.clear()
    found = model.stages.get((last, states))
    if found is None:
        found = model.stages[last, states] = Stage(last, states)
    return found


def _next(stage: Stage, ch: str, model: CharModel) -> tuple[Stage, tuple]:
    if ch.isalpha():
        options = [(ch, 0.0)] + ([("", _AGAIN)] if ch == stage.last else [])
    elif ch.isspace():
        options = [("", _NOISE), (" ", 0.0)]
    else:
        options = [(c, _SIGN) for c in SIGNS.get(ch, "")] + [("", _NOISE)]
    new: dict = {}
    for at, ((a, b), p) in enumerate(stage.states):
        for c, cost in options:
            if not c or c == b == " ":
                to, q, letter = (a, b), p + cost, ""
            else:
                to, q, letter = (b, c), p + cost + model.logp(a, b, c), c
            if to not in new or q > new[to][0]:
                new[to] = (q, at, letter)
    if len(new) == 1:
        [(to, (_, at, letter))] = new.items()
        return _stage(ch if ch.isalpha() else "", ((to, 0.0),), model), (at, letter)
    best = max([q for q, _, _ in new.values()])
    way = tuple([x for _, at, letter in new.values() for x in (at, letter)])
    return _stage(ch if ch.isalpha() else "", tuple([(to, q - best) for to, (q, _, _) in new.items()]), model), way


def restored(token: str, model: CharModel) -> list[str]:
    """The likeliest words behind a lower-cased token, however long. Spaces in it may be gaps within a word or ends of words."""
    stage = _stage("", (((" ", " "), 0.0),), model)
    ways = []
    for ch in token:
        found = stage.to.get(ch)
        if found is None:
            found = stage.to[ch] = _next(stage, ch, model)
        stage, way = found
        ways.append(way)
    ends = [p + model.logp(a, b, " ") for (a, b), p in stage.states]
    letters, at = [], ends.index(max(ends))
    for way in reversed(ways):
        letters.append(way[2 * at + 1])
        at = way[2 * at]
    return "".join(reversed(letters)).split()


def words_of(token: str, model: CharModel) -> list[str]:
    """The words of one token, whatever its length: its letters as they are, or restored where it is suspicious."""
    core = core_of(token)
    thrice = _THRICE.search(core)
    if core.isalpha() and not thrice:
        return [core]
    if thrice or mixed(core):
        return restored(core, model)
    return _LETTERS.findall(core)


class Reader:
    """Counts a text's features; keeps what tokens mean, for a bounded number of tokens."""

    def __init__(self, model: CharModel, wanted: dict[str, int] | None = None, held: int = 300_000):
        self.model, self.wanted, self.held = model, wanted, held
        self.known: dict[str, tuple] = {}

    def _features(self, token: str) -> tuple:
        out = []
        for w in words_of(token, self.model):
            out += [f"={w}", *(w[:n] for n in (4, 5, 6) if len(w) >= n)]
        return tuple(out if self.wanted is None else (self.wanted[x] for x in out if x in self.wanted))

    def counts(self, text: str | None) -> tuple[Counter, int]:
        """(feature -> occurrences, number of tokens)."""
        text = (text or "").lower()
        tokens = text.split()
        out: Counter = Counter()
        spelled = [w for m in _SPELLED.finditer(text) for w in restored(m[0], self.model)]
        for token, n in Counter([*tokens, *spelled]).items():
            features = self.known.get(token)
            if features is None:
                if len(self.known) >= self.held:
                    self.known.clear()
                features = self.known[token] = self._features(token)
            for f in features:
                out[f] += n
        return out, len(tokens)


def char_counts(texts: DataFrame, most: int | None = None) -> tuple[Mapping[str, int], dict[str, int]]:
    """Counts of the letter trigrams of all words of all rows of texts(text), and of single letters, summed up in tasks first.

    All letters and trigrams are counted, whatever their script and however many they are. With `most`, which no query gives, only those trigrams that occur often enough for the table to have at most
    so many; what is rarer is left to the shorter contexts of the model. The least count is then a power of two, found from a histogram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words: Counter = Counter()
            for t in b.column("text"):
                words.update((t.as_py() or "").lower().split())
            out: Counter = Counter()
            for w, n in words.items():
                if (core := w.strip(".,;:!?\"'()")).isalpha():
                    padded = f"  {core} "
                    for i in range(len(padded) - 2):
                        out[padded[i : i + 3]] += n
            yield pa.RecordBatch.from_pydict({"three": pa.array(out.keys(), pa.string()), "n": pa.array(out.values(), pa.int64())})

    sums = written(texts.select("text").mapInArrow(run, "three string, n long").groupBy("three").agg(F.sum("n").alias("n")), "toxic-trigrams")
    rows = sums
    if most is not None:
        sizes = {r.size: r.n for r in sums.groupBy(F.floor(F.log2("n")).cast("int").alias("size")).agg(F.count("*").alias("n")).collect()}
        least, total = max(sizes, default=0) + 1, 0
        while least > 0 and total + sizes.get(least - 1, 0) <= most:
            least -= 1
            total += sizes.get(least, 0)
        rows = sums.where(F.col("n") >= (1 << least))
    letters = {r.c: r.n for r in sums.groupBy(F.substring("three", 3, 1).alias("c")).agg(F.sum("n").alias("n")).collect()}
    three = Trigrams((r.three, r.n) for r in rows.toLocalIterator())
    drop_written(texts.sparkSession, sums)
    return three, letters


class Vectors:
    """Sparse rows: two inputs for each feature of a text, whether it occurs and how densely, and the intercept (last).

    at and n: features and their occurrences, row after row, sizes of which belong to each row; tokens: the rows' numbers of tokens."""

    def __init__(self, at: np.ndarray, n: np.ndarray, sizes: np.ndarray, tokens: np.ndarray, width: int):
        self.n, self.half, self.width = len(sizes), width, 2 * width + 1
        self.row, self.at = np.repeat(np.arange(self.n, dtype=np.int32), sizes), at
        self.dense = np.log1p(100 * n / np.maximum(10, tokens)[self.row])

    @classmethod
    def of(cls, found: list[tuple[dict[int, int], int]], width: int) -> Vectors:
        """Of (feature -> occurrences, number of tokens) of each row."""
        sizes = np.array([len(c) for c, _ in found], np.int32)
        total = int(sizes.sum())
        at, n = (np.fromiter((x for c, _ in found for x in of(c)), np.int32, total) for of in (dict.keys, dict.values))
        return cls(at, n, sizes, np.array([t for _, t in found], np.int32), width)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.at] + self.dense * w[self.half :][self.at], self.n) + w[-1]

    def transposed(self, v: np.ndarray) -> np.ndarray:
        own = v[self.row]
        return np.concatenate([np.bincount(self.at, own, self.half), np.bincount(self.at, self.dense * own, self.half), [v.sum()]])


def fit_logistic(x: Vectors, y: np.ndarray, strength: float = 3.0, steps: int = 20) -> np.ndarray:
    """Weights with an L2 penalty on all but the intercept, by Newton steps that conjugate gradients solve, each to a hundredth of its gradient."""
    w, ridge = np.zeros(x.width), np.full(x.width, strength)
    ridge[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x.times(w), -30, 30)))
        slope = np.maximum(p * (1 - p), 1e-6)
        rest = x.transposed(y - p) - ridge * w
        move, way, size = np.zeros(x.width), rest.copy(), rest @ rest
        if size < 1e-8:
            break
        enough = 1e-4 * size
        for _ in range(100):
            if size <= enough:
                break
            bent = x.transposed(slope * x.times(way)) + ridge * way
            step = size / (way @ bent)
            move += step * way
            rest = rest - step * bent
            before, size = size, rest @ rest
            way = rest + size / before * way
        w += move
    return w


def score_toxicity(docs: DataFrame, labels: DataFrame, learn_from: Column, columns: list[str] | None = None, rows: int = 20_000, apart: float = 3.0) -> DataFrame:
    """(kept, learnt_from, score) for every row of docs(doc_id, text, ...); kept holds the given columns (doc_id). score, from 0 to 1, is the higher the likelier toxic = 1 in labels(doc_id, toxic).

    learn_from, a condition on doc_id, tells the labelled rows that are learnt from; of those the classifier is fitted on at most `rows`
    documents, picked by a hash of their id, with all features that at least three of them have and that occur among toxic texts more or less often than by chance, by `apart` standard
    deviations. The character model covers all of docs. A document with several labels counts as toxic if one says so, one id with several texts is learnt from by
    the first in order; labels that are null say nothing. Null and empty texts get the score of a text without features; long texts are read whole. With no label of either kind, every
    score is the share of toxic labels, smoothed. Repeated rows are all returned.
    """
    spark = docs.sparkSession
    sample = labels.where(learn_from & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = hashed_sample(sample, "doc_id", rows)
    chars = spark.sparkContext.broadcast(char_counts(docs))
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").cast("int").alias("toxic"))
    labelled = written(texts.select("text", "toxic"), "toxic-labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(CharModel(*chars.value))
        for b in batches:
            both: tuple[Counter, Counter] = (Counter(), Counter())
            for t, y in zip(b.column("text"), b.column("toxic"), strict=True):
                own = reader.counts(t.as_py())[0].keys()
                both[y.as_py() > 0].update(own)
                both[y.as_py() > 0][""] += 1  # the number of texts
            keys = list(both[0].keys() | both[1].keys())
            yield pa.RecordBatch.from_pydict({"feature": pa.array(keys, pa.string()), "clean": pa.array([both[0][k] for k in keys], pa.int64()), "toxic": pa.array([both[1][k] for k in keys], pa.int64())})

    table = labelled.mapInArrow(count, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    table = written(table.where("clean + toxic >= 3"), "toxic-features")
    totals = table.where("feature = ''").first() or labelled.agg(F.count(F.when(F.col("toxic") <= 0, 1)).alias("clean"), F.count(F.when(F.col("toxic") > 0, 1)).alias("toxic")).first()
    clean, toxic = totals.clean, totals.toxic
    # how much more often among toxic texts, in standard deviations
    share = (F.col("clean") + F.col("toxic")) / (clean + toxic + 1)
    strength = (F.col("toxic") - toxic * share) / F.sqrt(toxic * share * (1 - share) + 1)
    wanted = {r.feature: i for i, r in enumerate(table.where((F.col("feature") != "") & (F.abs(strength) >= apart)).orderBy("feature").collect())}
    shared = spark.sparkContext.broadcast(wanted)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(CharModel(*chars.value), shared.value)
        for b in batches:
            found = [reader.counts(t.as_py()) for t in b.column("text")]
            at, n = (pa.array([np.fromiter(of(c), np.int32, len(c)).tobytes() for c, _ in found], pa.binary()) for of in (dict.keys, dict.values))
            yield pa.RecordBatch.from_arrays([at, n, pa.array([n for _, n in found], pa.int32()), b.column("toxic")], ["at", "n", "tokens", "toxic"])

    if toxic and clean:
        fit = labelled.mapInArrow(vectors, "at binary, n binary, tokens int, toxic int").collect()
        at, n = (np.frombuffer(b"".join(r[k] for r in fit), np.int32) for k in ("at", "n"))
        x = Vectors(at, n, np.array([len(r.at) // 4 for r in fit], np.int32), np.array([r.tokens for r in fit], np.int32), len(wanted))
        weights = fit_logistic(x, np.array([r.toxic > 0 for r in fit], float))
        del fit, at, n, x
    else:
        weights = np.zeros(2 * len(wanted) + 1)
        weights[-1] = log((toxic + 0.5) / (clean + 0.5)) if toxic + clean else -1.0
    drop_written(spark, labelled, table)
    model = spark.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, w = Reader(CharModel(*chars.value), shared.value), model.value
        for b in batches:
            z = Vectors.of([reader.counts(t.as_py()) for t in b.column("text")], len(shared.value)).times(w)
            yield pa.RecordBatch.from_arrays([b.column("kept"), b.column("learnt_from"), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())], ["kept", "learnt_from", "score"])

    picked = docs.select(F.struct(*(columns or ["doc_id"])).alias("kept"), learn_from.alias("learnt_from"), "text")
    return picked.mapInArrow(score, picked.select("kept").schema.add("learnt_from", "boolean").add("score", "double"))
