"""Log-bilinear language model: trained in numpy by noise-contrastive estimation, normalised by batched matrix products.

Words fall into classes: each of the most frequent words is a class of its own, all others share classes by their first letters.
A token's probability is that of its class after the two classes before it (the neural model) times the word's smoothed share of its class.
Word counts come from the whole training fold and never meet in one place: a bounded head is broadcast, the tail is joined.
Texts are turned into class numbers once. Training deals them out by a hash into blocks of about equal numbers of tokens, so that it does not matter how files are split; the blocks are gone through in
rounds, each of which starts from the average that the round before has left. More texts make more blocks in every round.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import written

#: The end of a text as a token; words hold no white space.
END = b" "


@dataclass(frozen=True)
class Shape:
    """own: words with a class of their own; shared: classes of the others; head: words broadcast with their counts, the bound of what tasks hold of the vocabulary.
    rounds: how often blocks are averaged; block: tokens of one; least: blocks in each round at least, where the corpus has so many (a small corpus is gone through again)."""

    own: int = 768
    shared: int = 256
    head: int = 131_072
    dims: int = 16
    noise: int = 32
    batch: int = 2048
    rate: float = 0.3
    rounds: int = 6
    block: int = 500_000
    least: int = 4

    @property
    def classes(self) -> int:
        return self.own + self.shared


def tokens(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased words, then one end. Null: the end only."""
    return [*(text or b"").lower().split(), END]


def shared_class(word: bytes, shape: Shape) -> int:
    return shape.own + zlib.crc32(word[:3]) % shape.shared


def word_counts(texts: DataFrame) -> DataFrame:
    """(word binary, c) over all rows of texts(text binary), ends included. Counted per batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: Counter = Counter()
            for t in b.column("text"):
                counts.update(tokens(t.as_py()))
            yield pa.RecordBatch.from_pydict({"word": pa.array(counts.keys(), pa.binary()), "c": pa.array(counts.values(), pa.int64())})

    return texts.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """The head of the vocabulary: counts, classes, and each class's mass."""

    def __init__(self, rows: list, shape: Shape, total: int, kinds: int, masses: dict[int, tuple[int, int]]):
        self.shape, self.total, self.kinds = shape, total, kinds
        self.count = np.array([r.c for r in rows] + [0], np.int64)
        self.number = {bytes(r.word): i for i, r in enumerate(rows)}
        self.known = np.array([i if i < shape.own else shared_class(bytes(r.word), shape) for i, r in enumerate(rows)] + [0], np.int32)
        n = np.zeros(shape.classes)
        self.types = np.zeros(shape.classes)
        n[: min(shape.own, len(rows))] = self.count[: min(shape.own, len(rows))]
        for cls, (mass, types) in masses.items():
            n[cls], self.types[cls] = mass, types
        self.mass = n
        used = (n + 0.5) * ((np.arange(shape.classes) < len(rows)) | (np.arange(shape.classes) >= shape.own))  # no word, no share
        self.prior = used / used.sum()
        self.base = np.log10((self.count + 0.5) / (total + 0.5 * (kinds + 1)))
        inside = (self.count + 0.5) / (n + 0.5 * (self.types + 1))[self.known]
        inside[: min(shape.own, len(rows))] = 1.0  # the word is its class
        self.inside = np.log10(inside)

    def lookup(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Numbers of the tokens (-1 for the tail), their classes, and the words of the tail in order."""
        words = tokens(text)
        at = np.fromiter(map(self.number.get, words, [-1] * len(words)), np.int32, len(words))
        cls, tail = self.known[at], []
        for i in np.flatnonzero(at < 0):
            tail.append(words[i])
            cls[i] = shared_class(words[i], self.shape)
        return at, cls, tail


class LogBilinear:
    """score(c | a, b) = (first * R[a] + second * R[b]) . O[c] + bias[c]; b is the class just before."""

    def __init__(self, shape: Shape, prior: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.r, self.o = (rng.normal(0, 0.1, (shape.classes, shape.dims)).astype(np.float32) for _ in range(2))
        self.mix = np.ones((2, shape.dims), np.float32)
        self.bias = np.log(np.maximum(prior, 1e-30)).astype(np.float32)
        self.shape, self.prior = shape, prior

    def rows(self) -> np.ndarray:
        """All parameters as rows of dims + 1 numbers."""
        wide = lambda x: np.hstack([x, np.zeros((len(x), 1), np.float32)])
        return np.vstack([wide(self.r), np.hstack([self.o, self.bias[:, None]]), wide(self.mix)])

    def set_rows(self, rows: np.ndarray) -> None:
        c, rows = self.shape.classes, rows.astype(np.float32)
        self.r, self.o, self.bias, self.mix = rows[:c, :-1].copy(), rows[c : 2 * c, :-1].copy(), rows[c : 2 * c, -1].copy(), rows[2 * c :, :-1].copy()

    def predict(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.mix[0] * self.r[a] + self.mix[1] * self.r[b]

    def train(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, rng: np.random.Generator, rate: float) -> None:
        """One step of noise-contrastive estimation over a batch; the noise words, drawn from the class prior, are shared by the batch."""
        k, n = self.shape.noise, len(c)
        noise = np.searchsorted(np.cumsum(self.prior), rng.random(k) * (1 - 1e-9)).clip(0, self.shape.classes - 1)
        q = self.predict(a, b)
        floor = np.log(k * np.maximum(self.prior, 1e-30)).astype(np.float32)
        hit = 1 / (1 + np.exp((q * self.o[c]).sum(1) + self.bias[c] - floor[c]))  # 1 - sigmoid: the pull towards the data
        miss = -1 / (1 + np.exp(-(q @ self.o[noise].T + self.bias[noise] - floor[noise])))  # the push from the noise
        step = np.float32(rate / n)
        up_q = hit[:, None] * self.o[c] + miss @ self.o[noise]
        up_o = np.vstack([hit[:, None] * q, miss.T @ q])
        at_o, up_b = np.concatenate([c, noise]), np.concatenate([hit, miss.sum(0)])
        up_r, at_r = np.vstack([up_q * self.mix[0], up_q * self.mix[1]]), np.concatenate([a, b])
        up_mix = np.stack([(up_q * self.r[a]).sum(0), (up_q * self.r[b]).sum(0)])
        size = self.shape.classes
        # each row moves by its mean gradient times the root of how often it came, so that rare classes learn too
        for at, up, to in ((at_o, up_o, self.o), (at_r, up_r, self.r)):
            sums = np.stack([np.bincount(at, up[:, d], size) for d in range(up.shape[1])], 1)
            to += (step * np.sqrt(n) * sums / np.sqrt(np.bincount(at, minlength=size) + 1.0)[:, None]).astype(np.float32)
        self.bias += (step * np.sqrt(n) * np.bincount(at_o, up_b, size) / np.sqrt(np.bincount(at_o, minlength=size) + 1.0)).astype(np.float32)
        self.mix += step * up_mix

    def normalisers(self, a: np.ndarray) -> np.ndarray:
        """log of the sum over all classes of exp(score), for contexts (a, every class)."""
        every = np.arange(self.shape.classes)
        out = np.empty((len(a), self.shape.classes), np.float32)
        for i, x in enumerate(a):
            s = self.predict(np.full(len(every), x), every) @ self.o.T + self.bias
            top = s.max(1)
            out[i] = top + np.log(np.exp(s - top[:, None]).sum(1))
        return out


def _train_block(model: LogBilinear, texts: Iterator[np.ndarray], end: int, seed: int, steps: int) -> tuple[np.ndarray, int]:
    """One pass over a block's texts (class numbers); how often each class occurred, and the steps taken so far."""
    rng, seen = np.random.default_rng(seed), np.zeros(model.shape.classes)
    held: list[np.ndarray] = []
    size, batch = 0, model.shape.batch

    def learn(last: bool) -> None:
        nonlocal held, size, steps
        t = np.concatenate(held)
        at = rng.permutation(len(t))
        stop = len(at) if last else len(at) - len(at) % batch
        for i in range(0, stop, batch):
            part = t[at[i : i + batch]]
            model.train(part[:, 0], part[:, 1], part[:, 2], rng, model.shape.rate / (1 + steps / 1000) ** 0.5)
            steps += 1
        held = [t[at[stop:]]] if stop < len(at) else []
        size = len(at) - stop

    for c in texts:
        before = np.concatenate([[end, end], c[:-1]]).astype(np.int32)
        held.append(np.stack([before[:-1], before[1:], c], 1))
        seen += np.bincount(c, minlength=model.shape.classes)
        size += len(c)
        if size >= 64 * batch:
            learn(False)
    if size:
        learn(True)
    return seen, steps


def trained(encoded: DataFrame, blocks: int, vocabulary, shape: Shape) -> LogBilinear:
    """The model after all rounds over encoded(block, order, cls). In a round all blocks start from the same parameters; a class's rows are averaged by how often it occurred in each block."""
    spark = encoded.sparkSession
    model = LogBilinear(shape, vocabulary.value.prior)
    each = min(blocks, max(shape.least, -(-blocks // shape.rounds)))
    names = [f"v{d}" for d in range(shape.dims + 1)]
    for turn in range(shape.rounds):
        shared = spark.sparkContext.broadcast(model.rows())
        steps = turn * shape.block // shape.batch

        def run(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn, steps=steps) -> Iterator[pa.RecordBatch]:
            v = vocabulary.value
            end = int(v.known[v.number[END]])
            rows = ((i, c) for b in batches for i, c in zip(b.column("block").to_pylist(), b.column("cls"), strict=True))
            for block, own in groupby(rows, key=lambda r: r[0]):
                own_model = LogBilinear(shape, v.prior)
                own_model.set_rows(shared.value)
                seen, _ = _train_block(own_model, (c.values.to_numpy(zero_copy_only=False).astype(np.int32) for _, c in own), end, block * 1000 + turn, steps)
                out = own_model.rows().astype(np.float64)
                weight = np.concatenate([seen + 1e-3, seen + 1e-3, [seen.sum()] * 2])
                yield pa.RecordBatch.from_pydict({"at": pa.array(range(len(out)), pa.int64()), "weight": pa.array(weight)} | {n: pa.array(out[:, d] * weight) for d, n in enumerate(names)})

        chosen = F.pmod(F.col("block") - turn * each, F.lit(blocks)) < each
        dealt = encoded.where(chosen).select("block", "order", "cls").repartition("block").sortWithinPartitions("block", "order").select("block", "cls")
        parts = dealt.mapInArrow(run, ", ".join(["at long", "weight double", *(f"{n} double" for n in names)]))
        sums = parts.groupBy("at").agg(*[F.sum(n).alias(n) for n in ("weight", *names)]).collect()
        if sums:
            rows = np.zeros_like(shared.value)
            for r in sums:
                rows[r.at] = np.array(r[2:]) / r.weight
            model.set_rows(rows)
        shared.unpersist()
    return model


def _normalisers(spark: SparkSession, model: LogBilinear) -> np.ndarray:
    shared, classes = spark.sparkContext.broadcast(model), model.shape.classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = shared.value.normalisers(b.column("id").to_numpy())
            yield pa.RecordBatch.from_pydict({"a": b.column("id"), "z": pa.array(list(out), pa.list_(pa.float32()))})

    out = np.empty((classes, classes), np.float32)
    for r in spark.range(0, classes, 1, 12).mapInArrow(run, "a long, z array<float>").collect():
        out[r.a] = r.z
    return out


def head_of(counts: DataFrame, most: int) -> tuple[list[Row], int]:
    """The words of counts(word, c) that occur at least so often that there are at most `most` of them, the most frequent first, and that least count: a power of two, found from a histogram."""
    sizes = {r.size: r.n for r in counts.groupBy(F.floor(F.log2("c")).cast("int").alias("size")).agg(F.count("*").alias("n")).collect()}
    least, total = max(sizes, default=-1) + 1, 0
    while least > 0 and total + sizes.get(least - 1, 0) <= most:
        least -= 1
        total += sizes.get(least, 0)
    return sorted(counts.where(F.col("c") >= (1 << least)).collect(), key=lambda r: (-r.c, bytes(r.word))), 1 << least


@dataclass(frozen=True)
class Fitted:
    """What scoring needs: the encoded texts, all word counts, and the model with its normalisers."""

    encoded: DataFrame
    counts: DataFrame
    least: int
    total: int
    kinds: int
    masses: dict[int, tuple[int, int]]
    vocabulary: object
    model: LogBilinear
    normalisers: np.ndarray


def fitted(docs: DataFrame, learn_from: Column, shape: Shape = Shape()) -> Fitted:
    """Count, encode and train over docs(doc_id, text); learn_from tells the rows that are learnt from."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), learn_from.alias("learnt_from"), F.xxhash64("doc_id", "text").alias("order"))
    counts = written(word_counts(rows.where("learnt_from")), "lm-counts")
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    blocks = max(1, round(total / shape.block))
    head, least = head_of(counts, shape.head)
    own = [bytes(r.word) for r in head[: shape.own]]
    # the shared classes' masses are counted over all words that have no class of their own
    outside = counts.where(~F.col("word").isin(own)) if own else counts
    cls = F.lit(shape.own) + F.crc32(F.substring("word", 1, 3)) % shape.shared
    masses = {r.cls: (r.mass, r.types) for r in outside.groupBy(cls.alias("cls")).agg(F.sum("c").alias("mass"), F.count("*").alias("types")).collect()}
    if not any(bytes(r.word) == END for r in head):
        head += counts.where(F.col("word") == F.lit(END)).collect() or [Row(word=END, c=0)]
    vocabulary = spark.sparkContext.broadcast(Vocabulary(head, shape, total, kinds, masses))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, row = vocabulary.value, TaskContext.get().partitionId() << 33
        tail_kind = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))
        for b in (whole.slice(i, 1000) for whole in batches for i in range(0, whole.num_rows, 1000)):
            out: dict = {n: [] for n in ("row", "n_tokens", "n_known", "base", "inside", "tail", "cls")}
            for text in b.column("text"):
                at, c, tail = v.lookup(text.as_py())
                known = at[at >= 0]
                for n, x in zip(out, (row, len(at), int((v.count[known] > 0).sum()), float(v.base[known].sum()), float(v.inside[known].sum()), [{"word": w, "n": n} for w, n in Counter(tail).items()], c.astype(np.int32)), strict=True):
                    out[n].append(x)
                row += 1
            kinds_of = {"base": pa.float64(), "inside": pa.float64(), "tail": tail_kind, "cls": pa.list_(pa.int32())}
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("doc_id", "learnt_from", "order")), *(pa.array(x, kinds_of.get(n, pa.int64())) for n, x in out.items())], ["doc_id", "learnt_from", "order", *out])

    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, learnt_from boolean, order long, row long, n_tokens long, n_known long, base double, inside double, tail array<struct<word:binary,n:bigint>>, cls array<int>"
    encoded = rows.select("doc_id", "text", "learnt_from", "order").mapInArrow(run, schema).withColumn("block", F.pmod("order", F.lit(blocks)).cast("int"))
    encoded = written(encoded, "lm-encoded")
    model = trained(encoded.where("learnt_from"), blocks, vocabulary, shape)
    return Fitted(encoded, counts, least, total, kinds, masses, vocabulary, model, _normalisers(spark, model))


def score_texts(docs: DataFrame, learn_from: Column, shape: Shape = Shape()) -> DataFrame:
    """(doc_id, learnt_from, n_tokens, n_known, train_tokens, base_score, score) of every row of docs(doc_id, text).

    learn_from tells the rows that the counts and the model come from. Scores are log10 probabilities of whole texts, however long, with their end: base_score
    under smoothed word counts, score under the model; over all known words and one unknown the model's probabilities after any two words sum to one. Null and empty texts have the end only. Nothing to learn
    from: base_score is 0 and score that of an untrained model. Repeated rows are all returned.
    """
    fit = fitted(docs, learn_from, shape)
    spark, total, kinds, masses = docs.sparkSession, fit.total, fit.kinds, fit.masses
    vocabulary, shared = fit.vocabulary, spark.sparkContext.broadcast((fit.model, fit.normalisers))
    kept = ["doc_id", "learnt_from", "row", "n_tokens", "n_known", "base", "inside"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, (m, z) = vocabulary.value, shared.value
        end, log = int(v.known[v.number[END]]), np.log(10)
        for b in batches:
            sums = []
            for x in b.column("cls"):
                c = x.values.to_numpy(zero_copy_only=False)
                before = np.concatenate([[end, end], c[:-1]])
                first, second = before[:-1], before[1:]
                s = (m.predict(first, second) * m.o[c]).sum(1) + m.bias[c] - z[first, second]
                sums.append(float(s.sum(dtype=np.float64)) / log)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in kept), pa.array(sums, pa.float64())], [*kept, "neural"])

    scored = fit.encoded.select(*kept, "cls").mapInArrow(run, fit.encoded.select(*kept).schema.add("neural", "double"))
    tails = fit.encoded.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.n")
    joined = tails.join(fit.counts.where(F.col("c") < fit.least), "word", "left")
    # the share of a class that a word has: looked up in a table of one row per shared class
    table = F.array(*[F.lit(float(masses.get(shape.own + i, (0, 0))[0] + 0.5 * (masses.get(shape.own + i, (0, 0))[1] + 1))) for i in range(shape.shared)])
    of_class = F.element_at(table, (F.crc32(F.substring("word", 1, 3)) % shape.shared + 1).cast("int"))
    c = F.coalesce("c", F.lit(0))
    per_row = joined.groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("known"),
        F.sum(F.col("n") * F.log10((c + 0.5) / (total + 0.5 * (kinds + 1)))).alias("tail_base"),
        F.sum(F.col("n") * F.log10((c + 0.5) / of_class)).alias("tail_inside"),
    )
    full = scored.join(per_row, "row", "left")
    zero = lambda x: F.coalesce(x, F.lit(0))
    return full.select(
        "doc_id", "learnt_from", "n_tokens", (F.col("n_known") + zero("known")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("tail_base")).alias("base_score"), (F.col("neural") + F.col("inside") + zero("tail_inside")).alias("score"),
    )
