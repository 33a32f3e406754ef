"""Exact top-k inner products by impact-ordered, score-at-a-time search.

Rows are indexed in blocks. Within a block each dimension is a posting list ordered by value and cut into segments of equal
quantised impact. A query takes the segments of all dimensions by descending impact, in groups that halve, and adds them to
accumulators; what is still to come bounds every row from above. Rows below the k-th exact score so far are out, and processing stops
once the few rows left are worth scoring: those, all possible members, are rescored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import drop_written, written

#: Components are cut into segments of 2**_SHIFT values.
_SHIFT = 4


#: Segments are taken in groups of falling impact: those of at least so many halves of the largest impact, then the rest.
_HALVES = 6


class ImpactIndex:
    """Posting lists of one block of integer vectors (rows x dimensions)."""

    def __init__(self, vectors: np.ndarray):
        self.exact = vectors.astype(np.float64)
        level = vectors >> _SHIFT
        self.low, self.high = level.min(0), level.max(0)
        self.order = np.argsort(level, axis=0, kind="stable").T.copy()
        steps = np.take_along_axis(level.T, self.order, axis=1) - self.low[:, None]
        self.steps = steps.astype(np.float64)
        # ends[d, j]: how many postings of a dimension lie below step j: where its segments begin
        every = np.arange(int((self.high - self.low).max(initial=0)) + 2)
        self.ends = np.stack([np.searchsorted(s, every) for s in steps]) if len(steps) else np.zeros((0, 2), np.int64)

    def search(self, query: np.ndarray, k: int, least: float) -> np.ndarray:
        """Rows that hold every one of the block's members of the top k, given that k rows with a score of at least least are known."""
        rows, _ = self.exact.shape
        q = query.astype(np.float64)
        up, size = q > 0, np.abs(q) * (1 << _SHIFT)
        span = self.high - self.low
        # a step of a dimension adds size to the score; the base is what all rows have at least, rounded up
        base = np.where(up, q * ((self.low << _SHIFT) + (1 << _SHIFT) - 1), q * (self.high << _SHIFT)).sum()
        upper, done = np.full(rows, base), np.where(up, rows, 0)
        possible, use = np.arange(rows), np.flatnonzero((size > 0) & (span > 0))
        up, size, span = up[use], size[use], span[use]
        impact = (size * span).max(initial=0.0)
        for halves in range(1, _HALVES + 2):
            floor = impact / 2**halves if halves <= _HALVES else 0.0
            step = np.minimum(np.maximum(1, np.ceil(floor / size)).astype(np.int64), span + 1)  # segments of fewer steps wait
            cut = np.where(up, self.ends[use, step], self.ends[use, np.maximum(0, span - step + 1)])
            which, gains = [], []
            for i in np.flatnonzero(cut != done[use]):
                d = use[i]
                part = slice(cut[i], done[d]) if up[i] else slice(done[d], cut[i])
                which.append(self.order[d, part])
                gains.append((self.steps[d, part] if up[i] else span[i] - self.steps[d, part]) * size[i])
            done[use] = cut
            rest = float((np.minimum(step - 1, span) * size).sum())
            if which:
                upper += np.bincount(np.concatenate(which), np.concatenate(gains), rows)
            if len(possible) > k:  # the k foremost, scored exactly, raise what a member must reach
                best = possible[np.argpartition(upper[possible], len(possible) - k)[len(possible) - k :]]
                least = max(least, float((self.exact[best] @ q).min()))
            possible = possible[upper[possible] + rest >= least]
            if len(possible) <= max(4 * k, rows // 32):
                break
        return possible


class Best:
    """The k best (score, id) of each query so far; of equal scores the smaller id, null ids last."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score: list[np.ndarray] = [np.empty(0)] * queries
        self.id: list[np.ndarray] = [np.empty(0, np.int64)] * queries

    def least(self, i: int) -> float:
        return float(self.score[i][-1]) if len(self.score[i]) == self.k else -np.inf

    def add(self, i: int, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score[i], score]), np.concatenate([self.id[i], ids])
        keep = np.lexsort((ids, -score))[: self.k]
        self.score[i], self.id[i] = score[keep], ids[keep]


def quantised(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, v): floor(scale * component) of vectors(vec_id, embedding); vectors that are null or have null or non-finite components, and rows without id, are left out."""

    def bad(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", bad)
    return vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    """Rows as integers; vectors of fewer dimensions are filled up with zeros, further dimensions have no partner and are cut."""
    flat, ends = column.flatten().to_numpy(), column.offsets.to_numpy() - column.offsets[0].as_py()
    lengths = np.diff(ends)
    if len(lengths) and (lengths == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(lengths), dims), np.int64)
    for i, (a, z) in enumerate(zip(ends, ends[1:], strict=False)):
        out[i, : min(dims, z - a)] = flat[a:z][:dims]
    return out


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, chunk: int = 65_536, block: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of the largest inner product with each query, the query's own id left out.

    rows and queries: (vec_id, v array<bigint>). Ties go to the smaller vec_id; of repeated rows each counts; queries that share an id
    count once. Scores are exact up to 2**53. Queries are dealt by a hash into chunks of about chunk vectors, the most that the driver holds or sends out at a time; every chunk
    passes over the rows where they lie, and only each task's k best of each query are shuffled. With several chunks what one has found is written before the next begins.
    """
    spark = rows.sparkSession
    distinct = written(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "topk-queries")
    total = distinct.count()
    parts, found = -(-total // chunk), []
    for i in range(parts):
        part = distinct.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == i).collect()
        if not part:
            continue
        matrix = np.zeros((len(part), max(1, *(len(r.v) for r in part), 1)), np.int64)
        for j, r in enumerate(part):
            matrix[j, : len(r.v)] = r.v
        shared = spark.sparkContext.broadcast((np.array([r.vec_id for r in part], np.int64), matrix))
        own = rows.select("vec_id", "v").mapInArrow(_searcher(shared, k, block), "query_id long, vec_id long, score long")
        if parts > 1:
            own = written(own, "topk")
            shared.unpersist()
        found.append(own)
    drop_written(spark, distinct)
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = found[0]
    for more in found[1:]:
        best = best.unionAll(more)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searcher(shared, k: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = shared.value
        best = Best(len(ids), k)

        def take(held: list[tuple[np.ndarray, np.ndarray]]) -> None:
            own, vectors = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            if not len(own):
                return
            index = ImpactIndex(vectors)
            for i, q in enumerate(matrix):
                at = index.search(q, k + 1, best.least(i))  # one more, for the query itself may be there
                at = at[own[at] != ids[i]]
                if len(at):
                    best.add(i, index.exact[at] @ q, own[at])

        held: list = []
        for b in batches:
            for at in range(0, b.num_rows, block):
                part = b.slice(at, block)
                held.append((part.column("vec_id").to_numpy(), _matrix(part.column("v"), matrix.shape[1])))
                if sum(len(x) for x, _ in held) >= block:
                    take(held)
                    held = []
        if held:
            take(held)
        for i in range(0, len(ids), 1000):
            some = range(i, min(i + 1000, len(ids)))
            yield pa.RecordBatch.from_pydict({
                "query_id": np.repeat(ids[some.start : some.stop], [len(best.id[j]) for j in some]),
                "vec_id": np.concatenate([best.id[j] for j in some]),
                "score": np.concatenate([best.score[j] for j in some]).astype(np.int64),
            })

    return run
