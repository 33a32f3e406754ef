"""Ranked search of texts by words: a blocked product of sparse matrices, items by terms and terms by documents.

The first matrix holds how often each item has a term (or that it has it), the second what each document's term adds to a score, as whole numbers of 64 bits. Documents are read once and become
rows of term numbers and counts, which are written; then blocks of them are turned into rows of terms, and a row of the product is made by Gustavson's method: the rows of an item's terms, each times its
multiplicity, are merged into one row of accumulators over the block's documents. Of a block only the best documents of each item are kept, of a task those of its blocks, and these few are ranked together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import LOWER, UPPER, drop_written, written

#: A block has so many documents and, but for one document of more, so many postings.
BLOCK, POSTINGS = 8192, 1 << 21

# letters A to Z in lower case; ASCII that is neither letter nor digit parts terms
_TERMS = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of other characters, A to Z in lower case."""
    return text.translate(_TERMS).split()


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, times) of items(item_id, text); rows that share an id are one item, those without one too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                found = [terms(t) for t in part.column(1).to_pylist()]
                item = part.column(0).take(pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found])))
                yield pa.RecordBatch.from_arrays([item, pa.array([t for x in found for t in x], pa.binary())], ["item_id", "term"])

    rows = items.where("text is not null").select("item_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"item_id {rows.schema['item_id'].dataType.simpleString()}, term binary").groupBy("item_id", "term").agg(F.count("*").alias("times"))


def postings(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, term array, tf array) of docs(doc_id, text): the number of all terms, and how often each term of `numbers` occurs, if it does. Documents without a term are left out."""
    shared = docs.sparkSession.sparkContext.broadcast(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        width = len(known) + 1
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                found = [np.fromiter(map(known.get, terms(t), repeat(-1)), np.int64) for t in part.column(1).to_pylist()]
                n = np.array([len(x) for x in found], np.int64)
                flat = np.concatenate(found) if found else np.zeros(0, np.int64)
                key = (np.repeat(np.arange(len(found)) * width, n) + flat)[flat >= 0]
                pair, tf = np.unique(key, return_counts=True)
                ends = np.searchsorted(pair, np.arange(len(found) + 1) * width).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v.astype(np.int32))) for v in (pair % width, tf)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), *lists], ["doc_id", "n", "term", "tf"])

    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n bigint, term array<int>, tf array<int>").where("n > 0")


class Best:
    """The k best (score, document) of each item so far; equal scores by document, null last."""

    def __init__(self, items: int, k: int):
        self.k, self.found = k, [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))] * items

    def add(self, item: int, score: np.ndarray, doc: np.ndarray, lost: np.ndarray) -> None:
        score, doc, lost = (np.concatenate(x) for x in zip(self.found[item], (score, doc, lost), strict=True))
        keep = np.lexsort((doc, lost, -score))[: self.k]
        self.found[item] = score[keep], doc[keep], lost[keep]

    def least(self, item: int) -> int:
        """What a further document must reach."""
        score = self.found[item][0]
        return int(score[-1]) if len(score) == self.k else 1


class Items:
    """The matrix of items by terms: rows in numbers of terms with their multiplicities."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        self.rows = rows

    def multiply(self, term: np.ndarray, column: np.ndarray, value: np.ndarray, n_terms: int, doc: np.ndarray, lost: np.ndarray, best: Best) -> None:
        """Merge a block, given as postings (term, column, value) of columns doc, into the best of each item."""
        order = np.argsort(term, kind="stable")
        column, value = column[order], value[order]
        begin = np.searchsorted(term[order], np.arange(n_terms + 1)).tolist()
        row = np.zeros(len(doc), np.int64)
        for item, (own, times) in enumerate(self.rows):
            row[:] = 0
            for t, m in zip(own.tolist(), times.tolist(), strict=True):
                a, z = begin[t], begin[t + 1]
                if a < z:  # a document stands once in a term's row
                    row[column[a:z]] += value[a:z] * m if m != 1 else value[a:z]
            least = best.least(item)
            if len(doc) > best.k:
                least = max(least, int(np.partition(row, len(doc) - best.k)[len(doc) - best.k]))
            good = np.flatnonzero(row >= least)
            if len(good):
                best.add(item, row[good], doc[good], lost[good])


def _multiplied(shared, lengths: tuple[int, int], saturation: int, share: int, k: int):
    """The product of the items with the documents of a task, in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, weight = shared.value
        items, best = Items(rows), Best(len(ids), k)
        n_docs, n_all = lengths

        def block(part: pa.RecordBatch) -> None:
            doc, lost = part.column(0).fill_null(0).to_numpy(), part.column(0).is_null().to_numpy(zero_copy_only=False)
            m = saturation - share + (share * part.column(1).to_numpy() * n_docs) // n_all
            term, tf = (part.column(c).flatten().to_numpy().astype(np.int64) for c in (2, 3))
            column = np.repeat(np.arange(len(doc)), np.diff(part.column(2).offsets.to_numpy()))
            value = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[column]))
            items.multiply(term, column, value, len(weight), doc, lost, best)

        for b in batches:
            at, ends = 0, b.column(2).offsets.to_numpy()
            while at < b.num_rows:
                to = max(at + 1, min(at + BLOCK, int(np.searchsorted(ends, ends[at] + POSTINGS, "right")) - 1))
                block(b.slice(at, to - at))
                at = to
        for i in range(0, len(ids), 1000):
            some = range(i, min(i + 1000, len(ids)))
            yield pa.RecordBatch.from_arrays([
                ids.take(pa.array(np.repeat(np.arange(some.start, some.stop), [len(best.found[j][0]) for j in some]))),
                pa.array(np.concatenate([best.found[j][1] for j in some]), mask=np.concatenate([best.found[j][2] for j in some])),
                pa.array(np.concatenate([best.found[j][0] for j in some])),
            ], ["item_id", "doc_id", "score"])

    return run


def ranked_documents(docs: DataFrame, items: DataFrame, k: int = 10, once: bool = True, chunk_terms: int = 1 << 18) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of docs(doc_id, text) with the highest scores above 0 for each item of items(item_id, text).

    A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))) of N documents with terms; a document of n of all L terms adds weight * (10**9 tf div (1000 tf + 8 m)) with m = 10 + 90 n N div L for each term
    of the item, once or, if not `once`, as often as the item has it. Equal scores go by doc_id, those without id last; repeated rows each count; null and empty texts have no terms.
    Items are dealt by a hash into chunks of about chunk_terms terms (or one item of more), the most that the driver holds or sends out at a time; each chunk passes over the documents once.
    """
    spark = docs.sparkSession
    of_items = written(item_terms(items), "ranked-items")
    kind = of_items.schema["item_id"].dataType.simpleString()
    parts, found = max(1, -(-of_items.count() // chunk_terms)), []
    for i in range(parts):
        own = of_items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == i).toArrow()
        if not own.num_rows:
            continue
        coded = own.column("term").combine_chunks().dictionary_encode()
        names = coded.dictionary.to_pylist()
        matrix = written(postings(docs, {t: j for j, t in enumerate(names)}), "ranked-postings")
        n_docs, n_all = matrix.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(names), np.int64)
        for r in matrix.select(F.explode("term").alias("term")).groupBy("term").count().toLocalIterator():
            df[r["term"]] = r["count"]
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        by_item: dict[object, list[tuple[int, int]]] = {}
        for item, term, times in zip(own.column("item_id").to_pylist(), coded.indices.to_pylist(), own.column("times").to_pylist(), strict=True):
            by_item.setdefault(item, []).append((term, 1 if once else times))
        rows = [(np.array([t for t, _ in x], np.int64), np.array([m for _, m in x], np.int64)) for x in by_item.values()]
        shared = spark.sparkContext.broadcast((pa.array(list(by_item), own.schema.field("item_id").type), rows, weight))
        best = written(matrix.mapInArrow(_multiplied(shared, (n_docs, max(1, n_all)), 100, 90, k), f"item_id {kind}, doc_id bigint, score bigint"), "ranked-best")
        shared.unpersist()
        drop_written(spark, matrix)
        found.append(best)
    drop_written(spark, of_items)
    if not found:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    best = found[0]
    for more in found[1:]:
        best = best.unionAll(more)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
