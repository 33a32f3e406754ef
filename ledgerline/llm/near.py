"""Near copies by shingle sets: SimHash deletion variants propose, the shingle sets themselves decide.

Rows with equal sets of shingles are one node. Nodes whose fingerprints meet under a variant and are close make up families (simhash.py). Within a
family every node is first compared, by exact Jaccard similarity, with the one by which most others were reached; nodes that this leaves
apart are compared with all the rest, block by block. So a family of copies costs about its size, a pair that links is never left out
within a family, and no task holds more than two blocks of sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import components, drop_written, written
from ledgerline.llm.simhash import cut, links, majority, remixed, shingle_hashes, with_least

#: Nodes of a block. Bits of a fingerprint that may differ, of those there are; bits of a segment.
BLOCK, WORDS, MAX_BITS, SEGMENT = 1024, 3, 48, 16


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """Distinct hashes, in order, of a text's shingles; none for a text without words."""
    return np.unique(shingle_hashes(text, words))


def _signed(docs: DataFrame, words: int) -> DataFrame:
    """(kept, row, node, w0, w1, ...) of every row: node tells the set of shingles (0: the empty one), w the fingerprints of the set."""
    names = [f"w{k}" for k in range(WORDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            sets = [shingle_set(t.as_py(), words) for t in b.column("text")]
            nodes = pa.array([xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63) if s.size else 0 for s in sets], pa.int64())
            bits = [pa.array([majority(remixed(s, k)) for s in sets], pa.int64()) for k in range(WORDS)]
            yield pa.RecordBatch.from_arrays([b.column("kept"), b.column("row"), nodes, *bits], ["kept", "row", "node", *names])

    picked = docs.select(F.struct(*docs.columns).alias("kept"), F.monotonically_increasing_id().alias("row"), F.col("text").cast("binary").alias("text"))
    schema = picked.drop("text").schema.add("node", "long")
    for n in names:
        schema = schema.add(n, "long")
    return picked.mapInArrow(run, schema)


class Cell:
    """Sets of a block of nodes (left) held against those of another (right): the links found between different parts, without those that others imply."""

    def __init__(self, left: list[tuple], right: list[tuple], least: float):
        self.left, self.right, self.least = left, right, least
        sets = [np.frombuffer(r[-1], np.uint64) for r in (*left, *right)]
        _, at = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum([len(s) for s in sets])
        self.items = np.split(at, ends[:-1])
        self.sizes = np.array([len(s) for s in sets[len(left) :]])
        self.flat = np.concatenate(self.items[len(left) :])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.mark = np.zeros(len(at) and int(at.max()) + 1, bool)
        self.root: dict[int, int] = {}

    def _root(self, x: int) -> int:
        while (y := self.root.get(x, x)) != x:
            self.root[x] = self.root.get(y, y)
            x = y
        return x

    def edges(self) -> Iterator[tuple[int, int]]:
        for i, (a, part, _) in enumerate(self.left):
            own = self.items[i]
            self.mark[own] = True
            both = np.add.reduceat(self.mark[self.flat], self.starts, dtype=np.int64)
            self.mark[own] = False
            for j in np.flatnonzero(both >= self.least * (self.sizes + len(own) - both)):
                b, other, _ = self.right[j]
                x, y = self._root(part), self._root(other)
                if a != b and x != y:
                    self.root[x] = y
                    yield a, b


def _compared(cells: DataFrame, least: float) -> DataFrame:
    """Edges (a, b) of cells(cell, side, node, part, items): within each cell nodes of side 0 are held against those of side 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(n).to_pylist() for n in ("cell", "side", "node", "part", "items")), strict=True))
        for _, own in groupby(rows, key=lambda r: r[0]):
            sides: tuple[list, list] = ([], [])
            for _, side, *r in own:
                sides[side].append(tuple(r))
            if sides[0] and sides[1]:
                a, b = zip(*found, strict=True) if (found := list(Cell(*sides, least).edges())) else ((), ())
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long")


def _sets(prints: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, items) of nodes(node, row): the set of shingles as bytes, from the text of that row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([shingle_set(t.as_py(), words).tobytes() for t in b.column("text")], pa.binary())], ["node", "items"])

    texts = prints.select("row", F.col("kept.text").cast("binary").alias("text")).join(nodes.select("node", "row"), "row")
    return texts.select("node", "text").mapInArrow(run, "node long, items binary")


def _linked(prints: DataFrame, nodes: DataFrame, words: int, least: float) -> DataFrame:
    """(node, component) of all nodes that link to others."""
    spark = prints.sparkSession
    names = [f"w{k}" for k in range(WORDS)]
    segments = cut(list(range(64 * WORDS)), 64 * WORDS // SEGMENT)
    others = [[s for s in segments if s is not own] for own in segments]
    close = links(nodes.where("node <> 0").select("node", *names), MAX_BITS, segments, others)
    family = components(close, "near-families")
    reached = close.groupBy(F.col("via").alias("node")).agg(F.count("*").alias("n"))
    members = family.withColumnRenamed("component", "family").join(reached, "node", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    members = written(members.join(_sets(prints, nodes.select("node", F.col("low.row").alias("row")), words), "node"), "near-members")
    leads = written(members.groupBy("family").agg(F.count("*").alias("size"), F.max_by("node", F.struct("n", "node")).alias("lead")), "near-leads")
    both = members.join(leads, "family")
    salts = F.ceil(F.col("size") / BLOCK).cast("int")
    salt = F.pmod(F.xxhash64("node"), salts).cast("int")
    part = F.col("node").alias("part")
    right = both.where("node <> lead").select(F.xxhash64("family", salt).alias("cell"), F.lit(1).alias("side"), "node", part, "items")
    left = both.where("node = lead").select("family", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), "node", "items")
    stars = written(_compared(left.select(F.xxhash64("family", "salt").alias("cell"), F.lit(0).alias("side"), "node", part, "items").unionAll(right), least), "near-stars")
    # what no lead holds is compared with all but the lead
    star = stars.select(F.col("b").alias("node"), F.lit(True).alias("held"))
    parts = both.where("node <> lead").join(star, "node", "left").withColumn("held", F.coalesce("held", F.lit(False)))
    loose = parts.where("not held").groupBy("family").agg(F.count("*").alias("loose"))
    parts = written(parts.join(loose, "family").where("size > 2").select("family", "node", "held", "items", F.when(F.col("held"), F.col("lead")).otherwise(F.col("node")).alias("part"), salts.alias("columns"), F.ceil(F.col("loose") / BLOCK).cast("int").alias("rows")), "near-parts")
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    down = parts.where("not held").select("family", block("rows").alias("i"), every("columns").alias("j"), F.lit(0).alias("side"), "node", "part", "items")
    across = parts.select("family", every("rows").alias("i"), block("columns").alias("j"), F.lit(1).alias("side"), "node", "part", "items")
    rest = written(_compared(down.unionAll(across).select(F.xxhash64("family", "i", "j").alias("cell"), "side", "node", "part", "items"), least), "near-rest")
    of = components(stars.unionAll(rest), "near-components")
    drop_written(spark, close, members, leads, stars, parts, rest)
    return of


def _grouped(docs: DataFrame, words: int, least: float) -> tuple[DataFrame, DataFrame]:
    """prints (kept, row, node, ...) of all rows, and (node, low, least) of all nodes: the smallest (null last) id with its row, of the node and of its component."""
    prints = written(_signed(docs, words), "near")
    low = F.struct(F.col("kept.doc_id").isNull().alias("none"), F.col("kept.doc_id").alias("doc_id"), "row")
    nodes = written(prints.groupBy("node").agg(F.min(low).alias("low"), *[F.min(f"w{k}").alias(f"w{k}") for k in range(WORDS)]), "near-nodes")
    return prints, with_least(nodes.select("node", "low"), _linked(prints, nodes, words, least))


def near_texts(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """(kept, node, component_id) of every row of docs(doc_id, text, ...); kept holds the row itself.

    Rows link where the Jaccard similarity of their sets of ``words``-word shingles is at least ``least`` (a shorter text is one shingle), exactly, if the search proposes
    them: some of 12 segments of 16 bits differs in at most one bit. At a similarity of 0.8 that misses one pair in fifty
    (in eight, where texts have about five shingles), above it fewer; the tests measure it. component_id is the smallest doc_id that can be reached;
    null only where all ids of the component are null. Texts without words are one component. Repeated rows are all returned.
    """
    prints, nodes = _grouped(docs, words, least)
    return prints.select("kept", "node").join(nodes.select("node", F.col("least.doc_id").alias("component_id")), "node").select("kept", "node", "component_id")


def one_of_each(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """docs with one row of every component of near_texts(): that of the smallest doc_id, null last, and of several the first read."""
    prints, nodes = _grouped(docs, words, least)
    return prints.join(nodes.select(F.col("least.row").alias("row")).distinct(), "row", "left_semi").select("kept.*")
