"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints are cut into few segments, so that of two that are close some segment differs in at most one bit. Every segment is indexed once
per bit with that bit struck out (a one-wildcard variant); equal variants meet in a sorted partition, the bits are compared, and what links
is given as the edges of a spanning forest per variant, never as all pairs of a group. A variant that very many share is dealt out anew by
variants of the other bits as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import components, drop_written, written

#: Row b, column i: bit i of byte b.
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)
_OFFSETS = np.arange(8, dtype=np.int32) * 256
#: A variant that more members share is dealt out anew; up to SMALL members all pairs are compared at once.
HOT, SMALL = 65_536, 64


def shingle_hashes(text: bytes | None, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of a text's shingles, repeats included. A-Z are lower-cased, words are runs of other characters than ASCII white space, shingles are ``words``
    words joined by a space. Fewer words: the whole sequence is the one shingle. No words (null, empty or blank text): none."""
    import xxhash

    seq = text.lower().split() if text else []
    if not seq:
        return np.empty(0, np.uint64)
    if len(seq) <= words:
        shingles, n = [b" ".join(seq)], 1
    else:
        shingles, n = map(b" ".join, zip(*(islice(seq, i, None) for i in range(words)), strict=False)), len(seq) - words + 1
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of hashes, as a signed 64-bit integer: bits that are set in over half of them; of none 0."""
    if not hashes.size:
        return 0
    counts = np.bincount((hashes.astype("<u8").view(np.uint8).reshape(-1, 8) + _OFFSETS).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits(counts.ravel() * 2 > len(hashes), bitorder="little").tobytes(), "little", signed=True)


def remixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th of a family of hashes of the same items; the first are the given ones."""
    if not k:
        return hashes
    z = hashes * np.uint64(2 * k + 1) + np.uint64(0x9E3779B97F4A7C15 * k % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprint(text: bytes | None, words: int, seed: int = 42) -> int:
    """SimHash, as a signed 64-bit integer, of the XXH64 values of a text's shingles; without words 0."""
    return majority(shingle_hashes(text, words, seed))


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) of every row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([fingerprint(x.as_py(), words, seed) for x in b.column("text")], pa.int64())], ["doc_id", "fp"])

    picked = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, fp long")


def cut(bits: list[int], segments: int) -> list[list[int]]:
    """Positions of bits, cut into segments of about equal length."""
    at = [len(bits) * s // segments for s in range(segments + 1)]
    return [bits[lo:hi] for lo, hi in zip(at, at[1:], strict=False)]


def variants(segment: list[int], words: int) -> list[tuple[int, ...]]:
    """One mask per bit of a segment: the segment without the bit, as a signed 64-bit integer for each word."""

    def mask(bits: list[int]) -> tuple[int, ...]:
        sums = [sum(1 << (b % 64) for b in bits if b // 64 == w) for w in range(words)]
        return tuple(m - (1 << 64) if m >> 63 else m for m in sums)

    return [mask([b for b in segment if b != struck]) for struck in segment]


def variant_masks(segments: int) -> list[int]:
    """The masks of 64 bits in segments."""
    return [m for s in cut(list(range(64)), segments) for (m,) in variants(s, 1)]


def _differing(prints: list[np.ndarray], i, j) -> np.ndarray:
    """Differing bits of rows i and j, over all words."""
    return sum(np.bitwise_count(p[i] ^ p[j]).astype(np.int16) for p in prints)


def _forest(prints: list[np.ndarray], max_bits: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first member, member, those that it reaches) of the components of the link graph within one variant's members: each member is compared with those not yet reached."""
    rest = np.arange(len(prints[0]))
    while rest.size:
        root, rest = rest[0], rest[1:]
        stack = [root]
        while stack and rest.size:
            u = stack.pop()
            near = _differing(prints, rest, u) <= max_bits
            if near.any():
                yield root, u, rest[near]
                stack.extend(rest[near])
                rest = rest[~near]


def _edges(sig: np.ndarray, prints: list[np.ndarray], max_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, within runs of equal sig: the first member of a component, another, and the one that reached it. Small runs are compared all at once; only those with a link
    are gone through one by one."""
    starts = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
    sizes = np.diff(np.r_[starts, len(sig)])
    linked = sizes > SMALL
    a, z, via = [], [], []
    run = np.repeat(np.arange(len(starts)), sizes)
    inside = np.flatnonzero(~linked[run])
    for step in range(1, min(SMALL, int(sizes.max(initial=1)))):
        inside = inside[inside + step < len(sig)]
        inside = inside[run[inside] == run[inside + step]]
        if not inside.size:
            break
        at = inside[_differing(prints, inside, inside + step) <= max_bits]
        pairs = sizes[run[at]] == 2
        a.append(at[pairs])
        z.append(at[pairs] + step)
        via.append(at[pairs])
        linked[run[at[~pairs]]] = True
    for s, m in zip(starts[linked], sizes[linked], strict=True):
        for root, u, found in _forest([p[s : s + m] for p in prints], max_bits):
            a.append(np.full(len(found), s + root))
            z.append(s + found)
            via.append(np.full(len(found), s + u))
    return tuple(np.concatenate([np.empty(0, np.int64), *x]) for x in (a, z, via))


def _met(index: DataFrame, names: list[str], max_bits: int, hot: int | None) -> DataFrame:
    """(a, b, via, sig, node, words...) of index(sig, node, words...): what links() returns of the nodes that meet under a sig, or, with a sig, the rows of those that more than hot share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        full = None

        def passed(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
            none = pa.nulls(len(rows["sig"]), pa.int64())
            return pa.RecordBatch.from_pydict({"a": none, "b": none, "via": none} | {n: pa.array(rows[n]) for n in rows})

        for b in _and_end(batches):
            now = {n: np.asarray(b.column(n)) for n in b.schema.names} if b is not None else {}
            if full is not None and now and len(now["sig"]):
                n = int(np.argmax(now["sig"] != full)) if now["sig"][-1] != full else len(now["sig"])
                if n:
                    yield passed({k: v[:n] for k, v in now.items()})
                    now = {k: v[n:] for k, v in now.items()}
                if not len(now["sig"]):
                    continue
                full = None
            now = {n: np.concatenate([held[n], now[n]]) for n in held} if held and now else now or held
            if not now or not len(now["sig"]):
                continue
            sig = now["sig"]
            last = len(sig) if b is None else int(np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])[-1])
            done, held = {n: v[:last] for n, v in now.items()}, {n: v[last:] for n, v in now.items()}
            if hot is not None and len(held["sig"]) > hot:
                full = held["sig"][0]
                yield passed(held)
                held = {}
            if last:
                a, z, via = _edges(done["sig"], [done[n].view(np.uint64) for n in names], max_bits)  # bits of signed numbers are counted in their absolute value
                none = pa.nulls(len(a), pa.int64())
                yield pa.RecordBatch.from_pydict({"a": pa.array(done["node"][a]), "b": pa.array(done["node"][z]), "via": pa.array(done["node"][via]), "sig": none, "node": none} | dict.fromkeys(names, none))

    dealt = index.repartition("sig").sortWithinPartitions("sig", "node")
    return dealt.mapInArrow(run, ", ".join(f"{n} long" for n in ("a", "b", "via", "sig", "node", *names)))


def _and_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def _signed(rows: DataFrame, names: list[str], kept: list[str], masks: list[tuple[int, tuple[int, ...]]]) -> Column:
    which = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), *[F.lit(m).alias(f"m{k}") for k, m in enumerate(mask)]) for i, mask in masks])).alias("v")
    sig = F.xxhash64("v.i", *kept, *[F.col(n).bitwiseAND(F.col(f"v.m{k}")) for k, n in enumerate(names)])
    return rows.select("*", which).select(sig.alias("sig"), "node", *names)


def links(prints: DataFrame, max_bits: int, segments: list[list[int]], rest: list[list[list[int]]], hot: int | None = HOT) -> DataFrame:
    """(a, b, via) of nodes of prints(node, and a long for each word of the fingerprints): the components of what meets under a variant and is within max_bits. a is a component's smallest node, b another one of
    it, and via the node within max_bits of b that it was reached by; so the pairs (a, b) of a family under all its variants are few different ones.

    segments: bit positions; two nodes meet where they differ in at most one bit of a segment. rest: for each segment further segments outside of it, by whose variants
    its variants are dealt out where more than hot nodes share one. If that cuts off no pair (as by cut() of all other bits into
    max_bits // 2 + 1), all pairs within max_bits that meet are linked. The result is written; drop_written() it after use.
    """
    names = [c for c in prints.columns if c != "node"]
    first = [(s, mask) for s, segment in enumerate(segments) for mask in variants(segment, len(names))]
    index = _signed(prints, names, [], [(i, mask) for i, (_, mask) in enumerate(first)])
    found = written(_met(index, names, max_bits, hot), "simhash-links")
    crowded = found.where("sig is not null")
    if hot is None or crowded.isEmpty():
        return found.where("sig is null").select("a", "b", "via")
    # the segment that a crowded variant belongs to is found again from the node: its variants have that sig
    own = F.lit(None).cast("int")
    for i, (s, mask) in enumerate(first):
        own = F.when(F.xxhash64(F.lit(i), *[F.col(n).bitwiseAND(F.lit(m)) for n, m in zip(names, mask, strict=True)]) == F.col("sig"), s).otherwise(own)
    crowded = crowded.select("sig", "node", *names, own.alias("own"))
    parts = []
    for s in range(len(segments)):
        further = [mask for segment in rest[s] for mask in variants(segment, len(names))]
        parts.append(_signed(crowded.where(F.col("own") == s), names, ["sig"], list(enumerate(further))))
    more = parts[0]
    for p in parts[1:]:
        more = more.unionAll(p)
    again = written(_met(more, names, max_bits, None), "simhash-links")
    return found.where("sig is null").select("a", "b", "via").unionAll(again.select("a", "b", "via"))


def with_least(nodes: DataFrame, of: DataFrame, salts: int = 64) -> DataFrame:
    """nodes(node, low, ...) with least, the least low of the component: of(node, component) has those of linked nodes. A large component's rows are spread over salts."""
    linked = nodes.join(of, "node", "left")
    least = linked.where("component is not null").groupBy("component").agg(F.min("low").alias("least"))
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    some = linked.where("component is not null").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(salts)).cast("int")).join(least, ["component", "salt"]).drop("salt")
    return some.select(*nodes.columns, "least").unionByName(linked.where("component is null").select(*nodes.columns, F.col("low").alias("least")))


def near_duplicates(docs: DataFrame, words: int = 3, max_bits: int = 3, hot: int = HOT) -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs(doc_id, text).

    Two rows link where their fingerprints differ in at most max_bits bits; all such pairs are found. component_id is the smallest doc_id that can be reached, the row's own included; null
    only where all ids of the component are null. Equal texts have equal fingerprints and so always link; texts without
    words have fingerprint 0. Repeated rows are returned as often as they occur; long texts are read whole. A variant that more than hot fingerprints share is
    dealt out by the variants of the other bits.
    """
    prints = written(fingerprints(docs, words), "simhash")
    # exact copies meet here, summed up before the shuffle
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("low")).withColumnRenamed("fp", "node"), "simhash-nodes")
    parts = max_bits // 2 + 1
    segments = cut(list(range(64)), parts)
    outside = [[b for b in range(64) if b not in set(s)] for s in segments]
    edges = links(nodes.select("node", F.col("node").alias("w0")), max_bits, segments, [cut(o, parts) if o else [] for o in outside], hot if parts > 1 else None)
    of = components(edges, "simhash-components")
    drop_written(docs.sparkSession, edges)
    final = with_least(nodes, of).select(F.col("node").alias("fp"), F.col("least").alias("component_id"))
    return prints.join(final, "fp").select("doc_id", "fp", "component_id")
