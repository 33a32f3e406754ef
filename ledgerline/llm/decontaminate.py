"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Test strings are windows of consecutive benchmark words. A shift table tells, for the last two words read, how far the
search may skip; where it may not skip, the bucket of that suffix names the few test strings that can end
here, and a direct comparison confirms them. Search runs inside map tasks over whole texts: nothing is shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from ledgerline.llm.common import drop_written, written

#: Rows that are searched and passed on at a time.
ROWS = 500
#: A-Z to a-z, other ASCII but a-z and 0-9 to a space; bytes of non-ASCII characters stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def word_list(text: bytes | None) -> list[bytes]:
    """Lower-cased words: runs of ASCII letters, digits and non-ASCII characters."""
    return text.translate(_FOLD).split() if text else []


def windows(words: list[bytes], size: int) -> Iterator[tuple[bytes, ...]]:
    """All runs of size words; of fewer words, but not none, the one run of all."""
    return (tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else iter(())


class Searcher:
    """Wu-Manber tables, one set for each length of test string, so that short strings don't shorten the skips of long ones."""

    def __init__(self, patterns: dict[tuple[bytes, ...], set[str]]):
        self.tables = []
        by_length = defaultdict(list)
        for p in patterns:
            by_length[len(p)].append(p)
        for m, group in sorted(by_length.items()):
            block = min(2, m)
            shift: dict = {}
            buckets: dict = {}
            for p in group:
                for end in range(block, m + 1):
                    key = p[end - block : end]
                    shift[key] = min(m - end, shift.get(key, m))
                buckets.setdefault(p[m - block :], []).append((p, sorted(patterns[p])))
            self.tables.append((m, block, m - block + 1, shift, buckets))

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(start, end) of every occurrence, end exclusive, and the items of the strings found."""
        spans, items, n = [], set(), len(words)
        for m, block, skip, shift, buckets in self.tables:
            end, shift_of = m, shift.get
            while end <= n:
                key = (words[end - 2], words[end - 1]) if block == 2 else (words[end - 1],)
                step = shift_of(key, skip)
                if step:
                    end += step
                    continue
                start = end - m
                for p, own in buckets[key]:
                    if p[0] == words[start] and list(p) == words[start:end]:
                        spans.append((start, end))
                        items.update(own)
                end += 1
        return spans, items


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans as disjoint spans in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_FOUND = StructType().add("n_words", "long").add("hits", ArrayType(StructType().add("start", "long").add("end", "long"))).add("items", ArrayType(StringType()))
_HITS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def window_table(benchmark: DataFrame, window: int) -> DataFrame:
    """(words binary, items array<string>): the distinct test strings of benchmark(item_id, text), words joined by spaces, with the ids of their items. An item without id has test strings, but no id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(b" ".join(w), item.as_py()) for item, text in zip(b.column("item"), b.column("text"), strict=True) for w in windows(word_list(text.as_py()), window)]
            words, items = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_pydict({"words": pa.array(words, pa.binary()), "item": pa.array(items, pa.string())})

    items = benchmark.where("text is not null").select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text"))
    return items.mapInArrow(run, "words binary, item string").groupBy("words").agg(F.collect_set("item").alias("items"))


def find_passages(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_windows: int = 200_000, columns: list[str] | None = None) -> DataFrame:
    """(kept, n_words, hits, items) for every row of docs(doc_id, text, ...), against benchmark(item_id, text); kept holds the given columns (doc_id).

    hits: disjoint word spans (start, end exclusive) that lie in occurrences of test strings; items: sorted ids, as strings, of the items
    those strings come from. Null and empty texts have no words; items without words have no strings; those of an item without id are hits of no listed item; repeated
    rows are all returned, long texts are searched whole. No task and not the driver hold more than about max_windows test strings: those of a larger benchmark are dealt
    out by a hash, and each share is searched for in a pass of its own, whose result is written before the next.
    """
    spark = docs.sparkSession
    strings = written(window_table(benchmark, window), "test-strings")
    parts = max(1, -(-strings.count() // max_windows))

    def pass_over(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = shared.value
            for b in (whole.slice(i, ROWS) for whole in batches for i in range(0, whole.num_rows, ROWS)):
                counts, hits, found = [], [], []
                texts = pc.struct_field(b.column("kept"), "text").cast(pa.binary()) if within else b.column("text")
                for text, old_hits, old_items in zip(texts, b.column("hits"), b.column("items"), strict=True):
                    words = word_list(text.as_py())
                    spans, own = search.find(words)
                    if len(old_hits):
                        spans += [(h["start"], h["end"]) for h in old_hits.as_py()]
                        own |= set(old_items.as_py())
                    counts.append(len(words))
                    hits.append([{"start": s, "end": e} for s, e in merged(spans)])
                    found.append(sorted(own))
                out = [pa.array(counts, pa.int64()), pa.array(hits, _HITS), pa.array(found, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([b.column(n) for n in kept] + out, [*kept, "n_words", "hits", "items"])

        return run

    within = "text" in (columns or [])  # then the texts go to Python once, not twice
    own_text = [] if within else [F.col("text").cast("binary").alias("text")]
    at = docs.select(F.struct(*(columns or ["doc_id"])).alias("kept"), *own_text, F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("hits"), F.expr("cast(array() as array<string>)").alias("items"))
    for i in range(parts):
        last = i == parts - 1
        kept = ["kept"] if last or within else ["kept", "text"]
        own = strings.where(F.pmod(F.xxhash64("words"), F.lit(parts)) == i)
        shared = spark.sparkContext.broadcast(Searcher({tuple(bytes(r.words).split(b" ")): set(r.items) for r in own.collect()}))
        now = at.mapInArrow(pass_over(shared), StructType([*at.select(*kept).schema.fields, *_FOUND.fields]))
        if not last:
            now = written(now, "passages")
            if i:
                drop_written(spark, at)
            shared.unpersist()
        at = now
    drop_written(spark, strings)
    return at


def digests(found: DataFrame) -> DataFrame:
    """The counts and the item digest of find_passages()."""
    return found.select(
        "kept.doc_id",
        "n_words",
        F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["end"] - h["start"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )
