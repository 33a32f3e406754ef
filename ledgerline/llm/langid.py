"""Language identification by compression: the language whose sample compresses a text best.

Every language has a zstandard raw-content dictionary, cut from texts of that language. A text is compressed whole with each of them, and the smallest
result wins. Where the two smallest are close, slower compressors with the same dictionaries decide; where those
are close too, the text is rejected (the prediction stays, marked).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII letters and bytes of other characters stay; digits, signs and white space become a space.
_LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def plain_letters(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS).split())


def dictionaries(labelled: DataFrame, dict_bytes: int = 100_000, piece: int = 2000, slots: int = 256, total_bytes: int = 32 << 20) -> dict[str, bytes]:
    """Raw content per language of labelled(text, lang), the most frequent language first.

    A bounded sample: texts fall into `slots` slots by their hash, so that copies share one; each slot gives at most `piece` characters of
    one text. Hashes choose the text and where it is cut, so that what it says has no part in it. A dictionary has at most dict_bytes, all together at
    most total_bytes, and the driver holds no more than that and one partition. Rows with a null in text or lang are left out.
    """
    labelled = labelled.where("text is not null and lang is not null")
    size = min(dict_bytes, total_bytes // max(1, labelled.agg(F.countDistinct("lang")).first()[0]))
    start = F.pmod(F.xxhash64("text", F.lit(11)), F.greatest(F.length("text") - piece, F.lit(0)) + 1).cast("int") + 1
    rows = labelled.select("lang", F.pmod(F.xxhash64("text"), F.lit(slots)).alias("slot"), F.xxhash64("text", F.lit(7)).alias("rank"), F.substring("text", start, F.lit(piece)).alias("piece"))
    chosen = rows.groupBy("lang", "slot").agg(F.max_by("piece", "rank").alias("piece"), F.count("*").alias("n"))
    contents: dict[str, bytes] = {}
    counts: dict[str, int] = {}
    for r in chosen.repartition("lang").sortWithinPartitions("lang", "slot").toLocalIterator():
        counts[r.lang] = counts.get(r.lang, 0) + r.n
        before = contents.get(r.lang)
        if before is None or len(before) < size:
            now = plain_letters(r.piece)
            contents[r.lang] = (now if before is None else before + b" " + now)[:size]
    return {lang: contents[lang] for lang in sorted(contents, key=lambda x: (-counts[x], x))}


class Classifier:
    def __init__(self, contents: dict[str, bytes], close: float, narrow: float):
        import zstandard

        def compressors(level: int, **more) -> list:
            out = []
            for content in contents.values():
                how = zstandard.ZstdCompressionParameters.from_level(level, write_content_size=0, write_checksum=0, write_dict_id=0, **more)
                own = zstandard.ZstdCompressionDict(content or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                own.precompute_compress(compression_params=how)
                out.append(zstandard.ZstdCompressor(dict_data=own, compression_params=how))
            return out

        self.langs = list(contents)
        self.quick, self.slow = compressors(3), compressors(12, min_match=3)
        self.close, self.narrow = close, narrow

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score from 0 to 1, rejected)."""
        if not self.langs or text is None or not any(map(str.isalpha, text)):
            return "und", 0.0, True
        data = plain_letters(text)
        for compressors, least in ((self.quick, self.close), (self.slow, self.narrow)):
            sizes = [len(c.compress(data)) for c in compressors]
            best = min(sizes)  # of equal sizes the more frequent language
            first = sizes.index(best)
            margin = min((s for i, s in enumerate(sizes) if i != first), default=2 * best) / best - 1
            if margin >= least:
                break
        score = 1 / sum(math.exp(max(-50.0, (best - s) / 4)) for s in sizes)
        return self.langs[first], score, margin < self.narrow


def identify(docs: DataFrame, learn_from: Column, close: float = 0.06, narrow: float = 0.01, **bounds: int) -> DataFrame:
    """(doc_id, learnt_from, lang_pred, score, rejected) for every row of docs(doc_id, text, lang); only rows of learn_from are learnt from.

    Null texts and texts without a letter are `und` with score 0, as are all texts where nothing could be learnt. Repeated rows are
    all returned; very long texts are compressed whole.
    """
    contents = dictionaries(docs.where(learn_from), **bounds)
    shared = docs.sparkSession.sparkContext.broadcast(contents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(shared.value, close, narrow)
        for b in batches:
            found = [model.predict(t.as_py()) for t in b.column("text")]
            lang, score, rejected = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("learnt_from"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "learnt_from", "lang_pred", "score", "rejected"])

    rows = docs.select("doc_id", learn_from.alias("learnt_from"), "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, learnt_from boolean, lang_pred string, score double, rejected boolean")
