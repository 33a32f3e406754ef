"""WARC archives of page captures, and the external merge of their indexes.

Archives are gzip files with one member per record, written by Spark's text writer (so commits and retries are Spark's): a row
is one member, and the separator between rows is an empty gzip member, which decompresses to nothing. Reading an
archive yields its index as one locally sorted run. The runs are dealt out by ranges of (url key, time), and every range
merges its runs with a loser tree, which makes the capture histories globally ordered.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from itertools import islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import new_path, written

_EMPTY_MEMBER = gzip.compress(b"", mtime=0)
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_ENTRY = "run string, pos long, url_key string, captured long, page_id long, offset long, length long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def url_key(url: str) -> str:
    """Host labels from last to first, then all after the host but the fragment: http://www.example.com/a?b#c is com,example,www)/a?b."""
    rest = url.partition("://")[2] or url
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    return ",".join(reversed(rest[:cut].lower().split("."))) + ")" + rest[cut:].partition("#")[0]


def _record_id(page_id: int | None, captured: int) -> str:
    h = hashlib.md5(f"{page_id}/{captured}".encode(), usedforsecurity=False).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def record(page_id: int | None, url: str | None, captured: int, payload: bytes, digest: str, revisit: bool, refers_to: int | None) -> bytes:
    """One WARC record, not compressed. A revisit has no payload; its own length and what it refers to stand in the header."""
    block = _HTTP % len(payload) + (b"" if revisit else payload)
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": _record_id(page_id, captured),
        "WARC-Date": datetime.fromtimestamp(captured, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"),
        "WARC-Target-URI": "".join(c if c > "\x20" and c != "\x7f" else f"%{ord(c):02X}" for c in url or ""),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http;msgtype=response",
        "X-Payload-Length": str(len(payload)),
    }
    if page_id is not None:
        head["X-Page-ID"] = str(page_id)
    if revisit:
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        head["X-Refers-To-Page-ID"] = str(refers_to)
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def decided(captures: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """captures(page_id, url, captured, payload binary) with digest and keep: the page_id of the record that holds the payload, where
    several rows share one of at least least_bytes; else null. Groups are summed up before they are dealt out; the
    join back is one that Spark splits where a payload is very frequent."""
    rows = captures.withColumn("digest", F.sha1("payload"))
    groups = rows.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(groups, "digest", "left")


def write_archives(captures: DataFrame, least_bytes: int = 1000, per_file: int = 2000, level: int = 6, file_bytes: int = 128 << 20) -> str:
    """Write a record for every row of captures(page_id, url, captured, payload); returns the folder of the archives.

    Of rows with equal payloads of at least least_bytes the one with the largest page_id is a response, others revisit it. Rows
    that share that page_id are all responses. captured is in seconds since 1970; null payloads are empty, null urls too. An archive has at most per_file records, fewer where
    payloads are large, so that it holds about file_bytes before compression; a longer payload is written whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for page_id, url, captured, payload, digest, keep in zip(*(b.column(n) for n in ("page_id", "url", "captured", "payload", "digest", "keep")), strict=True):
                i, k = page_id.as_py(), keep.as_py()
                out.append(gzip.compress(record(i, url.as_py(), captured.as_py() or 0, payload.as_py(), digest.as_py(), k is not None and i != k, k), level, mtime=0))
                if len(out) == 256:
                    yield pa.RecordBatch.from_pydict({"member": pa.array(out, pa.binary())})
                    out = []
            yield pa.RecordBatch.from_pydict({"member": pa.array(out, pa.binary())})

    path = new_path(captures.sparkSession, "warc")
    mean = captures.agg(F.avg(F.octet_length("payload"))).first()[0] or 1.0
    per_file = max(1, min(per_file, int(file_bytes / max(mean, 1.0))))
    rows = decided(captures.withColumn("payload", F.coalesce("payload", F.lit(b""))), least_bytes)
    members = rows.select("page_id", "url", "captured", "payload", "digest", "keep").mapInArrow(run, "member binary")
    members.select(F.col("member").cast("string")).write.options(lineSep=_EMPTY_MEMBER.decode("latin-1"), encoding="ISO-8859-1", maxRecordsPerFile=per_file).text(path)
    return path


def read_records(archive: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, header, payload) of every record of an archive; a damaged record raises ValueError."""
    at = 0
    while at < len(archive):
        d, parts, end = zlib.decompressobj(31), [], at
        while not d.eof and end < len(archive):
            parts.append(d.decompress(archive[end : end + 16_384]))
            end = min(end + 16_384, len(archive))
        if not d.eof:
            raise ValueError("an archive ends within a record")
        raw, length = b"".join(parts), end - len(d.unused_data) - at
        if raw:
            head, _, rest = raw.partition(b"\r\n\r\n")
            version, *lines = head.decode().split("\r\n")
            header = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
            size = int(header["Content-Length"])
            if not version.startswith("WARC/") or rest[size:] != b"\r\n\r\n":
                raise ValueError("a record's length is wrong")
            yield at, length, header, rest[:size].partition(b"\r\n\r\n")[2]
        at += length


def _entry(run: str, offset: int, length: int, header: dict[str, str], payload: bytes) -> dict:
    digest, revisit = header["WARC-Payload-Digest"].removeprefix("sha1:"), header["WARC-Type"] == "revisit"
    if not revisit and (hashlib.sha1(payload, usedforsecurity=False).hexdigest() != digest or len(payload) != int(header["X-Payload-Length"])):
        raise ValueError("a payload differs from its digest")
    number = lambda k: int(header[k]) if k in header else None
    return {
        "run": run, "url_key": url_key(header["WARC-Target-URI"]), "captured": int(datetime.fromisoformat(header["WARC-Date"]).timestamp()), "page_id": number("X-Page-ID"), "offset": offset, "length": length,
        "payload_bytes": number("X-Payload-Length"), "payload_digest": digest, "record_type": header["WARC-Type"], "refers_to": number("X-Refers-To-Page-ID"),
    }


def _order(e: dict) -> tuple:
    return e["url_key"], e["captured"], e["page_id"] is not None, e["page_id"] or 0


def read_indexes(spark: SparkSession, path: str) -> DataFrame:
    """The index entries of all archives of a folder: each archive is one run, its entries in order of (url_key, captured, page_id)."""
    schema = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (x.split() for x in _ENTRY.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path"), b.column("content"), strict=True):
                name = path.as_py().rpartition("/")[2]
                entries = sorted((_entry(name, *r) for r in read_records(content.as_py())), key=_order)
                yield pa.RecordBatch.from_pylist([e | {"pos": i} for i, e in enumerate(entries)], schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, _ENTRY)


class LoserTree:
    """k-way merge: inner nodes keep the losers of their matches, so the next smallest costs one path of log2(k) comparisons."""

    def __init__(self, runs: list[Iterator]):
        self.runs = runs
        self.heads = [next(r, None) for r in runs]
        self.k = max(1, len(runs))
        self.losers = [-1] * self.k
        for i in range(len(runs)):
            self._play(i)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def _play(self, i: int) -> None:
        winner, node = i, (i + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:  # a node's first player waits for its rival
                self.losers[node] = winner
                return
            if self._less(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple[int, object]]:
        """(run, item) in order."""
        while self.runs and self.heads[w := self.losers[0]] is not None:
            yield w, self.heads[w]
            self.heads[w] = next(self.runs[w], None)
            self._play(w)


def merge_indexes(entries: DataFrame, partitions: int | None = None, range_entries: int = 200_000) -> DataFrame:
    """All index entries in global order of (url_key, captured, page_id), with the numbers of their range and of their place in it.

    The order holds within a range and from one range to the next. Ranges are cut by the whole key, so that captures of one
    url may fill several of them, and so small that one has about range_entries entries: as many a task holds, without their payloads. The merged entries leave the task as the tree gives them out.
    """
    n = partitions or max(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-entries.count() // range_entries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        archive = rows.column("run").to_numpy(zero_copy_only=False)
        starts = [0, *(i for i in range(1, len(archive)) if archive[i] != archive[i - 1]), len(archive)] if len(archive) else [0]
        url, captured, page = (rows.column(n) for n in ("url_key", "captured", "page_id"))

        def entries_of(a: int, z: int) -> Iterator[tuple]:
            for i in range(a, z):
                p = page[i].as_py()
                yield url[i].as_py(), captured[i].as_py(), p is not None, p or 0, i

        merged = (key[-1] for _, key in LoserTree([entries_of(a, z) for a, z in zip(starts, starts[1:], strict=False)]))
        place = 0
        while some := list(islice(merged, 10_000)):
            out = rows.take(some).append_column("range", pa.array([TaskContext.get().partitionId()] * len(some), pa.int64()))
            yield from out.append_column("place", pa.array(range(place, place + len(some)), pa.int64())).combine_chunks().to_batches()
            place += len(some)

    dealt = entries.repartitionByRange(n, "url_key", "captured", "page_id").sortWithinPartitions("run", "pos")
    return dealt.mapInArrow(run, f"{_ENTRY}, range long, place long")


def capture_histories(captures: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Write captures(page_id, url, captured, payload) to archives, read them back, and merge their indexes.

    One row per capture, repeated rows included; an empty table gives no rows.
    """
    spark = captures.sparkSession
    if captures.isEmpty():
        return spark.createDataFrame([], f"{_ENTRY}, range long, place long")
    return merge_indexes(written(read_indexes(spark, write_archives(captures, least_bytes)), "warc-index"))


def page_captures(pages: DataFrame, first: int = 1_704_067_200) -> DataFrame:
    """pages(page_id, url, html) as captures; these tables have no times, so page_id seconds after first stand for them."""
    seconds: Column = F.lit(first) + F.pmod(F.coalesce(F.col("page_id").cast("long"), F.lit(0)), F.lit(31_536_000))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", seconds.alias("captured"), F.col("html").cast("binary").alias("payload"))
