"""Results of queries, kept as Parquet under a key made of the query's text."""

from __future__ import annotations

import hashlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from ledgerline.plans.runner import only_reads

#: Quoted texts and names, in which white space counts, or a run of white space outside of them.
_PIECES = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\"|`[^`]*`|\s+", re.DOTALL)


def cache_key(sql: str, source: str = "") -> str:
    """SHA-256 of a query and the source that it asks. White space outside of quotes does not matter, nor does a closing semicolon."""
    text = _PIECES.sub(lambda m: " " if m[0].isspace() else m[0], sql).strip().rstrip(";").rstrip()
    return hashlib.sha256(f"{source}\n{text}".encode()).hexdigest()


class ResultCache:
    """A folder of results. Each is written by the executors into a folder of its own and counts once it is complete, so an interrupted write is never read
    and two writers don't disturb each other. Nothing expires by itself: refresh a query or drop it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _stored(self, key: str) -> str | None:
        """The newest complete result's folder."""
        at = self._at(key)
        folders = list(self._fs.listStatus(at)) if self._fs.exists(at) else []
        done = [(f.getModificationTime(), f.getPath().getName()) for f in folders if self._fs.exists(self._at(key, f.getPath().getName(), "_SUCCESS"))]
        return f"{self.path}/{key}/{max(done)[1]}" if done else None

    def sql(self, sql: str, source: str = "", refresh: bool = False) -> DataFrame:
        """The stored result of a query that only reads; it is run if there is none yet, or to refresh it. The older results of a refreshed query stay for those who read them, until drop()."""
        if not sql.strip() or not only_reads(self.spark, sql):
            raise ValueError("only queries that read are kept")
        key = cache_key(sql, source)
        stored = None if refresh else self._stored(key)
        if stored is None:
            stored = f"{self.path}/{key}/{uuid.uuid4().hex}"
            self.spark.sql(sql).write.parquet(stored)
        return self.spark.read.parquet(stored)

    def drop(self, sql: str, source: str = "") -> bool:
        """Delete what is stored for a query; whether there was anything."""
        return self._fs.delete(self._at(cache_key(sql, source)), True)
