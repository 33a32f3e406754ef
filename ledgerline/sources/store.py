"""The store: Parquet tables in which a write takes effect by one small file.

A table is a folder of data folders and of numbered commits; the last commit lists the data folders that make it up, and which source tables of each are alive. A write puts
new rows into a new data folder and then creates the next commit, which only one writer can; until then readers see the table as it was. Writes touch the
source tables they are about, and no others: a writer that comes second follows the first, if that one wrote about other source tables, and else gives up (Conflict). Earlier commits can be read until vacuum() deletes them.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.rowcount import keep_last
from ledgerline.operators.states import STATE, merged_states

# Schemas and keys of the stored tables.
TABLES = {
    "row_counts": ("source_table string, dt string, row_count bigint", ["source_table", "dt"]),
    "col_stats": ("source_table string, column_name string, dt string, col_type string, n_total bigint, n_missing bigint, n_unique bigint, mean double, std double, min_val string, max_val string, top_10 string, vintage_label string, fingerprint string", ["source_table", "column_name", "dt"]),
    "profile_states": (f"source_table string, {STATE}", ["source_table", "column_name", "dt"]),
    "column_meta": ("source_table string, column_name string, data_type string, source string", ["source_table", "column_name"]),
    "metadata": ("source_table string, source string, date_var string, date_format string, vintage string, row_count_total bigint, min_date_loaded string, max_date_loaded string", ["source_table"]),
    "history": ("id bigint, sql string, seconds double, rows bigint, status string, note string, engine string, conn string, error string, at timestamp", ["id"]),
    "timing": ("source_table string, step string, start timestamp, elapsed_sec double, status string", ["source_table", "step", "start"]),
    "samples": ("source_table string, vintage string, dt string", ["source_table", "vintage", "dt"]),
    "matching": ("source_table string, dt string, state string", ["source_table", "dt"]),
    "mappings": ("source_table string, right_table string, left_col string, right_col string, state string", ["source_table", "right_table", "left_col"]),
}


class Conflict(RuntimeError):
    """Another writer was first; nothing was changed."""


class Store:
    #: A table of more data folders is written anew as one.
    FOLDERS = 20

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _numbers(self, table: str) -> list[int]:
        folder = self._at(table, "commits")
        return [int(f.getPath().getName()) for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []

    def _folders(self, table: str, number: int) -> dict[str, list[str] | None]:
        return json.loads("".join(r.value for r in self.spark.read.text(str(self._at(table, "commits", f"{number:012d}"))).collect()))

    def _last(self, table: str) -> tuple[int, dict[str, list[str] | None]]:
        """The last commit: its number, and data folder -> the source tables of it that are alive (None: all)."""
        number = max(self._numbers(table), default=0)
        return number, self._folders(table, number) if number else {}

    def versions(self, table: str) -> list[int]:
        """The numbers of the commits that can be read."""
        return sorted(self._numbers(table))

    def _commit(self, table: str, number: int, folders: dict[str, list[str] | None]) -> None:
        try:
            out = self._fs.create(self._at(table, "commits", f"{number + 1:012d}"), False)
        except Exception as e:  # noqa: BLE001  the file is there already
            raise Conflict(f"{table} was written by another") from e
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()

    def _read(self, table: str, folders: dict[str, list[str] | None]) -> DataFrame:
        schema, _ = TABLES[table]
        parts = []
        for folder, alive in folders.items():
            rows = self.spark.read.schema(schema).parquet(str(self._at(table, folder)))
            parts.append(rows if alive is None else rows.where(F.col("source_table").isin(alive)))
        return reduce(DataFrame.unionAll, parts) if parts else self.spark.createDataFrame([], schema)

    def read(self, table: str, at: int | None = None) -> DataFrame:
        """A table as it is, or as it was after the commit `at` (0: before the first); a commit that isn't there (any more) is an error."""
        if at is not None and at and at not in self._numbers(table):
            raise ValueError(f"{table} has no commit {at}")
        return self._read(table, self._last(table)[1] if at is None else self._folders(table, at) if at else {})

    def views(self) -> None:
        """All tables as temporary views of their names, as they are now."""
        for table in TABLES:
            self.read(table).createOrReplaceTempView(table)

    @staticmethod
    def _changed(before: dict[str, list[str] | None], after: dict[str, list[str] | None]) -> set[str] | None:
        """The source tables in which two commits differ; None: this can't be told."""
        out: set[str] = set()
        for folder in {*before, *after}:
            a, z = before.get(folder, []), after.get(folder, [])
            if a == z:
                continue
            if a is None or z is None:
                return None
            out |= set(a) ^ set(z)
        return out

    def _put(self, table: str, rows: DataFrame, instead_of: list[str] | None, number: int, folders: dict[str, list[str] | None]) -> None:
        """Add rows in place of all rows of the given source tables (None: of all)."""
        new = f"data-{uuid.uuid4().hex}"
        rows.write.parquet(str(self._at(table, new)))
        names = None
        if "source_table" in rows.columns:
            names = [r[0] for r in self.spark.read.schema(TABLES[table][0]).parquet(str(self._at(table, new))).select("source_table").distinct().collect()]
        while True:
            left = {} if instead_of is None else {f: rest for f, alive in folders.items() if (rest := alive and [x for x in alive if x not in instead_of])}
            try:
                return self._commit(table, number, left | {new: names})
            except Conflict:
                # another was first: where it wrote about other source tables, this write follows it
                number, now = self._last(table)
                changed = self._changed(folders, now)
                if instead_of is None or names is None or changed is None or changed & {*instead_of, *names}:
                    raise
                folders = now

    def _touch(self, table: str, rows: DataFrame, change) -> None:
        """Put change(rows there are) in place of the rows of those source tables that rows are about."""
        number, folders = self._last(table)
        names = [r[0] for r in rows.select("source_table").distinct().collect()] if "source_table" in rows.columns else None
        there = self._read(table, folders)
        if names is not None and len(folders) < self.FOLDERS:
            self._put(table, change(there.where(F.col("source_table").isin(names))), names, number, folders)
        else:
            self._put(table, change(there), None, number, folders)

    def vacuum(self, table: str, keep: int = 10) -> None:
        """Delete all but the last commits, and the data folders that none of those lists."""
        number, _ = self._last(table)
        listed: set[str] = set()
        for f in self._fs.listStatus(self._at(table, "commits")) if number else []:
            name = f.getPath().getName()
            if int(name) <= number - keep:
                self._fs.delete(f.getPath(), False)
            else:
                listed |= json.loads("".join(r.value for r in self.spark.read.text(str(f.getPath())).collect())).keys()
        for f in self._fs.listStatus(self._at(table)) if number else []:
            if (name := f.getPath().getName()).startswith("data-") and name not in listed:
                self._fs.delete(f.getPath(), True)

    def _fit(self, table: str, rows: DataFrame) -> DataFrame:
        """rows in the table's schema: columns that it doesn't know are an error, those that rows lack are null."""
        kinds = dict(x.split() for x in TABLES[table][0].split(", "))
        if unknown := [c for c in rows.columns if c not in kinds]:
            raise ValueError(f"{table} has no columns {', '.join(unknown)}")
        return rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(k).alias(n) for n, k in kinds.items()])

    def append(self, table: str, rows: DataFrame) -> None:
        """Add rows; keys that are there already, or come twice, are an error."""
        keys, new = TABLES[table][1], self._fit(table, rows)
        if not new.groupBy(*keys).count().where("count > 1").isEmpty() or not new.join(self.read(table), keys, "left_semi").isEmpty():
            raise ValueError(f"{table} has such keys already")
        self._touch(table, new, lambda there: there.unionByName(new))

    def upsert(self, table: str, rows: DataFrame) -> None:
        """Add rows in place of those with the same keys; of rows that repeat a key the last by all columns stays."""
        keys, new = TABLES[table][1], self._fit(table, rows)
        new = keep_last(new, keys, F.struct(*new.columns))
        self._touch(table, new, lambda there: there.join(new, keys, "left_anti").unionByName(new))

    def update(self, table: str, keys: dict[str, object], **values: object) -> bool:
        """Set fields of the row with the given keys; whether there is one. Fields that the table doesn't know are an error."""
        names = [x.split()[0] for x in TABLES[table][0].split(", ")]
        if unknown := [c for c in (*keys, *values) if c not in names]:
            raise ValueError(f"{table} has no columns {', '.join(unknown)}")
        here = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(v)) for k, v in keys.items()])
        found = self.read(table).where(here)
        if found.isEmpty():
            return False
        self.upsert(table, found.withColumns({k: F.lit(v) for k, v in values.items()}))
        return True

    def replace(self, table: str, source_table: str, rows: DataFrame) -> None:
        """Put rows in place of all rows of a source table."""
        new = keep_last(self._fit(table, rows), TABLES[table][1], F.struct(*[x.split()[0] for x in TABLES[table][0].split(", ")]))
        number, folders = self._last(table)
        self._put(table, new, [source_table], number, folders)

    def delete(self, table: str, condition) -> bool:
        """Delete rows for which a condition holds; whether there were any."""
        gone = F.coalesce(condition, F.lit(False))
        number, folders = self._last(table)
        there = self._read(table, folders)
        if there.where(gone).isEmpty():
            return False
        self._put(table, there.where(~gone), None, number, folders)
        return True

    def add_states(self, source_table: str, states: DataFrame, vintage: str = "day") -> None:
        """Add the states of further rows to those of a source table: buckets that are there already are merged, none is computed from rows again."""
        there = self.read("profile_states").where(F.col("source_table") == source_table).drop("source_table")
        self.replace("profile_states", source_table, merged_states(there.unionByName(states), vintage).withColumn("source_table", F.lit(source_table)))

    def patch(self, source_table: str, **values: object) -> None:
        """Set the named fields of a table's metadata; others stay."""
        rows = self.read("metadata")
        here = rows.where(F.col("source_table") == source_table)
        one = here if not here.isEmpty() else self.spark.createDataFrame([(source_table,)], "source_table string")
        self.upsert("metadata", one.withColumns({k: F.lit(v) for k, v in values.items()}))

    def backfill(self) -> None:
        """Fill empty fields of the metadata from the row counts."""
        sums = self.read("row_counts").groupBy("source_table").agg(F.sum("row_count").alias("t"), F.min("dt").alias("a"), F.max("dt").alias("z"))
        rows = self.read("metadata").join(sums, "source_table", "full_outer")
        fill = {"row_count_total": "t", "min_date_loaded": "a", "max_date_loaded": "z"}
        number, folders = self._last("metadata")
        self._put("metadata", self._fit("metadata", rows.withColumns({k: F.coalesce(k, v) for k, v in fill.items()}).drop(*fill.values())), None, number, folders)

    def note(self, sql: str, seconds: float | None, rows: int | None, status: str, note: str = "", engine: str = "spark", conn: str | None = None, error: str | None = None) -> int:
        """Add a query to the history; its id."""
        last = self.read("history").agg(F.max("id")).first()[0] or 0
        row = self.spark.createDataFrame([(last + 1, sql, seconds, rows, status, note, engine, conn, error)], TABLES["history"][0].rpartition(", ")[0])
        self.append("history", row.withColumn("at", F.current_timestamp()))
        return last + 1

    def set_note(self, id: int, note: str) -> bool:
        """Change a query's note; whether there is one of that id."""
        return self.update("history", {"id": id}, note=note)

    def forget(self, id: int) -> bool:
        """Delete a query from the history; whether there was one of that id."""
        return self.delete("history", F.col("id") == id)

    def history(self, n: int = 50) -> DataFrame:
        """The last n queries, newest first."""
        return self.read("history").orderBy(F.desc("id")).limit(n)


def write_csv(rows: DataFrame, path: str, order: list[str]) -> None:
    """A report-sized result as one CSV file with a header, sorted."""
    rows.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


# The columns of a profile's file.
PROFILE_COLUMNS = ["column_name", "dt", "col_type", "n_total", "n_missing", "n_unique", "mean", "std", "min_val", "max_val", "top_10"]


def write_profile_csv(profile: DataFrame, path: str) -> None:
    """A profile as one CSV file of eleven columns, sorted by column and bucket; what the profile lacks is empty, what it has besides is left out."""
    write_csv(profile.select(*[c if c in profile.columns else F.lit(None).cast("string").alias(c) for c in PROFILE_COLUMNS]), path, ["column_name", "dt"])
