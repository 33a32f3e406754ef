"""Sources: whatever a side of a comparison is read from becomes a DataFrame."""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.dates import bucket_text, parse_date
from ledgerline.functions.datetypes import DateColumn
from ledgerline.functions.predicates import canonical_range
from ledgerline.operators.rowcount import summed

# Header names by which date and count columns are known.
DATE_NAMES = ("rpg_dt", "eff_dt", "dt", "date", "run_date", "snap_dt", "snapshot_dt", "date_value")
COUNT_NAMES = ("row_count", "rowcount", "count", "cnt", "rows")
# Other header names of profile statistics.
STAT_NAMES = {
    "n_total": ("n_total", "col_count", "count"),
    "n_missing": ("n_missing", "col_missing", "missing"),
    "n_unique": ("n_unique", "col_distinct", "distinct"),
    "mean": ("mean", "col_avg", "avg"),
    "std": ("std", "col_std", "stddev"),
    "min_val": ("min_val", "col_min", "min"),
    "max_val": ("max_val", "col_max", "max"),
    "top_10": ("top_10", "col_freq", "freq", "top10"),
}


@dataclass(frozen=True)
class Side:
    """One side of a pair. source: parquet, csv, table, sql, sqlfile, jdbc, or a registered name; processed: SQL over the view `source`; transform and bucketed: expressions of the date and of its bucket."""

    name: str
    source: str = "parquet"
    table: str = ""
    date_col: str | None = None
    date_type: str = "date"
    transform: str = ""
    bucketed: str = ""
    vintage: str = ""
    where: str = ""
    processed: str = ""
    columns: list[str] = field(default_factory=list)
    options: dict[str, str] = field(default_factory=dict)

    @property
    def qualified(self) -> str:
        return f"{self.source}_{self.name}"

    @property
    def dated(self) -> DateColumn | None:
        return DateColumn(self.date_col, self.date_type, self.transform, self.bucketed) if self.date_col else None

    @property
    def rows_key(self) -> str:
        """What decides which rows the side has, and how they are dated: all but the choice of columns and the vintage. Sides with the same key can share a scan."""
        return json.dumps([v for k, v in asdict(self).items() if k not in ("columns", "vintage")], sort_keys=True)


def _jdbc(spark: SparkSession, side: Side) -> DataFrame:
    """Partitioned reads where options name partitionColumn, lowerBound, upperBound and numPartitions."""
    return spark.read.format("jdbc").options(**{"fetchsize": "5000", "dbtable": side.table} | {k: v for k, v in side.options.items() if k != "shares"}).load()


def _block(spark: SparkSession, side: Side) -> str:
    """The block of the SQL file `table` that is named by the option `block`, or like the side."""
    blocks = parse_sql_file("\n".join(r.value for r in spark.read.text(side.table).collect()))
    name = side.options.get("block", side.name)
    if name not in blocks:
        raise ValueError(f"{side.table} has no block {name!r}; it has {', '.join(blocks)}")
    return blocks[name]


_READERS: dict[str, Callable[[SparkSession, Side], DataFrame]] = {
    "parquet": lambda spark, side: spark.read.options(**side.options).parquet(side.table),
    "csv": lambda spark, side: read_text_csv(spark, side.table),
    "table": lambda spark, side: spark.table(side.table),
    "sql": lambda spark, side: spark.sql(side.table),
    "sqlfile": lambda spark, side: spark.sql(_block(spark, side)),
    "jdbc": _jdbc,
}


def register(source: str, reader: Callable[[SparkSession, Side], DataFrame]) -> None:
    """Make a further kind of source known."""
    _READERS[source] = reader


def read_side(spark: SparkSession, side: Side) -> DataFrame:
    """A side's rows: read, derived by `processed`, filtered by `where`, projected to its columns (and the date)."""
    if side.source not in _READERS:
        raise ValueError(f"unknown source {side.source!r} of {side.name}")
    return shaped(spark, side, _READERS[side.source](spark, side))


def shaped(spark: SparkSession, side: Side, rows: DataFrame) -> DataFrame:
    """Rows of a side's source, derived, filtered and projected as the side has it."""
    if side.processed:
        rows = _derived(spark, side, rows)
    if side.where:
        rows = rows.where(F.expr(side.where))
    if side.columns:
        dated = [side.date_col] if side.date_col and side.date_col not in side.columns else []
        rows = rows.select(*side.columns, *dated)
    return rows


def _derived(spark: SparkSession, side: Side, rows: DataFrame) -> DataFrame:
    """`processed` over the side's rows, which are {source} in it, or the view cte_<name>."""
    if "{source}" in side.processed:
        return spark.sql(side.processed, source=rows)
    rows.createOrReplaceTempView(f"cte_{side.name}")
    return spark.sql(side.processed)


def read_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every cell as text; empty cells are empty texts."""
    return spark.read.option("header", True).csv(path).na.fill("")


def pick_header(columns: list[str], names: tuple[str, ...], otherwise: int) -> str:
    """The first column with one of the names (case and blanks don't matter), else the one at a position."""
    known = {c.strip().lower(): c for c in reversed(columns)}
    return next((known[n] for n in names if n in known), columns[min(otherwise, len(columns) - 1)])


def read_row_counts(spark: SparkSession, path: str, date: str | None = None, count: str | None = None) -> DataFrame:
    """(dt, row_count) of a CSV file or of all in a folder, summed by raw date."""
    raw = spark.read.option("header", True).csv(path)
    return summed(raw, date or pick_header(raw.columns, DATE_NAMES, 0), count or pick_header(raw.columns, COUNT_NAMES, 1))


def in_buckets(raw: DataFrame, date: str, columns: list[str], vintage: str = "day", first: str | None = None, last: str | None = None) -> DataFrame:
    """(dt, columns) of rows whose dates are text in any spelling: dt is the bucket, to which the range applies. Dates that can't be read have no bucket, and go where a range is asked for."""
    dt = bucket_text(parse_date(F.col(f"`{date}`").cast("string")), vintage)
    return raw.select(dt.alias("dt"), *[F.col(f"`{c}`") for c in columns]).where(canonical_range(F.col("dt"), first, last))


def read_columns(spark: SparkSession, path: str, date: str, columns: list[str] | None = None, vintage: str = "day", first: str | None = None, last: str | None = None) -> DataFrame:
    """in_buckets() of a CSV file or of all in a folder; columns: all but the date's."""
    raw = spark.read.option("header", True).csv(path)
    return in_buckets(raw, date, columns if columns is not None else [c for c in raw.columns if c not in (date, "dt")], vintage, first, last)


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """A profile that was computed elsewhere, under any of the known header names."""
    raw = spark.read.option("header", True).csv(path)
    known = {c.strip().lower(): c for c in raw.columns}
    kinds = {"n_total": "bigint", "n_missing": "bigint", "n_unique": "bigint", "mean": "double", "std": "double"}
    stat = lambda n: F.coalesce(*[F.col(f"`{known[a]}`") for a in STAT_NAMES[n] if a in known], F.lit(None)).try_cast(kinds.get(n, "string")).alias(n)
    own = lambda n, default: F.col(f"`{known[n]}`").alias(n) if n in known else F.lit(default).alias(n)
    return raw.select(own("column_name", None), F.col(f"`{pick_header(raw.columns, DATE_NAMES, 0)}`").alias("dt"), own("col_type", "categorical"), *map(stat, STAT_NAMES))


def column_meta(df: DataFrame, side: Side) -> DataFrame:
    """(source_table, column_name, data_type, source) of a frame."""
    rows = [(side.qualified, f.name, f.dataType.simpleString(), side.source) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "source_table string, column_name string, data_type string, source string")


def parse_sql_file(text: str) -> dict[str, str]:
    """Blocks of a SQL file: a line `-- name` (one word) begins one; other comments at the line's start with several words belong to none."""
    blocks: dict[str, list[str]] = {}
    name = ""
    for line in text.splitlines():
        head = line.strip()
        if head.startswith("--") and len(head[2:].split()) == 1:
            name = head[2:].strip()
            blocks[name] = []
        elif name and not head.startswith(("-- Generated",)):
            blocks[name].append(line)
    return {k: "\n".join(v).strip().rstrip(";").rstrip() for k, v in blocks.items() if "".join(v).strip()}


def unreadable_partitions(rows: DataFrame, column: str, at_once: int = 8) -> list[tuple[object, str]]:
    """Partitions (values of a partition column) of which no row can be read, with the error. Reads one row of each, at_once of them side by side."""

    def probe(value: object) -> tuple[object, str] | None:
        try:
            rows.where(F.col(column).eqNullSafe(F.lit(value))).limit(1).collect()
        except Exception as e:  # noqa: BLE001  any failure of the source is the finding
            return value, str(e).splitlines()[0]
        return None

    values = [r[0] for r in rows.select(column).distinct().collect()]
    with ThreadPoolExecutor(at_once) as pool:
        return [found for found in pool.map(probe, values) if found]


def fill_meta(meta: DataFrame, more: DataFrame) -> DataFrame:
    """Column metadata with the types that it lacks taken from more(source_table, column_name, data_type), and the columns that only more has."""
    keys = ["source_table", "column_name"]
    other = more.select(*keys, F.col("data_type").alias("__type"))
    return meta.join(other, keys, "full_outer").withColumn("data_type", F.coalesce(F.when(F.length(F.trim("data_type")) > 0, F.col("data_type")), "__type")).drop("__type")


def partitions(rows: DataFrame, column: str) -> DataFrame:
    """(partition, n_rows) of every value of a partition column."""
    return rows.groupBy(F.col(column).alias("partition")).agg(F.count("*").alias("n_rows"))
