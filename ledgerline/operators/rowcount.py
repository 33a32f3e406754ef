"""Row counts per calendar bucket, and series of such counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.dates import bucket, parse_date
from ledgerline.functions.datetypes import DateColumn
from ledgerline.functions.predicates import canonical_range


def row_counts(rows: DataFrame, date_column: str | DateColumn | None, vintage: str = "day") -> DataFrame:
    """(dt, row_count) per bucket; without a date column or for `all` one row. Rows without a date are counted under null. date_column: a name, of dates or timestamps, or a DateColumn."""
    if date_column is None or vintage == "all":
        dt = F.lit("all")
    else:
        dt = date_column.bucket(vintage) if isinstance(date_column, DateColumn) else bucket(F.col(date_column), vintage)
    return rows.groupBy(dt.alias("dt")).agg(F.count("*").alias("row_count"))


def daily_series(rows: DataFrame, dated: DateColumn | None) -> DataFrame:
    """(dt, row_count, with_date): row_counts() by day (or month), and how many of the rows have anything in their date column. Under null are the rows without a date and those whose date can't be read."""
    if dated is None:
        return row_counts(rows, None).withColumn("with_date", F.col("row_count"))
    there = F.length(F.trim(F.col(dated.name).cast("string"))) > 0
    return rows.groupBy(dated.bucket("day").alias("dt")).agg(F.count("*").alias("row_count"), F.count(F.when(there, 1)).alias("with_date"))


def summed(raw: DataFrame, date: str, count: str) -> DataFrame:
    """(dt, row_count) of text columns: counts that aren't whole numbers are dropped, repeated raw dates summed."""
    n = F.trim(F.col(count).cast("string"))
    good = raw.where(n.rlike(r"^[+-]?\d+$") & (F.length(F.trim(F.col(date).cast("string"))) > 0))
    return good.groupBy(F.trim(F.col(date).cast("string")).alias("dt")).agg(F.sum(n.cast("long")).alias("row_count"))


def canonical(series: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """(dt, row_count) by canonical date: spellings of one date keep their largest count; what can't be read is dropped."""
    read = series.select(parse_date(F.col("dt")).alias("dt"), "row_count").where(F.col("dt").isNotNull() & canonical_range(F.col("dt"), first, last))
    return read.groupBy("dt").agg(F.max("row_count").alias("row_count"))


def keep_last(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row per keys: the last by order."""
    whole = F.struct(*rows.columns)
    return rows.groupBy(*keys).agg(F.max_by(whole, order).alias("__row")).select("__row.*")


def latest_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    from pyspark.sql import Window

    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def latest_snapshot(rows: DataFrame, column: str) -> DataFrame:
    """Rows that have the largest value of a column."""
    last = rows.agg(F.max(column).alias("__last"))
    return rows.join(F.broadcast(last), F.col(column) == F.col("__last"), "left_semi")


def sample_dates(series: DataFrame, n: int, seed: int = 2025) -> list[str]:
    """n of a series' days (or months): those whose hash with the seed is least, whatever the order of rows; in order."""
    days = series.select("dt").where("length(dt) in (6, 10)").distinct()
    return sorted(r.dt for r in days.orderBy(F.md5(F.concat(F.lit(f"{seed} "), "dt").cast("binary")), "dt").limit(n).collect())
