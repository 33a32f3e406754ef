"""Column profiles per calendar bucket: totals, missing, distinct, mean, deviation, extremes, most frequent values.

Numeric columns are unpivoted and grouped; categorical columns are unpivoted into one table of frequencies, which is sorted by ranges of values for
the ranks and extremes, and cut down to the most frequent values. Nothing is joined, and no task holds all values of a column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ledgerline.functions.dates import bucket
from ledgerline.functions.datetypes import DateColumn

STATS = "column_name string, dt string, col_type string, n_total bigint, n_missing bigint, n_unique bigint, mean double, std double, min_val string, max_val string, top_10 string"
#: How many columns are unpivoted at a time.
WIDTH = 50


def column_types(df: DataFrame, overrides: dict[str, str] | None = None) -> dict[str, str]:
    """numeric or categorical by schema type; overrides win."""
    return {f.name: "numeric" if isinstance(f.dataType, NumericType) else "categorical" for f in df.schema.fields} | (overrides or {})


def inferred_type(values: Column) -> Column:
    """Aggregate over text: numeric if more than nine of ten values that aren't blank are numbers."""
    from ledgerline.functions.scalars import to_number

    present = F.length(F.trim(values)) > 0
    share = F.avg(F.when(present, to_number(values).isNotNull().cast("double")))
    return F.when(share > 0.9, "numeric").otherwise("categorical")


def _dated(df: DataFrame, date_column: str | DateColumn | None, vintage: str) -> DataFrame:
    if date_column is None:
        return df.withColumn("__dt", F.lit("all"))
    return df.withColumn("__dt", date_column.bucket(vintage) if isinstance(date_column, DateColumn) else bucket(F.col(date_column), vintage))


def numeric_profile(df: DataFrame, columns: list[str], date_column: str | DateColumn | None = None, vintage: str = "all", exact: bool = True) -> DataFrame:
    """Profiles of numeric columns; NaN counts as missing; the deviation is the sample's, null for one value.

    Columns are unpivoted, so that one grouping with a single distinct count does for all of them, without copying rows for each.
    exact=False estimates the distinct count (2 % off, as a rule), and then no values are shuffled."""
    rows = _dated(df, date_column, vintage).select("__dt", *[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in columns])
    long = reduce(DataFrame.unionByName, [rows.unpivot(["__dt"], columns[at : at + WIDTH], "column_name", "v") for at in range(0, len(columns), WIDTH)])
    return long.groupBy("column_name", F.col("__dt").alias("dt")).agg(
        F.lit("numeric").alias("col_type"),
        F.count("*").alias("n_total"),
        (F.count("*") - F.count("v")).alias("n_missing"),
        (F.count_distinct("v") if exact else F.approx_count_distinct("v", 0.02)).alias("n_unique"),
        F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("std"),
        F.min("v").cast("string").alias("min_val"),
        F.max("v").cast("string").alias("max_val"),
        F.lit(None).cast("string").alias("top_10"),
    )


def frequencies(df: DataFrame, columns: list[str], date_column: str | DateColumn | None = None, vintage: str = "all") -> DataFrame:
    """(dt, column_name, value, n): how often each value occurs, nulls included. One shuffle for all columns."""
    rows = _dated(df, date_column, vintage).select("__dt", *[F.col(c).cast("string").alias(c) for c in columns])
    # generated rows, unlike unpivoted ones, let Spark see that two uses of this table are the same, so that it is counted once
    one = lambda some: rows.select(F.col("__dt").alias("dt"), F.stack(F.lit(len(some)), *[x for c in some for x in (F.lit(c), F.col(c))]).alias("column_name", "value"))
    parts = [one(columns[at : at + WIDTH]) for at in range(0, len(columns), WIDTH)]
    return reduce(DataFrame.unionByName, parts).groupBy("dt", "column_name", "value").agg(F.count("*").alias("n"))


def _present(value: Column, blank_is_missing: bool) -> Column:
    return value.isNotNull() & (F.length(F.trim(value)) > 0) if blank_is_missing else value.isNotNull()


def _placed(freq: DataFrame, top: int, blank_is_missing: bool = True) -> DataFrame:
    """The most frequent present values of each column and bucket with their place (by frequency, then value). A task passes on no more than top rows of each."""
    rows = freq.withColumn("present", _present(F.col("value"), blank_is_missing))
    place = F.row_number().over(Window.partitionBy("dt", "column_name").orderBy(F.desc("present"), F.desc("n"), "value"))
    return rows.withColumn("place", place).where((F.col("place") <= top) & F.col("present"))


def _ranges(freq: DataFrame, blank_is_missing: bool) -> DataFrame:
    """Counts, sums over places and extremes of each column, bucket and range of values: values are sorted by ranges over all tasks, so none holds all of a bucket. Within a range a value's place is that in its task."""
    order = ["column_name", "dt", F.desc("present"), "upper", "value"]
    rows = freq.withColumns({"present": _present(F.col("value"), blank_is_missing), "upper": F.upper("value")})
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id())
    rows = rows.withColumns({"range": F.shiftright("id", 33), "k": F.when(F.col("present"), F.col("id").bitwiseAND((1 << 33) - 1))})
    n, k = (F.when(F.col("present"), c.cast("decimal(18,0)")) for c in (F.col("n"), F.col("k")))
    entry = F.struct("k", "value", "n")
    return rows.groupBy("column_name", "dt", "range").agg(
        F.sum("n").alias("n_total"),
        F.coalesce(F.sum(F.when(~F.col("present"), F.col("n"))), F.lit(0)).alias("n_missing"),
        F.count("k").alias("n_unique"),
        F.min("k").alias("k0"),
        F.sum(n).alias("s0"),
        F.sum(n * k).alias("s1"),
        F.sum(n * k * k).alias("s2"),
        F.min(F.when(F.col("present"), entry)).alias("low"),
        F.max(F.when(F.col("present"), entry)).alias("high"),
    )


def _categorical(freq: DataFrame, top: int, blank_is_missing: bool) -> DataFrame:
    """Categorical statistics from a table of frequencies. Ranges and most frequent values of a column and bucket meet in one shuffle, a few rows of each task; there places in ranges become ranks by the values in the ranges before. The sums are whole numbers, so that shifting them loses nothing."""
    entry = F.struct("place", "value", "n").alias("entry")
    parts = _ranges(freq, blank_is_missing).unionByName(_placed(freq, top, blank_is_missing).select("column_name", "dt", F.lit(-1).cast("long").alias("range"), entry), allowMissingColumns=True)
    before = Window.partitionBy("column_name", "dt").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("n_unique").over(before), F.lit(0)).cast("decimal(18,0)") + 1 - F.col("k0")
    parts = parts.repartition("column_name", "dt").withColumn("by", shift)
    count, r1, r2 = (F.sum(x).cast("double") for x in ("s0", F.expr("s1 + by * s0"), F.expr("s2 + 2 * by * s1 + by * by * s0")))
    mean = r1 / count
    present = F.when(F.col("n_unique") > 0, F.col("range"))
    shown = lambda e, a, z="": F.concat(e["value"], F.lit(a), e["n"].cast("string"), F.lit(z))
    tops = F.array_sort(F.collect_list("entry"))
    return parts.groupBy("column_name", "dt").agg(
        F.lit("categorical").alias("col_type"),
        F.sum("n_total").alias("n_total"),
        F.sum("n_missing").alias("n_missing"),
        F.sum("n_unique").alias("n_unique"),
        mean.alias("mean"),
        F.sqrt(F.greatest(F.lit(0.0), r2 / count - mean * mean)).alias("std"),
        shown(F.min_by("low", present), "=").alias("min_val"),
        shown(F.max_by("high", present), "=").alias("max_val"),
        F.when(F.size(tops) > 0, F.array_join(F.transform(tops, lambda e: shown(e, "(", ")")), "; ")).alias("top_10"),
    )


def categorical_profile(df: DataFrame, columns: list[str], date_column: str | DateColumn | None = None, vintage: str = "all", top: int = 10, blank_is_missing: bool = True) -> DataFrame:
    """Profiles of categorical columns: mean and deviation (the population's) are those of the values' alphabetical ranks (by upper case, then value), weighted by frequency;
    extremes are the first and the last value with their counts. However many values a column has in a bucket, no task holds them all, and the rows are read once."""
    return _categorical(frequencies(df, columns, date_column, vintage), top, blank_is_missing)


def top_values(df: DataFrame, columns: list[str], date_column: str | DateColumn | None = None, vintage: str = "all", top: int = 10) -> DataFrame:
    """(dt, column_name, value, n, place): the most frequent values as rows."""
    return _placed(frequencies(df, columns, date_column, vintage), top).select("dt", "column_name", "value", "n", F.col("place").cast("int").alias("place"))


def frequency_moments(df: DataFrame, columns: list[str], date_column: str | DateColumn | None = None, vintage: str = "all") -> DataFrame:
    """The older statistics of the frequencies themselves: their mean, sample deviation, extremes, sum and sum of squares."""
    n = F.col("n").cast("double")
    rows = frequencies(df, columns, date_column, vintage).where("value is not null")
    return rows.groupBy("dt", "column_name").agg(F.avg(n).alias("mean_n"), F.stddev_samp(n).alias("std_n"), F.min("n").alias("min_n"), F.max("n").alias("max_n"), F.sum("n").alias("sum_n"), F.sum(F.col("n") * F.col("n")).alias("sum_sq_n"))


def profile(df: DataFrame, date_column: str | DateColumn | None = None, vintage: str = "all", columns: list[str] | None = None, overrides: dict[str, str] | None = None, exact: bool = True) -> DataFrame:
    """Profiles of all (or the given) columns but the date, numeric and categorical together. date_column: a name, of dates or timestamps, or a DateColumn. exact: as in numeric_profile()."""
    types = column_types(df, overrides)
    own = (date_column.name if isinstance(date_column, DateColumn) else date_column or "").lower()
    picked = [c for c in (columns or df.columns) if c.lower() != own]
    numeric, other = ([c for c in picked if (types[c] == "numeric") == kind] for kind in (True, False))
    parts = ([numeric_profile(df, numeric, date_column, vintage, exact)] if numeric else []) + ([categorical_profile(df, other, date_column, vintage)] if other else [])
    if not parts:
        return df.sparkSession.createDataFrame([], STATS)
    return reduce(DataFrame.unionByName, parts)


def missing_buckets(df: DataFrame, stored: DataFrame, date_column: str, vintage: str) -> DataFrame:
    """The rows of df whose bucket stored(dt) hasn't yet: what is left to be profiled."""
    return _dated(df, date_column, vintage).join(stored.select(F.col("dt").alias("__dt")).distinct(), "__dt", "left_anti").drop("__dt")
