"""Profiles that can be added up: a state per column and bucket, from which states of coarser buckets, and of more rows, follow without the rows.

Counts, mean, deviation and extremes are exact; the number of distinct values comes from a HyperLogLog sketch (lg_k of 12: 1.6 % off, as a rule), quantiles from a KLL sketch. A state has a
bounded size, however many rows and values it stands for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.dates import bucket_text
from ledgerline.functions.datetypes import DateColumn
from ledgerline.operators.profile import WIDTH, _dated, _present, column_types

#: The columns of a state, in the order in which the store has them.
STATE = "column_name string, dt string, col_type string, n_total bigint, n_missing bigint, mean double, m2 double, low double, high double, first string, last string, distinct binary, quantiles binary"


def profile_states(df: DataFrame, date_column: str | DateColumn | None = None, vintage: str = "day", columns: list[str] | None = None, overrides: dict[str, str] | None = None) -> DataFrame:
    """A state for each (or each given) column but the date and each bucket. NaN counts as missing for numbers, blank text for others; rows without a date are under null."""
    types = column_types(df, overrides)
    own = (date_column.name if isinstance(date_column, DateColumn) else date_column or "").lower()
    picked = [c for c in (columns or df.columns) if c.lower() != own]
    rows = _dated(df, date_column, vintage)
    parts = []
    for kind in ("numeric", "categorical"):
        chosen = [c for c in picked if types[c] == kind]
        for at in range(0, len(chosen), WIDTH):
            some = chosen[at : at + WIDTH]
            parts.append((_numeric if kind == "numeric" else _categorical)(rows, some))
    return reduce(DataFrame.unionByName, parts) if parts else df.sparkSession.createDataFrame([], STATE)


def _numeric(rows: DataFrame, columns: list[str]) -> DataFrame:
    long = rows.select("__dt", *[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in columns]).unpivot(["__dt"], columns, "column_name", "v")
    return long.groupBy("column_name", F.col("__dt").alias("dt")).agg(
        F.lit("numeric").alias("col_type"), F.count("*").alias("n_total"), (F.count("*") - F.count("v")).alias("n_missing"), F.avg("v").alias("mean"), (F.var_pop("v") * F.count("v")).alias("m2"), F.min("v").alias("low"), F.max("v").alias("high"),
        F.lit(None).cast("string").alias("first"), F.lit(None).cast("string").alias("last"), F.hll_sketch_agg(F.when(F.col("v").isNotNull(), F.xxhash64("v"))).alias("distinct"), F.kll_sketch_agg_double("v").alias("quantiles"),
    )


def _categorical(rows: DataFrame, columns: list[str]) -> DataFrame:
    long = rows.select("__dt", *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(["__dt"], columns, "column_name", "v")
    v = F.when(_present(F.col("v"), True), F.col("v"))
    lost = lambda k, n: F.lit(None).cast(k).alias(n)
    return long.groupBy("column_name", F.col("__dt").alias("dt")).agg(
        F.lit("categorical").alias("col_type"), F.count("*").alias("n_total"), (F.count("*") - F.count(v)).alias("n_missing"), lost("double", "mean"), lost("double", "m2"), lost("double", "low"), lost("double", "high"),
        F.min(v).alias("first"), F.max(v).alias("last"), F.hll_sketch_agg(v).alias("distinct"), lost("binary", "quantiles"),
    )


def _joined_moments(each: Column) -> Column:
    """(n, mean, m2) of structs of the same, one after the other: deviations are taken from the means, not from zero, so that large means cost no digits."""

    def add(a: Column, b: Column) -> Column:
        n, apart = a["n"] + b["n"], b["mean"] - a["mean"]
        share = b["n"] / n
        return F.struct(n.alias("n"), (a["mean"] + apart * share).alias("mean"), (a["m2"] + b["m2"] + apart * apart * a["n"] * share).alias("m2"))

    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    return F.aggregate(F.array_sort(each), zero, add)


def merged_states(states: DataFrame, vintage: str = "day") -> DataFrame:
    """States of the buckets of a coarser (or the same) vintage: days become weeks, months, quarters, years or all; several states of one bucket, as increments give, become one.
    Of a column and bucket as many states meet in one task as there are days in it, or increments."""
    dt = F.lit("all") if vintage == "all" else bucket_text(F.col("dt"), vintage)
    known = F.struct((F.col("n_total") - F.col("n_missing")).cast("double").alias("n"), "mean", "m2")
    sums = states.withColumn("dt", dt).groupBy("column_name", "dt", "col_type").agg(
        F.sum("n_total").alias("n_total"), F.sum("n_missing").alias("n_missing"), _joined_moments(F.collect_list(F.when(F.col("mean").isNotNull(), known))).alias("moments"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.min("first").alias("first"), F.max("last").alias("last"), F.hll_union_agg("distinct", True).alias("distinct"), F.kll_merge_agg_double("quantiles").alias("quantiles"),
    )
    some = (F.col("col_type") == "numeric") & (F.col("moments.n") > 0)
    out = sums.withColumns({"mean": F.when(some, F.col("moments.mean")), "m2": F.when(some, F.col("moments.m2")), "quantiles": F.when(F.col("col_type") == "numeric", F.col("quantiles"))})
    return out.select(*[x.split()[0] for x in STATE.split(", ")])


def stats_of(states: DataFrame, quantiles: list[float] | None = None) -> DataFrame:
    """The statistics of states, under the names of a profile: n_unique is an estimate, the deviation the sample's, the extremes of text are those in order of bytes. quantiles: further columns q<percent>, estimates too."""
    n = F.col("n_total") - F.col("n_missing")
    shown = F.coalesce(F.col("low").cast("string"), "first"), F.coalesce(F.col("high").cast("string"), "last")
    more = [F.when((F.col("col_type") == "numeric") & (n > 0), F.kll_sketch_get_quantile_double("quantiles", F.lit(q))).alias(f"q{q * 100:g}") for q in quantiles or []]
    return states.select("column_name", "dt", "col_type", "n_total", "n_missing", F.hll_sketch_estimate("distinct").alias("n_unique"), "mean", F.when(n > 1, F.sqrt(F.col("m2") / (n - 1))).alias("std"), shown[0].alias("min_val"), shown[1].alias("max_val"), *more)
