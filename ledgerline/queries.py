"""The registered queries of the reconciliation library, each with the SQL that must give the same rows.

Left is orders; right is a replica with known differences: some rows and the first days are gone, some prices and priorities changed.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions import dates as D
from ledgerline.functions import learning
from ledgerline.functions import predicates as P
from ledgerline.functions import scalars as S
from ledgerline.functions.datetypes import DateColumn
from ledgerline.functions.intervals import DaySet
from ledgerline.operators import diff, mapping, profile, reconcile, rowcount, states
from ledgerline.operators.digests import digest_diff
from ledgerline.plans.runner import Outcome, run_project
from ledgerline.plans.spec import Project
from ledgerline.session import new_folder
from ledgerline.sources import readers
from ledgerline.sources.store import Store
from ledgerline.streaming.increments import daily_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None):
    """Register a query and, where SQL can express it, its SQL."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def replica(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    rows = orders.where((k % 37 != 0) & P.between_dates(F.col("o_orderdate"), "1995-01-15"))
    return rows.withColumns({"o_totalprice": F.when(k % 101 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")), "o_orderpriority": F.when(k % 89 == 0, "5-LOW").otherwise(F.col("o_orderpriority"))})


RIGHT = "(SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 101 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderdate, CASE WHEN o_orderkey % 89 = 0 THEN '5-LOW' ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey % 37 <> 0 AND o_orderdate >= TIMESTAMP '1995-01-15')"


def sides(spark, d) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, d, "orders")
    return orders, replica(orders)


def gaps(orders: DataFrame) -> DataFrame:
    """orders with missing values put in."""
    k = F.col("o_orderkey")
    return orders.withColumns({"o_orderpriority": F.when(k % 11 == 0, None).when(k % 13 == 0, " ").otherwise(F.col("o_orderpriority")), "o_totalprice": F.when(k % 7 == 0, None).when(k % 17 == 0, float("nan")).otherwise(F.col("o_totalprice"))})


GAPS = "(SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN ' ' ELSE o_orderpriority END AS o_orderpriority, CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice FROM orders)"

# --- row counts ---


def _trunc(column: str, vintage: str) -> str:
    return "'all'" if vintage == "all" else f"strftime(date_trunc('{vintage}', {column}), '%Y-%m-%d')"


for _v in (*D.VINTAGES, "all"):
    query(f"a_rowcount_{_v}", f"SELECT {_trunc('o_orderdate', _v)} AS dt, count(*) AS row_count FROM orders GROUP BY 1")(lambda spark, d, v=_v: rowcount.row_counts(table(spark, d, "orders"), "o_orderdate", v))
query("a_rowcount_lineitem", "SELECT strftime(l_shipdate, '%Y-%m-%d') AS dt, count(*) AS row_count FROM lineitem GROUP BY 1")(lambda spark, d: rowcount.row_counts(table(spark, d, "lineitem"), "l_shipdate"))
query("a_events_window", "SELECT strftime(ts, '%Y-%m-%d') AS dt, count(*) AS row_count FROM events GROUP BY 1")(lambda spark, d: daily_counts(table(spark, d, "events"), "ts"))

# --- profiles ---

_STATS = ["column_name", "dt", "n_total", "n_missing", "n_unique"]


def numeric_out(p: DataFrame, places: int = 4) -> DataFrame:
    return p.select(*_STATS, F.round("mean", places).alias("mean"), F.round("std", 4).alias("std"), F.round(F.col("min_val").cast("double"), 4).alias("min_val"), F.round(F.col("max_val").cast("double"), 4).alias("max_val"))


def numeric_sql(source: str, columns: list[str], dt: str, places: int = 4) -> str:
    one = "SELECT '{c}' AS column_name, {dt} AS dt, count(*) AS n_total, count(*) - count({c}) AS n_missing, count(DISTINCT {c}) AS n_unique, round(avg(CAST({c} AS DOUBLE)), {places}) AS mean, round(stddev_samp(CAST({c} AS DOUBLE)), 4) AS std, round(CAST(min({c}) AS DOUBLE), 4) AS min_val, round(CAST(max({c}) AS DOUBLE), 4) AS max_val FROM {source} GROUP BY ALL"
    return " UNION ALL ".join(one.format(c=c, dt=dt, source=source, places=places) for c in columns)


#: Means of real prices can lie on a rounding tie, their sums cannot: the mean times the number of values, in cents.
_SUMMED = ["column_name", "dt", "n_total", "n_missing", "n_unique"]


def summed_out(p: DataFrame) -> DataFrame:
    return p.select(*_SUMMED, F.round(F.col("mean") * (F.col("n_total") - F.col("n_missing")), 2).alias("total"), F.round("std", 4).alias("std"))


def summed_sql(source: str, columns: list[str], dt: str) -> str:
    one = "SELECT '{c}' AS column_name, {dt} AS dt, count(*) AS n_total, count(*) - count({c}) AS n_missing, count(DISTINCT {c}) AS n_unique, round(sum(CAST({c} AS DOUBLE)), 2) AS total, round(stddev_samp(CAST({c} AS DOUBLE)), 4) AS std FROM {source} GROUP BY ALL"
    return " UNION ALL ".join(one.format(c=c, dt=dt, source=source) for c in columns)


def categorical_out(p: DataFrame) -> DataFrame:
    return p.select(*_STATS, F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "min_val", "max_val", "top_10")


def categorical_sql(source: str, columns: list[str], dt: str) -> str:
    freq = " UNION ALL ".join(f"SELECT {dt} AS dt, '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM {source} GROUP BY ALL" for c in columns)
    return f"""
WITH freq AS ({freq}),
r AS (SELECT *, (value IS NOT NULL AND length(trim(value)) > 0) AS present FROM freq),
k AS (SELECT *, row_number() OVER (PARTITION BY dt, column_name, present ORDER BY upper(value), value) AS alpha, row_number() OVER (PARTITION BY dt, column_name, present ORDER BY n DESC, value) AS place FROM r)
SELECT column_name, dt, CAST(sum(n) AS BIGINT) AS n_total, CAST(coalesce(sum(n) FILTER (WHERE NOT present), 0) AS BIGINT) AS n_missing, count(*) FILTER (WHERE present) AS n_unique,
  round(sum(n * alpha) FILTER (WHERE present) / CAST(sum(n) FILTER (WHERE present) AS DOUBLE), 4) AS mean,
  round(sqrt(greatest(0, sum(n * alpha * alpha) FILTER (WHERE present) / CAST(sum(n) FILTER (WHERE present) AS DOUBLE) - power(sum(n * alpha) FILTER (WHERE present) / CAST(sum(n) FILTER (WHERE present) AS DOUBLE), 2))), 4) AS std,
  arg_min(value || '=' || n, alpha) FILTER (WHERE present) AS min_val, arg_max(value || '=' || n, alpha) FILTER (WHERE present) AS max_val,
  string_agg(value || '(' || n || ')', '; ' ORDER BY n DESC, value) FILTER (WHERE present AND place <= 10) AS top_10
FROM k GROUP BY 1, 2"""


_MONTH = _trunc("o_orderdate", "month")
_FLAGS = ["o_orderstatus", "o_orderpriority"]
query("p_numeric_month", summed_sql(GAPS, ["o_totalprice", "o_custkey"], _MONTH))(lambda spark, d: summed_out(profile.numeric_profile(gaps(table(spark, d, "orders")), ["o_totalprice", "o_custkey"], "o_orderdate", "month")))
query("p_numeric_extremes", "SELECT column_name, dt, min_val, max_val FROM (" + numeric_sql(GAPS, ["o_totalprice", "o_custkey"], _MONTH) + ")")(lambda spark, d: numeric_out(profile.numeric_profile(gaps(table(spark, d, "orders")), ["o_totalprice", "o_custkey"], "o_orderdate", "month")).select("column_name", "dt", "min_val", "max_val"))
query("p_numeric_all", numeric_sql("lineitem", ["l_quantity", "l_discount", "l_tax", "l_linenumber"], "'all'"))(lambda spark, d: numeric_out(profile.numeric_profile(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax", "l_linenumber"])))
query("p_numeric_by_day", numeric_sql("lineitem", ["l_quantity", "l_linenumber"], "strftime(l_shipdate, '%Y-%m-%d')", 6))(lambda spark, d: numeric_out(profile.numeric_profile(table(spark, d, "lineitem"), ["l_quantity", "l_linenumber"], "l_shipdate", "day"), 6))
query("p_categorical_month", categorical_sql(GAPS, _FLAGS, _MONTH))(lambda spark, d: categorical_out(profile.categorical_profile(gaps(table(spark, d, "orders")), _FLAGS, "o_orderdate", "month")))
query("p_categorical_all", categorical_sql("part", ["p_brand", "p_type"], "'all'"))(lambda spark, d: categorical_out(profile.categorical_profile(table(spark, d, "part"), ["p_brand", "p_type"])))
query("p_categorical_text", categorical_sql("conversations", ["role"], "'all'"))(lambda spark, d: categorical_out(profile.categorical_profile(table(spark, d, "conversations"), ["role"])))
query("p_freq", f"SELECT {_MONTH} AS dt, 'o_orderpriority' AS column_name, o_orderpriority AS value, count(*) AS n FROM {GAPS} GROUP BY ALL")(lambda spark, d: profile.frequencies(gaps(table(spark, d, "orders")), ["o_orderpriority"], "o_orderdate", "month"))
query("p_freq_moments", f"SELECT dt, 'o_orderpriority' AS column_name, round(avg(n), 4) AS mean_n, round(stddev_samp(n), 4) AS std_n, min(n) AS min_n, max(n) AS max_n, CAST(sum(n) AS BIGINT) AS sum_n, CAST(sum(n * n) AS BIGINT) AS sum_sq_n FROM (SELECT {_MONTH} AS dt, o_orderpriority AS v, count(*) AS n FROM {GAPS} WHERE o_orderpriority IS NOT NULL GROUP BY 1, 2) GROUP BY 1")(
    lambda spark, d: profile.frequency_moments(gaps(table(spark, d, "orders")), ["o_orderpriority"], "o_orderdate", "month").withColumns({c: F.round(c, 4) for c in ("mean_n", "std_n")})
)
query("p_top10", f"SELECT column_name, dt, top_10 FROM ({categorical_sql('customer', ['c_mktsegment', 'c_name'], chr(39) + 'all' + chr(39))})")(lambda spark, d: profile.categorical_profile(table(spark, d, "customer"), ["c_mktsegment", "c_name"]).select("column_name", "dt", "top_10"))
query("p_top10_rows", f"SELECT * FROM (SELECT dt, 'o_custkey' AS column_name, value, n, CAST(row_number() OVER (PARTITION BY dt ORDER BY n DESC, value) AS INTEGER) AS place FROM (SELECT {_MONTH} AS dt, CAST(o_custkey AS VARCHAR) AS value, count(*) AS n FROM orders GROUP BY 1, 2)) WHERE place <= 10")(
    lambda spark, d: profile.top_values(table(spark, d, "orders"), ["o_custkey"], "o_orderdate", "month")
)
_BOTH_SQL = f"SELECT * FROM ({summed_sql(GAPS, ['o_orderkey', 'o_custkey', 'o_totalprice'], _trunc('o_orderdate', 'year'))}) UNION ALL SELECT column_name, dt, n_total, n_missing, n_unique, round(mean * (n_total - n_missing), 0) AS total, round(std, 3) AS std FROM ({categorical_sql(GAPS, _FLAGS, _trunc('o_orderdate', 'year'))})"


@query("p_profile_table", _BOTH_SQL)
def p_profile_table(spark, d):
    p = profile.profile(gaps(table(spark, d, "orders")), "o_orderdate", "year")
    numeric = F.col("col_type") == "numeric"
    rounded = p.withColumns({"mean": F.when(numeric, F.col("mean")).otherwise(F.round("mean", 4)), "std": F.when(numeric, F.col("std")).otherwise(F.round(F.round("std", 4), 3))})
    return summed_out(rounded).withColumn("total", F.when(F.col("column_name").isin(_FLAGS), F.round("total", 0)).otherwise(F.col("total")))


@query("p_profile_raw", f"SELECT column_name, dt, n_total, n_missing, n_unique, mean FROM ({numeric_sql('(SELECT o_orderdate, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP ' + chr(39) + '1996-03-05' + chr(39) + ' AND o_orderdate < TIMESTAMP ' + chr(39) + '1996-07-21' + chr(39) + ')', ['o_totalprice'], _trunc('o_orderdate', 'month'))})")
def p_profile_raw(spark, d):
    """From text: dates parsed, the range applied to them, numbers parsed, then bucketed."""
    raw = table(spark, d, "orders").select(F.upper(F.date_format("o_orderdate", "ddMMMyyyy")).alias("day"), F.col("o_totalprice").cast("string").alias("o_totalprice"))
    read = raw.withColumn("dt", D.parse_date(F.col("day"))).where(P.canonical_range(F.col("dt"), "1996-03-05", "1996-07-20"))
    rows = read.select(F.to_date("dt").alias("day"), S.to_number(F.col("o_totalprice")).alias("o_totalprice"))
    return numeric_out(profile.numeric_profile(rows, ["o_totalprice"], "day", "month")).select("column_name", "dt", "n_total", "n_missing", "n_unique", "mean")


@query("s_raw_buckets", "SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS dt, count(*) AS n, count(DISTINCT o_orderpriority) AS n_priorities FROM orders WHERE date_trunc('month', o_orderdate) BETWEEN DATE '1996-03-01' AND DATE '1996-07-01' GROUP BY 1")
def s_raw_buckets(spark, d):
    """Dates as text, bucketed by month; the range holds for the bucket, so July is there whole."""
    raw = table(spark, d, "orders").select(D.write_date(F.col("o_orderdate").cast("date"), "DDMONYYYY").alias("day"), "o_orderpriority")
    return readers.in_buckets(raw, "day", ["o_orderpriority"], "month", "1996-03-01", "1996-07-01").groupBy("dt").agg(F.count("*").alias("n"), F.count_distinct("o_orderpriority").alias("n_priorities"))


query("p_inferred_types", "SELECT CASE WHEN avg(CASE WHEN try_cast(CAST(o_totalprice AS VARCHAR) AS DOUBLE) IS NULL THEN 0.0 ELSE 1.0 END) > 0.9 THEN 'numeric' ELSE 'categorical' END AS o_totalprice, CASE WHEN avg(CASE WHEN try_cast(o_orderpriority AS DOUBLE) IS NULL THEN 0.0 ELSE 1.0 END) > 0.9 THEN 'numeric' ELSE 'categorical' END AS o_orderpriority, CASE WHEN avg(CASE WHEN o_orderkey % 11 = 0 THEN 0.0 ELSE 1.0 END) > 0.9 THEN 'numeric' ELSE 'categorical' END AS mostly FROM orders")(
    lambda spark, d: table(spark, d, "orders").select(F.col("o_totalprice").cast("string").alias("o_totalprice"), "o_orderpriority", F.when(F.col("o_orderkey") % 11 == 0, "n/a").otherwise(F.col("o_orderkey").cast("string")).alias("mostly")).agg(*[profile.inferred_type(F.col(c)).alias(c) for c in ("o_totalprice", "o_orderpriority", "mostly")])
)

# --- profiles that add up ---


def state_out(merged: DataFrame) -> DataFrame:
    """What is exact in the statistics of states: means and deviations as sums in cents and rounded."""
    p = states.stats_of(merged)
    return p.select("column_name", "dt", "n_total", "n_missing", F.round(F.col("mean") * (F.col("n_total") - F.col("n_missing")), 2).alias("total"), F.round("std", 4).alias("std"), *[F.round(F.col(c).cast("double"), 4).alias(c) for c in ("min_val", "max_val")])


def state_sql(source: str, columns: list[str], dt: str) -> str:
    one = "SELECT '{c}' AS column_name, {dt} AS dt, count(*) AS n_total, count(*) - count({c}) AS n_missing, round(sum(CAST({c} AS DOUBLE)), 2) AS total, round(stddev_samp(CAST({c} AS DOUBLE)), 4) AS std, round(CAST(min({c}) AS DOUBLE), 4) AS min_val, round(CAST(max({c}) AS DOUBLE), 4) AS max_val FROM {source} GROUP BY ALL"
    return " UNION ALL ".join(one.format(c=c, dt=dt, source=source) for c in columns)


_SUMMABLE = ["o_totalprice", "o_custkey"]


def day_states(spark, d) -> DataFrame:
    return states.profile_states(gaps(table(spark, d, "orders")), "o_orderdate", "day", _SUMMABLE)


for _v in ("month", "quarter", "all"):
    query(f"p_states_{_v}", state_sql(GAPS, _SUMMABLE, _trunc("o_orderdate", _v)))(lambda spark, d, v=_v: state_out(states.merged_states(day_states(spark, d), v)))


@query("p_states_increment", state_sql(GAPS, _SUMMABLE, _trunc("o_orderdate", "month")))
def p_states_increment(spark, d):
    """Months from three increments of the table, each profiled by itself."""
    orders = gaps(table(spark, d, "orders"))
    parts = [states.profile_states(orders.where(F.col("o_orderkey") % 3 == i), "o_orderdate", "month", _SUMMABLE) for i in range(3)]
    return state_out(states.merged_states(reduce(DataFrame.unionByName, parts), "month"))


@query("p_states_distinct", f"SELECT column_name, dt, TRUE AS close FROM ({numeric_sql(GAPS, _SUMMABLE, _trunc('o_orderdate', 'year'))}) UNION ALL SELECT 'o_orderpriority', {_trunc('o_orderdate', 'year')}, TRUE FROM orders GROUP BY 2")
def p_states_distinct(spark, d):
    """Whether distinct counts of merged day states are within five standard errors of the exact ones."""
    orders, columns = gaps(table(spark, d, "orders")), [*_SUMMABLE, "o_orderpriority"]
    estimated = states.stats_of(states.merged_states(states.profile_states(orders, "o_orderdate", "day", columns), "year")).select("column_name", "dt", F.col("n_unique").alias("estimate"))
    exact = profile.profile(orders.select("o_orderdate", *columns), "o_orderdate", "year").select("column_name", "dt", "n_unique")
    return estimated.join(exact, ["column_name", "dt"]).select("column_name", "dt", (F.abs(F.col("estimate") - F.col("n_unique")) <= 0.08 * F.col("n_unique")).alias("close"))


# --- row reconciliation ---

_COMPARED = f"""
l AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS dt, count(*) AS row_count FROM orders GROUP BY 1),
r AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS dt, count(*) AS row_count FROM {RIGHT} GROUP BY 1),
o AS (SELECT greatest((SELECT min(dt) FROM l), (SELECT min(dt) FROM r)) AS a, least((SELECT max(dt) FROM l), (SELECT max(dt) FROM r)) AS z),
c AS (SELECT coalesce(l.dt, r.dt) AS dt, l.row_count AS left_count, r.row_count AS right_count, r.row_count - l.row_count AS diff,
  CASE WHEN l.dt IS NULL THEN 'right_only' WHEN r.dt IS NULL THEN 'left_only' WHEN l.row_count = r.row_count THEN 'match' ELSE 'mismatch' END AS status,
  coalesce(coalesce(l.dt, r.dt) BETWEEN (SELECT a FROM o) AND (SELECT z FROM o), FALSE) AS in_overlap FROM l FULL JOIN r ON l.dt = r.dt)"""


def compared_rows(spark, d) -> DataFrame:
    left, right = sides(spark, d)
    return reconcile.compare_rows(rowcount.row_counts(left, "o_orderdate"), rowcount.row_counts(right, "o_orderdate"))


def row_query(name: str, sql: str, f: Callable[[DataFrame], DataFrame]) -> None:
    query(name, f"WITH {_COMPARED} {sql}")(lambda spark, d: f(compared_rows(spark, d)))


_OUT = "(status = 'mismatch' OR (in_overlap AND status IN ('left_only', 'right_only')))"
row_query("r_row_compare", "SELECT * FROM c", lambda c: c)
row_query("r_row_summary", "SELECT min(dt) FILTER (WHERE left_count IS NOT NULL) AS left_first, max(dt) FILTER (WHERE left_count IS NOT NULL) AS left_last, min(dt) FILTER (WHERE right_count IS NOT NULL) AS right_first, max(dt) FILTER (WHERE right_count IS NOT NULL) AS right_last, CAST(sum(left_count) AS BIGINT) AS left_total, CAST(sum(right_count) AS BIGINT) AS right_total, count(left_count) AS left_dates, count(right_count) AS right_dates, count(*) FILTER (WHERE status = 'match') AS n_match, count(*) FILTER (WHERE status = 'mismatch') AS n_mismatch, count(*) FILTER (WHERE status = 'left_only') AS n_left_only, count(*) FILTER (WHERE status = 'right_only') AS n_right_only, count(*) FILTER (WHERE in_overlap AND status IN ('left_only', 'right_only')) AS n_misload FROM c", reconcile.row_summary)
row_query("r_row_overlap", "SELECT a AS overlap_start, z AS overlap_end FROM o WHERE a <= z", reconcile.overlap)
row_query("r_misload", "SELECT dt, status FROM c WHERE in_overlap AND status IN ('left_only', 'right_only')", lambda c: reconcile.misloads(c).select("dt", "status"))
row_query("r_excluded_dates", f"SELECT dt, CASE WHEN status = 'mismatch' THEN 'mismatch' ELSE 'misload' END AS reason FROM c WHERE {_OUT}", reconcile.excluded_dates)
row_query("r_matching_dates", f"SELECT string_agg(dt, ',' ORDER BY dt) FILTER (WHERE status = 'match' AND dt <> '1996-01-03') AS matching, string_agg(dt, ',' ORDER BY dt) FILTER (WHERE {_OUT} OR (status = 'match' AND dt = '1996-01-03')) AS excluded, string_agg(dt, ',' ORDER BY dt) FILTER (WHERE {_OUT}) AS non_matching FROM c", lambda c: reconcile.matching_dates(c, ["1996-01-03"]).select(*[F.when(F.size(n) > 0, F.array_join(n, ",")).alias(n) for n in ("matching", "excluded", "non_matching")]))
row_query("r_row_export", f"SELECT status AS category, in_overlap, {_OUT} AS excluded, dt AS date, coalesce(left_count, 0) AS left_count, coalesce(right_count, 0) AS right_count, coalesce(right_count, 0) - coalesce(left_count, 0) AS diff FROM c", reconcile.row_export)
row_query("r_count_export", "SELECT dt, left_count AS row_count FROM c WHERE in_overlap AND left_count IS NOT NULL", lambda c: c.where("in_overlap and left_count is not null").select("dt", F.col("left_count").alias("row_count")))
row_query("u_date_union", "SELECT DISTINCT dt FROM (SELECT dt FROM l UNION SELECT dt FROM r)", lambda c: c.select("dt").distinct())
row_query("u_date_intersect", "SELECT dt FROM l INTERSECT SELECT dt FROM r", lambda c: c.where("left_count is not null").select("dt").intersect(c.where("right_count is not null").select("dt")))
row_query("u_date_except", "SELECT dt FROM l EXCEPT SELECT dt FROM r", lambda c: c.where("left_count is not null").select("dt").exceptAll(c.where("right_count is not null").select("dt")))
row_query("t_limit", "SELECT dt, left_count FROM c ORDER BY dt DESC LIMIT 20", lambda c: c.select("dt", "left_count").orderBy(F.desc("dt")).limit(20))
query("u_sample_dates", "SELECT dt FROM (SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS dt FROM orders WHERE o_orderdate IS NOT NULL) ORDER BY md5('2025 ' || dt), dt LIMIT 15")(
    lambda spark, d: spark.createDataFrame([(x,) for x in rowcount.sample_dates(rowcount.row_counts(table(spark, d, "orders"), "o_orderdate"), 15)], "dt string")
)


@query("r_bucket_check", f"WITH {_COMPARED} SELECT CASE WHEN count(*) FILTER (WHERE status LIKE '%only') = 0 THEN 'PASS' ELSE 'WARNING' END AS result, min(dt) FILTER (WHERE status LIKE '%only') AS first_divergence, count(*) FILTER (WHERE status = 'left_only') AS n_left_only, count(*) FILTER (WHERE status = 'right_only') AS n_right_only FROM c")
def r_bucket_check(spark, d):
    return reconcile.bucket_check(*[rowcount.row_counts(s, "o_orderdate") for s in sides(spark, d)])


@query("r_new_updated", f"WITH {_COMPARED} SELECT l.dt, CASE WHEN r.dt IS NULL THEN 'new' ELSE 'updated' END AS state FROM l LEFT JOIN r ON l.dt = r.dt")
def r_new_updated(spark, d):
    left, right = sides(spark, d)
    return reconcile.new_and_updated(rowcount.row_counts(right, "o_orderdate"), rowcount.row_counts(left, "o_orderdate"))


def spellings(spark, d) -> DataFrame:
    """Daily counts in which every date comes in two spellings with different counts."""
    days = rowcount.row_counts(table(spark, d, "orders"), "o_orderdate")
    day = F.to_date("dt")
    return days.select(F.explode(F.array(F.struct(D.write_date(day, "DDMONYYYY").alias("dt"), F.col("row_count")), F.struct(D.write_date(day, "YYYYMMDD").alias("dt"), (F.col("row_count") + F.dayofmonth(day) % 3 - 1).alias("row_count")))).alias("s")).select("s.*")


_SPELLED = "d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1)"
query("r_dedup_max", f"WITH {_SPELLED} SELECT strftime(day, '%Y-%m-%d') AS dt, greatest(n, n + day(day) % 3 - 1) AS row_count FROM d")(lambda spark, d: rowcount.canonical(spellings(spark, d)))
query("r_range_filtered", f"WITH {_SPELLED} SELECT strftime(day, '%Y-%m-%d') AS dt, greatest(n, n + day(day) % 3 - 1) AS row_count FROM d WHERE day BETWEEN DATE '1998-02-03' AND DATE '1998-11-30'")(lambda spark, d: rowcount.canonical(spellings(spark, d), "1998-02-03", "1998-11-30"))
query("r_dedup_last", "SELECT strftime(o_orderdate, '%Y-%m-%d') AS dt, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")(lambda spark, d: rowcount.keep_last(table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("dt"), "o_orderkey"), ["dt"], F.col("o_orderkey")))

# --- column reconciliation ---

_COLUMNS = ["o_orderkey", "o_custkey", "o_totalprice", *_FLAGS]


def profiles_sql(source: str) -> str:
    dt = _trunc("o_orderdate", "month")
    return f"SELECT column_name, dt, 'numeric' AS col_type, n_total, n_missing, n_unique, mean, std, CAST(min_val AS VARCHAR) AS min_val, CAST(max_val AS VARCHAR) AS max_val FROM ({numeric_sql(source, _COLUMNS[:3], dt)}) UNION ALL SELECT column_name, dt, 'categorical', n_total, n_missing, n_unique, mean, std, min_val, max_val FROM ({categorical_sql(source, _FLAGS, dt)})"


def compared_profiles(spark, d) -> DataFrame:
    return reconcile.compare_profiles(*[profile.profile(s, "o_orderdate", "month") for s in sides(spark, d)], vintage="month")


_PROFILED = f"""
a AS ({profiles_sql('orders')}), b AS ({profiles_sql(RIGHT)}),
j AS (SELECT a.column_name AS left_col, a.dt, a.col_type, a.n_total AS n_total_left, b.n_total - a.n_total AS n_total_diff, b.n_missing - a.n_missing AS n_missing_diff, b.n_unique - a.n_unique AS n_unique_diff,
  a.mean = b.mean AS mean_match, a.std = b.std AS std_match, a.min_val = b.min_val AS min_match, a.max_val = b.max_val AS max_match, strftime(CAST(a.dt AS DATE), '%b %Y') AS vintage_label FROM a JOIN b USING (column_name, dt)),
h AS (SELECT *, (n_total_diff <> 0 OR n_missing_diff <> 0 OR n_unique_diff <> 0 OR NOT coalesce(mean_match, TRUE) OR NOT coalesce(std_match, TRUE) OR NOT coalesce(min_match, TRUE) OR NOT coalesce(max_match, TRUE)) AS has_diff,
  CASE WHEN n_total_diff <> 0 THEN 'n_total ' || printf('%.1f', round(abs(n_total_diff / n_total_left) * 100, 1)) || '%' WHEN n_missing_diff <> 0 THEN 'n_missing' WHEN col_type = 'numeric' AND NOT coalesce(mean_match, TRUE) THEN 'mean' WHEN n_unique_diff <> 0 THEN 'n_unique' ELSE 'other' END AS worst FROM j)"""


def column_query(name: str, sql: str, f: Callable[[DataFrame], DataFrame]) -> None:
    query(name, f"WITH {_PROFILED} {sql}")(lambda spark, d: f(compared_profiles(spark, d)))


_J = ["left_col", "dt", "col_type", "n_total_diff", "n_missing_diff", "n_unique_diff", "mean_match", "std_match", "min_match", "max_match"]
column_query("r_col_compare", f"SELECT {', '.join(_J)} FROM h", lambda c: c.select(*_J))
column_query("r_has_diff", "SELECT left_col, dt, has_diff FROM h", lambda c: c.select("left_col", "dt", "has_diff"))
column_query("r_worst_stat", "SELECT left_col, dt, worst FROM h", lambda c: c.select("left_col", "dt", "worst"))
column_query("r_diff_map", "SELECT vintage_label, left_col, worst FROM h WHERE has_diff", reconcile.diff_map)
column_query("r_col_summary", "SELECT left_col, left_col AS right_col, count(*) AS n_vintages, count(*) FILTER (WHERE has_diff) AS n_diff, max(has_diff) AS has_diff, FALSE AS type_mismatch FROM h GROUP BY 1", reconcile.column_summary)
column_query("r_diff_first", "SELECT left_col, CAST(row_number() OVER (ORDER BY max(has_diff) DESC, left_col) AS INTEGER) AS place FROM h GROUP BY 1", lambda c: reconcile.column_summary(c).select("left_col", F.row_number().over(Window.orderBy(F.desc("has_diff"), "left_col")).alias("place")))
query("r_latest_stat", f"SELECT column_name, dt, n_total, n_unique FROM ({profiles_sql('orders')}) WHERE dt = (SELECT max({_MONTH}) FROM orders)")(lambda spark, d: reconcile.latest_stats(profile.profile(table(spark, d, "orders"), "o_orderdate", "month")).select("column_name", "dt", "n_total", "n_unique"))


@query("r_type_resolution", "SELECT column_name AS c, CASE WHEN column_name = 'o_custkey' THEN 'categorical' WHEN column_name = 'o_orderkey' THEN 'numeric' WHEN column_name = 'o_totalprice' THEN 'categorical' WHEN column_type IN ('BIGINT', 'INTEGER', 'DOUBLE') THEN 'numeric' ELSE 'categorical' END AS resolved FROM (DESCRIBE orders)")
def r_type_resolution(spark, d):
    """Types of orders against those of a copy with two columns as text; an override settles one of the two and one that agrees."""
    orders = table(spark, d, "orders")
    left, right = (profile.column_types(x) for x in (orders, orders.withColumns({c: F.col(c).cast("string") for c in ("o_totalprice", "o_orderkey")})))
    overrides = {"o_orderkey": "numeric", "o_custkey": "categorical"}
    rows = [(c, left[c], right[c], overrides.get(c)) for c in orders.columns]
    return spark.createDataFrame(rows, "c string, l string, r string, o string").select("c", reconcile.resolved_type(F.col("l"), F.col("r"), F.col("o")).alias("resolved"))


@query("r_pair_summary", f"WITH {_PROFILED} SELECT count(DISTINCT left_col) AS n_matched, count(DISTINCT left_col) FILTER (WHERE has_diff) AS n_diff, 'o_orderdate' AS left_only, 'extra,o_orderdate' AS right_only, 0 AS type_mismatches, count(DISTINCT dt) AS n_vintages FROM h")
def r_pair_summary(spark, d):
    left, right = sides(spark, d)
    out = reconcile.pair_summary(compared_profiles(spark, d), left.columns, [*right.columns, "extra"])
    return out.withColumns({c: F.array_join(c, ",") for c in ("left_only", "right_only")}).withColumn("type_mismatches", F.col("type_mismatches").cast("int"))


query("r_pass_fail", f"WITH {_PROFILED} SELECT left_col, " + ", ".join(f"max(CASE WHEN dt = '1996-{m:02d}-01' THEN CASE WHEN has_diff THEN 'FAIL ' || worst ELSE 'PASS' END END) AS \"{n} 1996\"" for m, n in ((1, "Jan"), (7, "Jul"))) + " FROM h GROUP BY 1")(
    lambda spark, d: reconcile.pass_fail(compared_profiles(spark, d)).select("left_col", "Jan 1996", "Jul 1996")
)

# --- record differences ---

_KEYED = f"j AS (SELECT l.o_orderkey AS lk, r.o_orderkey AS rk, CAST(coalesce(l.o_orderkey, r.o_orderkey) AS VARCHAR) AS o_orderkey, l.o_orderpriority AS lp, r.o_orderpriority AS rp, CAST(l.o_totalprice AS VARCHAR) AS lt, CAST(r.o_totalprice AS VARCHAR) AS rt FROM orders l FULL JOIN {RIGHT} r ON l.o_orderkey = r.o_orderkey)"


def order_diff(spark, d) -> diff.KeyedDiff:
    return diff.keyed_diff(*sides(spark, d), ["o_orderkey"], ["o_orderpriority", "o_totalprice", "o_orderkey", "absent"])


query("r_keyed_diff", f"WITH {_KEYED} SELECT count(*) FILTER (WHERE lk IS NOT NULL AND rk IS NOT NULL) AS matched, count(*) FILTER (WHERE rk IS NULL) AS only_left, count(*) FILTER (WHERE lk IS NULL) AS only_right, count(*) FILTER (WHERE lp <> rp) + count(*) FILTER (WHERE lt <> rt) AS total_mismatches, CAST((count(*) FILTER (WHERE lp <> rp) > 0) AS BIGINT) + CAST((count(*) FILTER (WHERE lt <> rt) > 0) AS BIGINT) AS cols_with_mismatches FROM j")(lambda spark, d: order_diff(spark, d).summary())
query("r_keyed_diff_columns", f"WITH {_KEYED} SELECT 'o_orderpriority' AS column_name, count(*) FILTER (WHERE lp <> rp) AS mismatches FROM j UNION ALL SELECT 'o_totalprice', count(*) FILTER (WHERE lt <> rt) FROM j")(lambda spark, d: order_diff(spark, d).by_column())
query("r_keyed_examples", f"WITH {_KEYED} SELECT * FROM (SELECT 'o_orderpriority' AS column_name, o_orderkey, lp AS left_value, rp AS right_value, CAST(row_number() OVER (ORDER BY o_orderkey) AS INTEGER) AS place FROM j WHERE lp <> rp) WHERE place <= 10")(
    lambda spark, d: order_diff(spark, d).examples(10).where("column_name = 'o_orderpriority'")
)
query("r_keyed_diff_composite", "WITH r AS (SELECT * FROM lineitem WHERE l_orderkey % 41 <> 0) SELECT count(*) FILTER (WHERE r.l_orderkey IS NOT NULL AND l.l_orderkey IS NOT NULL) AS matched, count(*) FILTER (WHERE r.l_orderkey IS NULL) AS only_left, count(*) FILTER (WHERE l.l_orderkey IS NULL) AS only_right, count(*) FILTER (WHERE l.l_returnflag <> r.l_returnflag) AS total_mismatches, CAST((count(*) FILTER (WHERE l.l_returnflag <> r.l_returnflag) > 0) AS BIGINT) AS cols_with_mismatches FROM lineitem l FULL JOIN r ON l.l_orderkey = r.l_orderkey AND l.l_linenumber = r.l_linenumber")(
    lambda spark, d: diff.keyed_diff(table(spark, d, "lineitem"), table(spark, d, "lineitem").where("l_orderkey % 41 <> 0"), ["l_orderkey", "l_linenumber"], ["l_returnflag"]).summary()
)
_DIGESTED = "SELECT count(*) FILTER (WHERE lk IS NOT NULL AND rk IS NOT NULL) AS matched, count(*) FILTER (WHERE rk IS NULL) AS only_left, count(*) FILTER (WHERE lk IS NULL) AS only_right, count(*) FILTER (WHERE lp <> rp) + count(*) FILTER (WHERE lt <> rt) AS total_mismatches, CAST((count(*) FILTER (WHERE lp <> rp) > 0) AS BIGINT) + CAST((count(*) FILTER (WHERE lt <> rt) > 0) AS BIGINT) AS cols_with_mismatches FROM j"
query("r_digest_diff", f"WITH {_KEYED} {_DIGESTED}")(lambda spark, d: digest_diff(*sides(spark, d), ["o_orderkey"], ["o_orderpriority", "o_totalprice", "absent"]).summary())
query("r_digest_columns", f"WITH {_KEYED} SELECT 'o_orderpriority' AS column_name, count(*) FILTER (WHERE lp <> rp) AS mismatches FROM j UNION ALL SELECT 'o_totalprice', count(*) FILTER (WHERE lt <> rt) FROM j")(lambda spark, d: digest_diff(*sides(spark, d), ["o_orderkey"], ["o_orderpriority", "o_totalprice"]).by_column())
query("r_repeated_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")(lambda spark, d: diff.repeated_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]))



@query("r_keyed_diff_blank_keys", "SELECT (SELECT count(*) FROM orders WHERE o_orderkey % 37 <> 0 AND o_orderkey % 10 <> 0) AS matched, (SELECT count(*) FROM orders WHERE o_orderkey % 37 = 0 OR o_orderkey % 10 = 0) AS only_left, (SELECT count(*) FROM orders WHERE o_orderkey % 37 <> 0 AND o_orderkey % 10 = 0) AS only_right, CAST(0 AS BIGINT) AS total_mismatches, CAST(0 AS BIGINT) AS cols_with_mismatches")
def r_keyed_diff_blank_keys(spark, d):
    """A tenth of the records of either side have no key: they match nothing."""
    orders = table(spark, d, "orders").withColumn("k", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderkey")))
    return diff.keyed_diff(orders, orders.where("o_orderkey % 37 <> 0"), ["k"], ["o_orderstatus"]).summary()


query("r_keyed_diff_warnings", "WITH r AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) SELECT side, 'repeated key' AS kind, count(*) AS n FROM r, (VALUES ('left'), ('right')) s(side) GROUP BY 1")(
    lambda spark, d: diff.keyed_diff(table(spark, d, "lineitem"), table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_returnflag"]).warnings()
)

# --- filters ---


def filtered(name: str, where: str, f: Callable[[DataFrame], DataFrame]) -> None:
    query(name, f"SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS dt FROM orders WHERE {where}")(lambda spark, d: f(table(spark, d, "orders")).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("dt")))


_PICKED = ["1996-01-02", "1996-02-29", "1997-07-04", "2030-01-01"]
_IN = ", ".join(f"DATE '{x}'" for x in _PICKED)
filtered("f_where", "(o_totalprice > 1000 AND o_orderstatus = 'F')", lambda o: o.where(F.expr("(o_totalprice > 1000 AND o_orderstatus = 'F')")))
filtered("f_date_bounds", "CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-03-31'", lambda o: o.where(P.between_dates(F.col("o_orderdate"), "1996-01-01", "1996-03-31")))
filtered("f_between", "strftime(o_orderdate, '%Y%m%d') BETWEEN '19960101' AND '19960331'", lambda o: o.where(P.between_written(F.date_format("o_orderdate", "yyyyMMdd").cast("int"), "YYYYMMDD", "1996-01-01", "1996-03-31", number=True)))
filtered("f_date_in", f"CAST(o_orderdate AS DATE) IN ({_IN})", lambda o: P.in_dates(o, "o_orderdate", _PICKED))
filtered("f_date_semi", f"CAST(o_orderdate AS DATE) IN ({_IN})", lambda o: P.in_dates(o, "o_orderdate", o.sparkSession.createDataFrame([(x,) for x in _PICKED], "dt string")))
filtered("f_range_gaps", "CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-01-10' AND day(o_orderdate) NOT IN (3, 4, 7)", lambda o: P.plan_filter([f"1996-01-{i:02d}" for i in range(1, 11) if i not in (3, 4, 7)], "day").apply(o, "o_orderdate"))
filtered("f_exclude_dates", f"CAST(o_orderdate AS DATE) NOT IN ({_IN})", lambda o: P.except_dates(o, "o_orderdate", _PICKED))
filtered("f_mini_language", "o_orderstatus IN ('F', 'O') AND o_orderpriority LIKE '%U%' AND o_orderpriority <> '1-URGENT' AND o_orderstatus NOT LIKE 'P%'", lambda o: o.where(P.conditions({"o_orderstatus": "F, O", "o_orderpriority": "%U%"}) & P.conditions({"o_orderpriority": "!=1-URGENT", "o_orderstatus": "!~=P%"})))


@query("f_reconciled_where", f"WITH {_COMPARED} SELECT o_orderkey FROM orders WHERE o_totalprice > 500 AND strftime(o_orderdate, '%Y-%m-%d') IN (SELECT dt FROM c WHERE status = 'match')")
def f_reconciled_where(spark, d):
    """Rows of the days that match, with the side's own condition; the days stay a table."""
    return P.in_dates(table(spark, d, "orders").where("o_totalprice > 500"), "o_orderdate", compared_rows(spark, d).where("status = 'match'").select("dt")).select("o_orderkey")


# --- dates as they are stored: each type's column is written from the dates of orders ---

# How DuckDB writes the dates of each type.
_STORED = {"date": None, "timestamp": None, "string_compact": "%Y%m%d", "string_dash": "%Y-%m-%d", "string_mon": "%d%b%Y", "string_mon_dash": "%d-%b-%Y", "string_us": "%m/%d/%Y", "num": "%Y%m%d", "num_yyyymm": "%Y%m"}


def stored(spark, d, kind: str) -> tuple[DataFrame, DateColumn]:
    """orders with its date as a column `d` of the type."""
    day = F.to_date("o_orderdate")
    written = day if kind == "date" else F.col("o_orderdate") if kind == "timestamp" else D.write_date(day, D.DATE_TYPES[kind])
    return table(spark, d, "orders").withColumn("d", written.cast("int") if kind.startswith("num") else written), DateColumn("d", kind)


def _between_stored(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark, d):
        rows, dated = stored(spark, d, kind)
        return rowcount.row_counts(rows.where(dated.between("1996-01-01", "1996-03-31")), dated)

    return run


def _days_stored(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark, d):
        rows, dated = stored(spark, d, kind)
        picked = ["199601", "199702"] if dated.monthly else _PICKED
        return rowcount.row_counts(dated.within(rows, picked), dated).withColumn("kept", F.lit(True)).unionByName(rowcount.row_counts(dated.without(rows, picked), dated, "year").withColumn("kept", F.lit(False)))

    return run


for _kind in _STORED:
    _dt = "strftime(o_orderdate, '%Y%m')" if _kind == "num_yyyymm" else "strftime(o_orderdate, '%Y-%m-%d')"
    _in = "strftime(o_orderdate, '%Y%m') IN ('199601', '199702')" if _kind == "num_yyyymm" else f"CAST(o_orderdate AS DATE) IN ({_IN})"
    query(f"f_bounds_{_kind}", f"SELECT {_dt} AS dt, count(*) AS row_count FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-03-31' GROUP BY 1")(_between_stored(_kind))
    query(f"f_days_{_kind}", f"SELECT {_dt} AS dt, count(*) AS row_count, TRUE AS kept FROM orders WHERE {_in} GROUP BY 1 UNION ALL SELECT {_trunc('o_orderdate', 'year')}, count(*), FALSE FROM orders WHERE NOT ({_in}) GROUP BY 1")(_days_stored(_kind))

def _gaps_stored(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark, d):
        rows, dated = stored(spark, d, kind)
        days = DaySet.between("1992-01-01", "1999-12-31").days()
        chosen = DaySet.between("1995-02-10", "1998-11-20") - DaySet.of(x.isoformat() for x in days if x.day % 2 == 0 and x.month not in (4, 9))
        return rowcount.row_counts(rows.where(dated.inside(chosen)), dated)

    return run


for _kind in _STORED:
    _dt = "strftime(o_orderdate, '%Y%m')" if _kind == "num_yyyymm" else "strftime(o_orderdate, '%Y-%m-%d')"
    _in = "strftime(o_orderdate, '%Y%m') BETWEEN '199502' AND '199811'" if _kind == "num_yyyymm" else "CAST(o_orderdate AS DATE) BETWEEN DATE '1995-02-10' AND DATE '1998-11-20' AND (day(o_orderdate) % 2 = 1 OR month(o_orderdate) IN (4, 9))"
    query(f"f_gaps_{_kind}", f"SELECT {_dt} AS dt, count(*) AS row_count FROM orders WHERE {_in} GROUP BY 1")(_gaps_stored(_kind))

# --- whole projects: both comparisons of pairs, from their configuration ---


def outcome_rows(out: Outcome) -> DataFrame:
    """(part, dt, what, left_n, right_n): the days with their counts, and the distinct values of each column and bucket."""
    rows = out.rows.select(F.lit("rows").alias("part"), "dt", F.col("status").alias("what"), F.col("left_count").alias("left_n"), F.col("right_count").alias("right_n"))
    return rows.unionByName(out.columns.select(F.lit("columns").alias("part"), "dt", F.col("left_col").alias("what"), F.col("n_unique_left").alias("left_n"), F.col("n_unique_right").alias("right_n")))


def outcome_sql(left: str, right: str, bucket: str) -> str:
    """left and right: selects of dt, o_custkey and o_orderpriority."""
    distinct = " UNION ALL ".join(f"SELECT '{s}' AS side, {bucket} AS dt, count(DISTINCT o_custkey) AS u, count(DISTINCT o_orderpriority) AS v FROM {s} WHERE dt IN (SELECT dt FROM c WHERE what = 'match') GROUP BY 2" for s in "lr")
    return f"""
WITH l AS ({left}), r AS ({right}), lc AS (SELECT dt, count(*) AS n FROM l GROUP BY 1), rc AS (SELECT dt, count(*) AS n FROM r GROUP BY 1),
c AS (SELECT coalesce(lc.dt, rc.dt) AS dt, CASE WHEN lc.n IS NULL THEN 'right_only' WHEN rc.n IS NULL THEN 'left_only' WHEN lc.n = rc.n THEN 'match' ELSE 'mismatch' END AS what, lc.n AS left_n, rc.n AS right_n FROM lc FULL JOIN rc ON lc.dt = rc.dt),
p AS ({distinct})
SELECT 'rows' AS part, dt, what, left_n, right_n FROM c
UNION ALL SELECT 'columns', a.dt, 'o_custkey', a.u, b.u FROM p a JOIN p b ON a.dt = b.dt AND a.side = 'l' AND b.side = 'r'
UNION ALL SELECT 'columns', a.dt, 'o_orderpriority', a.v, b.v FROM p a JOIN p b ON a.dt = b.dt AND a.side = 'l' AND b.side = 'r'"""


def project_of(d: str, pairs: dict[str, tuple[dict, dict, dict]], **more) -> Project:
    """name -> (left, right, options); a side's `day` is the expression of its date over orders, `rows` what its rows are."""

    def side(name: str, x: dict) -> dict:
        columns = f"o_orderkey, o_custkey, o_orderpriority, {x['day']} AS d"
        return {"name": name, "source": "parquet", "table": f"{d}/orders.parquet", "date_col": "d", "processed": f"SELECT {columns} FROM {x.get('rows', '{source}')}"} | {k: v for k, v in x.items() if k not in ("day", "rows")}

    config = {"pairs": {n: {"left": side("orders", a), "right": side("replica", b), "col_filter": {"include": ["o_custkey", "o_orderpriority"]}} | options for n, (a, b, options) in pairs.items()}} | more
    return Project.from_json(json.dumps(config))


_DAY = "CAST(o_orderdate AS DATE)"
_SIDE = "SELECT {dt} AS dt, o_custkey, o_orderpriority FROM {source}"
#: name -> (left, right, options, SQL of the left rows, of the right rows, of the bucket of a day dt).
_PROJECTS = {
    # a timestamp against text YYYY-MM-DD, within bounds
    "text": (
        {"day": "o_orderdate", "date_type": "timestamp"}, {"day": "date_format(o_orderdate, 'yyyy-MM-dd')", "date_type": "string_dash", "where": "o_orderkey % 400 <> 0"}, {"vintage": "month", "fromDate": "1995-06-10", "toDate": "1996-12-24"},
        _SIDE.format(dt="strftime(o_orderdate, '%Y-%m-%d')", source="orders WHERE o_orderdate >= TIMESTAMP '1995-06-10' AND o_orderdate < TIMESTAMP '1996-12-25'"),
        _SIDE.format(dt="strftime(o_orderdate, '%Y-%m-%d')", source="orders WHERE o_orderdate >= TIMESTAMP '1995-06-10' AND o_orderdate < TIMESTAMP '1996-12-25' AND o_orderkey % 400 <> 0"), _trunc("CAST(dt AS DATE)", "month"),
    ),
    # a date against a timestamp of which the last row of each customer is taken
    "latest": (
        {"day": _DAY, "date_type": "date", "where": "o_orderkey % 3 <> 1"}, {"day": "o_orderdate", "date_type": "timestamp", "rows": "(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM {source}) WHERE n <= 6"}, {"vintage": "quarter"},
        _SIDE.format(dt="strftime(o_orderdate, '%Y-%m-%d')", source="orders WHERE o_orderkey % 3 <> 1"),
        _SIDE.format(dt="strftime(o_orderdate, '%Y-%m-%d')", source="(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n <= 6"), _trunc("CAST(dt AS DATE)", "quarter"),
    ),
    # a timestamp without the first days against text YYYYMMDD
    "compact": (
        {"day": "o_orderdate", "date_type": "datetime", "where": "d >= TIMESTAMP_NTZ'1995-01-15 00:00:00'"}, {"day": "date_format(o_orderdate, 'yyyyMMdd')", "date_type": "string_compact"}, {"vintage": "week"},
        _SIDE.format(dt="strftime(o_orderdate, '%Y-%m-%d')", source="orders WHERE o_orderdate >= TIMESTAMP '1995-01-15'"), _SIDE.format(dt="strftime(o_orderdate, '%Y-%m-%d')", source="orders"), _trunc("CAST(dt AS DATE)", "week"),
    ),
    # a date against a number YYYYMMDD, up to a day
    "number": (
        {"day": _DAY, "date_type": "date"}, {"day": "CAST(date_format(o_orderdate, 'yyyyMMdd') AS INT)", "date_type": "num", "where": "o_orderkey % 97 <> 0"}, {"vintage": "year", "toDate": "1997-03-31"},
        _SIDE.format(dt="strftime(o_orderdate, '%Y-%m-%d')", source="orders WHERE o_orderdate < TIMESTAMP '1997-04-01'"), _SIDE.format(dt="strftime(o_orderdate, '%Y-%m-%d')", source="orders WHERE o_orderdate < TIMESTAMP '1997-04-01' AND o_orderkey % 97 <> 0"), _trunc("CAST(dt AS DATE)", "year"),
    ),
    # months as numbers on both sides, one month missing and one with other counts on the right
    "months": (
        {"day": "CAST(date_format(o_orderdate, 'yyyyMM') AS INT)", "date_type": "num"}, {"day": "CAST(date_format(o_orderdate, 'yyyyMM') AS INT)", "date_type": "num_yyyymm", "where": "d <> 199603 AND NOT (d = 199604 AND o_orderkey % 9 = 0)"}, {"vintage": "day", "toDate": "1998-02-10"},
        _SIDE.format(dt="strftime(o_orderdate, '%Y%m')", source="orders WHERE strftime(o_orderdate, '%Y%m') <= '199802'"),
        _SIDE.format(dt="strftime(o_orderdate, '%Y%m')", source="orders WHERE strftime(o_orderdate, '%Y%m') <= '199802' AND strftime(o_orderdate, '%Y%m') <> '199603' AND NOT (strftime(o_orderdate, '%Y%m') = '199604' AND o_orderkey % 9 = 0)"), "dt",
    ),
    # a date transform: what is text on one side counts a day later on both
    "transform": (
        {"day": "o_orderdate", "date_type": "timestamp", "date_transform": "date_add({col}, 1)"}, {"day": "upper(date_format(date_add(o_orderdate, 1), 'ddMMMyyyy'))", "date_type": "string_mon", "where": "o_orderkey % 211 <> 0"}, {"vintage": "month", "fromDate": "1996-01-01", "toDate": "1996-06-30"},
        _SIDE.format(dt="strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d')", source="orders WHERE CAST(o_orderdate AS DATE) + 1 BETWEEN DATE '1996-01-01' AND DATE '1996-06-30'"),
        _SIDE.format(dt="strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d')", source="orders WHERE CAST(o_orderdate AS DATE) + 1 BETWEEN DATE '1996-01-01' AND DATE '1996-06-30' AND o_orderkey % 211 <> 0"), _trunc("CAST(dt AS DATE)", "month"),
    ),
}


def _run_stored(name: str, stored: bool) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark, d):
        left, right, options, *_ = _PROJECTS[name]
        project = project_of(d, {name: (left, right, options)})
        if not stored:
            return outcome_rows(run_project(spark, project)[name])
        store = Store(spark, new_folder(spark, "store"))
        run_project(spark, project, store)[name].release()
        return outcome_rows(run_project(spark, project, store)[name])

    return run


for _name, (_, _, _, _l, _r, _b) in _PROJECTS.items():
    for _with in (False, True) if _name in ("text", "months") else (False,):
        query(f"g_project_{_name}{'_stored' if _with else ''}", outcome_sql(_l, _r, _b))(_run_stored(_name, _with))


@query("g_project_shared", " UNION ALL ".join(f"SELECT '{n}' AS pair, * FROM ({outcome_sql(_SIDE.format(dt=_b, source='orders WHERE ' + w), _SIDE.format(dt=_b, source='orders WHERE ' + w + ' AND o_orderkey % 53 <> 0'), _trunc('CAST(dt AS DATE)', 'quarter'))})" for n, w, _b in (("low", "o_orderkey % 2 = 0", "strftime(o_orderdate, '%Y-%m-%d')"), ("high", "o_orderkey % 5 = 0", "strftime(o_orderdate, '%Y-%m-%d')"), ("later", "o_orderkey % 5 = 0", "strftime(o_orderdate + INTERVAL 40 DAY, '%Y-%m-%d')"))))
def g_project_shared(spark, d):
    """Three pairs over one table, with different filters and dates."""
    pairs = {}
    for name, where, day in (("low", "o_orderkey % 2 = 0", _DAY), ("high", "o_orderkey % 5 = 0", _DAY), ("later", "o_orderkey % 5 = 0", f"date_add({_DAY}, 40)")):
        pairs[name] = ({"day": day, "where": where}, {"day": day, "where": f"{where} AND o_orderkey % 53 <> 0"}, {"vintage": "quarter"})
    found = run_project(spark, project_of(d, pairs))
    return reduce(DataFrame.unionByName, [outcome_rows(out).select(F.lit(n).alias("pair"), "*") for n, out in found.items()])


# --- sources ---

query("s_processed_dedup", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")(lambda spark, d: rowcount.latest_per_key(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id"))
query("s_processed_maxdate", "SELECT o_orderkey FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)")(lambda spark, d: rowcount.latest_snapshot(table(spark, d, "orders"), "o_orderdate").select("o_orderkey"))
query("s_partitions", 'SELECT event_type AS "partition", count(*) AS n_rows FROM events GROUP BY 1')(lambda spark, d: readers.partitions(table(spark, d, "events"), "event_type"))
query("s_processed_sql", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY 1")(lambda spark, d: readers.read_side(spark, readers.Side("orders", "parquet", f"{d}/orders.parquet", processed="SELECT o_custkey, count(*) AS n FROM {source} WHERE o_totalprice > 1000 GROUP BY 1")))
query("s_rowcount_csv_shape", "SELECT strftime(o_orderdate, '%Y%m%d') AS dt, count(*) AS row_count FROM orders GROUP BY 1")(
    lambda spark, d: rowcount.summed(table(spark, d, "orders").select(F.concat(F.lit(" "), F.date_format("o_orderdate", "yyyyMMdd")).alias("run_date"), F.when(F.col("o_orderkey") < 0, "n/a").otherwise("1").alias("cnt")), "run_date", "cnt")
)

# --- scalars, on spellings of the days of orders ---

_DAYS = "(SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)"


def days(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()


# How DuckDB writes each spelling.
_WRITTEN = {"YYYY-MM-DD": "%Y-%m-%d", "YYYYMMDD": "%Y%m%d", "DDMONYYYY": "%d%b%Y", "DDMONYY": "%d%b%y", "DD-MON-YYYY": "%d-%b-%Y", "DD-MON-YY": "%d-%b-%y", "YYYY/MM/DD": "%Y/%m/%d", "MM/DD/YYYY": "%m/%d/%Y", "YYYY-MM-DD HH:MM:SS": "%Y-%m-%d %H:%M:%S", "DDMONYYYY:HH:MM:SS": "%d%b%Y:%H:%M:%S"}


def spelled(spark, d) -> DataFrame:
    labels = [*_WRITTEN, "SAS_DATE", "SAS_DATETIME"]
    return days(spark, d).select("day", F.explode(F.array(*[F.struct(F.lit(k).alias("label"), D.write_date(F.col("day"), k).alias("v")) for k in labels])).alias("s")).select("day", "s.label", "s.v")


_SPELLINGS = " UNION ALL ".join(f"SELECT day, '{k}' AS label, upper(strftime(CAST(day AS TIMESTAMP), '{f}')) AS v FROM {_DAYS}" for k, f in _WRITTEN.items()) + f" UNION ALL SELECT day, 'SAS_DATE', CAST(day - DATE '1960-01-01' AS VARCHAR) FROM {_DAYS} UNION ALL SELECT day, 'SAS_DATETIME', CAST((day - DATE '1960-01-01') * 86400 AS VARCHAR) FROM {_DAYS}"
query("x_parse_date", f"SELECT label, v, strftime(day, '%Y-%m-%d') AS dt FROM ({_SPELLINGS})")(lambda spark, d: spelled(spark, d).select("label", "v", D.parse_date(F.col("v")).alias("dt")))
query("x_detect_format", f"SELECT v, label FROM ({_SPELLINGS})")(lambda spark, d: spelled(spark, d).select("v", D.detect_format(F.col("v")).alias("label")))
query("x_roundtrip", f"SELECT label, count(*) AS n, count(*) AS same FROM ({_SPELLINGS}) GROUP BY 1")(lambda spark, d: spelled(spark, d).groupBy("label").agg(F.count("*").alias("n"), F.count(F.when(D.parse_date(F.col("v")) == F.date_format("day", "yyyy-MM-dd"), 1)).alias("same")))
query("x_reformat", f"SELECT strftime(day, '%Y-%m-%d') AS dt, upper(strftime(day, '%d%b%Y')) AS v FROM {_DAYS}")(lambda spark, d: days(spark, d).select(F.date_format("day", "yyyy-MM-dd").alias("dt"), D.write_date(F.col("day"), "DDMONYYYY").alias("v")))
query("x_bucket", "SELECT strftime(day, '%Y-%m-%d') AS dt, " + ", ".join(f"{_trunc('day', v)} AS b_{v}" for v in D.VINTAGES) + f" FROM {_DAYS}")(lambda spark, d: days(spark, d).select(F.date_format("day", "yyyy-MM-dd").alias("dt"), *[D.bucket(F.col("day"), v).alias(f"b_{v}") for v in D.VINTAGES]))
query("x_vintage_label", f"SELECT strftime(day, '%Y-%m-%d') AS dt, strftime(day, '%b ') || day(day) || ', ' || year(day) AS l_day, isoyear(day) || '-W' || lpad(CAST(week(day) AS VARCHAR), 2, '0') AS l_week, strftime(day, '%b %Y') AS l_month, 'Q' || quarter(day) || ' ' || year(day) AS l_quarter, CAST(year(day) AS VARCHAR) AS l_year FROM {_DAYS}")(
    lambda spark, d: days(spark, d).withColumn("dt", F.date_format("day", "yyyy-MM-dd")).select("dt", *[D.vintage_label(F.col("dt"), v).alias(f"l_{v}") for v in D.VINTAGES])
)
query("x_bucket_spans", f"SELECT o_orderstatus, {_trunc('day', 'month')} AS key, strftime(min(day), '%Y-%m-%d') AS first, strftime(max(day), '%Y-%m-%d') AS last FROM (SELECT o_orderstatus, CAST(unnest(generate_series(min(o_orderdate) + INTERVAL 3 DAY, max(o_orderdate) - INTERVAL 4 DAY, INTERVAL 1 DAY)) AS DATE) AS day FROM orders GROUP BY 1) GROUP BY 1, 2")(
    lambda spark, d: table(spark, d, "orders").groupBy("o_orderstatus").agg(F.date_add(F.min(F.to_date("o_orderdate")), 3).alias("a"), F.date_sub(F.max(F.to_date("o_orderdate")), 4).alias("z")).select("o_orderstatus", F.explode(D.bucket_spans(F.col("a"), F.col("z"), "month")).alias("s")).select("o_orderstatus", "s.key", F.date_format("s.start", "yyyy-MM-dd").alias("first"), F.date_format("s.end", "yyyy-MM-dd").alias("last"))
)
query("x_transform", "SELECT o_orderkey, strftime(o_orderdate, '%Y%m') AS v FROM orders")(lambda spark, d: table(spark, d, "orders").select("o_orderkey", S.apply_transform("date_format({col}, 'yyyyMM')", "o_orderdate").alias("v")))
query("x_normalize_numbers", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority WHEN o_orderkey % 3 = 1 THEN o_orderkey || '.5' ELSE CAST(o_orderkey AS VARCHAR) END AS v FROM orders")(
    lambda spark, d: table(spark, d, "orders").select("o_orderkey", S.normalize(F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(" "), "o_orderpriority")).when(F.col("o_orderkey") % 3 == 1, F.concat(F.col("o_orderkey").cast("string"), F.lit(".5000"))).otherwise(F.concat(F.col("o_orderkey").cast("string"), F.lit(".0")))).alias("v"))
)
query("x_normalize", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 3 = 1 THEN o_orderpriority ELSE CAST(o_orderkey % 1000 AS VARCHAR) END AS v FROM orders")(
    lambda spark, d: table(spark, d, "orders").select("o_orderkey", S.normalize(F.when(F.col("o_orderkey") % 3 == 0, F.upper(F.date_format("o_orderdate", "ddMMMyyyy:HH:mm:ss"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("  "), "o_orderpriority", F.lit(" "))).otherwise(F.concat((F.col("o_orderkey") % 1000).cast("string"), F.lit(".500").substr(1, 1), F.lit("000"))), dates=True).alias("v"))
)
query("x_match_key", "SELECT c_custkey, 'm_' || printf('%.4f', round(c_acctbal, 4)) AS number_key, 'mn_' || c_mktsegment || '=1' AS text_key FROM customer")(lambda spark, d: table(spark, d, "customer").select("c_custkey", S.match_key(F.col("c_acctbal").cast("string"), "m", printed=True).alias("number_key"), S.match_key(F.concat("c_mktsegment", F.lit("=1")), "mn").alias("text_key")))
_TOP = categorical_sql("orders", ["o_orderpriority"], _MONTH)
query("x_top10_parse", f"WITH p AS ({_TOP}) SELECT dt, unnest(string_split(top_10, '; ')) AS entry FROM p")(lambda spark, d: profile.categorical_profile(table(spark, d, "orders"), ["o_orderpriority"], "o_orderdate", "month").select("dt", F.explode(S.parse_top(F.col("top_10")))).select("dt", F.concat("key", F.lit("("), F.col("value").cast("string"), F.lit(")")).alias("entry")))
query("x_top10_json", "SELECT o_orderpriority AS key, count(*) AS value FROM orders GROUP BY 1")(
    lambda spark, d: table(spark, d, "orders").groupBy("o_orderpriority").count().agg(F.to_json(F.collect_list(F.array("o_orderpriority", F.col("count").cast("string")))).alias("j")).select(F.explode(S.parse_top(F.col("j")))).select("key", "value")
)

query("x_top10_compare", f"WITH a AS ({categorical_sql('orders', ['o_orderpriority'], _MONTH)}), b AS ({categorical_sql(RIGHT, ['o_orderpriority'], _MONTH)}) SELECT a.dt, a.top_10 = b.top_10 AS same FROM a JOIN b USING (dt)")(
    lambda spark, d: reconcile.compare_profiles(*[profile.categorical_profile(s, ["o_orderpriority"], "o_orderdate", "month") for s in sides(spark, d)], vintage="month").select("dt", F.col("top_10_match").alias("same"))
)



def written_columns(spark, d) -> DataFrame:
    """The days of orders in columns whose spelling only the whole column tells; in one of them every tenth value is no date."""
    day = F.to_date("o_orderdate")
    us, eu = F.date_format(day, "MM/dd/yyyy"), F.date_format(day, "dd/MM/yyyy")
    return table(spark, d, "orders").select(us.alias("us"), eu.alias("eu"), F.when(F.col("o_orderkey") % 10 == 0, "n/a").otherwise(D.write_date(day, "DDMONYYYY")).alias("mon"), F.when(F.col("o_orderkey") % 2 == 0, us).otherwise(eu).alias("both"))


@query("x_learn_formats", "SELECT 'us' AS column_name, 'MM/DD/YYYY' AS label, count(*) AS n, CAST(0 AS BIGINT) AS unread FROM orders UNION ALL SELECT 'eu', 'DD/MM/YYYY', count(*), 0 FROM orders UNION ALL SELECT 'mon', 'DDMONYYYY', count(*) FILTER (WHERE o_orderkey % 10 <> 0), count(*) FILTER (WHERE o_orderkey % 10 = 0) FROM orders UNION ALL SELECT 'both', 'mixed order', count(*), 0 FROM orders")
def x_learn_formats(spark, d):
    rows = written_columns(spark, d)
    found = learning.learn_formats(learning.format_counts(rows, rows.columns))
    return spark.createDataFrame([(c, label, n, x.unread) for c, x in found.items() for label, n in x.shares.items()], "column_name string, label string, n bigint, unread bigint")


@query("x_learned_dates", "SELECT strftime(o_orderdate, '%Y-%m-%d') AS dt, count(*) AS n, count(*) AS eu, count(*) FILTER (WHERE o_orderkey % 10 <> 0) AS mon, count(*) AS back FROM orders GROUP BY 1")
def x_learned_dates(spark, d):
    """Dates read as their column is spelled, and written back: of each day how many rows agree."""
    rows = written_columns(spark, d)
    found = learning.learn_formats(learning.format_counts(rows, rows.columns))
    us = found["us"].day(F.col("us"))
    same = lambda c: F.count(F.when(found[c].day(F.col(c)) == us, 1)).alias(c)
    return rows.groupBy(us.cast("string").alias("dt")).agg(F.count("*").alias("n"), same("eu"), same("mon"), F.count(F.when(found["eu"].written(us) == F.col("eu"), 1)).alias("back"))


# --- mapping and metadata ---




@query("m_match_columns", "WITH l AS (SELECT upper(column_name) AS c FROM (DESCRIBE orders) UNION ALL SELECT column_name FROM (DESCRIBE nation)), r AS (SELECT column_name AS c FROM (DESCRIBE orders) UNION ALL SELECT column_name FROM (DESCRIBE region)) SELECT l.c AS left_col, r.c AS right_col, CASE WHEN r.c IS NULL THEN 'left_only' WHEN l.c IS NULL THEN 'right_only' ELSE 'matched' END AS status FROM l FULL JOIN r ON lower(l.c) = lower(r.c)")
def m_match_columns(spark, d):
    names = lambda xs: spark.createDataFrame([(x,) for x in xs], "column_name string")
    of = lambda t: table(spark, d, t).columns
    return mapping.match_frames(names([*map(str.upper, of("orders")), *of("nation")]), names([*of("orders"), *of("region")]))


query("m_col_filter", "SELECT column_name FROM (DESCRIBE orders) WHERE starts_with(column_name, 'o_order') AND NOT ends_with(column_name, 'status')")(lambda spark, d: spark.createDataFrame([(c,) for c in mapping.filter_columns(table(spark, d, "orders").columns, ["O_ORDER*"], ["*status"])], "column_name string"))


@query("m_mapping_export", "SELECT column_name AS left_col, CASE WHEN starts_with(column_name, 'l_ship') THEN 'sent_' || substr(column_name, 7) WHEN regexp_full_match(column_name, 'l_[a-z]*key') THEN regexp_extract(column_name, 'l_([a-z]*)key', 1) || '_id' END AS right_col, CASE WHEN starts_with(column_name, 'l_ship') THEN 'rule 0' WHEN regexp_full_match(column_name, 'l_[a-z]*key') THEN 'rule 1' ELSE 'left only' END AS status FROM (DESCRIBE lineitem)")
def m_mapping_export(spark, d):
    """Columns of lineitem by rules to the names of a copy, of which those that no rule leads to are left alone."""
    left = table(spark, d, "lineitem").columns
    right = ["sent_date", "order_id", "part_id", "supp_id", "other"]
    found = mapping.apply_rules([mapping.Rule("L_SHIP*", "sent_*"), mapping.Rule(r"l_([a-z]*)key", r"\1_id", "regex")], left, right)
    return spark.createDataFrame([(c, *((found[c][0], f"rule {found[c][1]}") if c in found else (None, "left only"))) for c in left], "left_col string, right_col string, status string")


query("m_column_meta", "SELECT 'parquet_nation' AS source_table, column_name, CASE column_type WHEN 'INTEGER' THEN 'int' WHEN 'BIGINT' THEN 'bigint' ELSE 'string' END AS data_type, 'parquet' AS source FROM (DESCRIBE nation)")(lambda spark, d: readers.column_meta(table(spark, d, "nation"), readers.Side("nation", "parquet", "nation")))
query("m_status", f"WITH {_COMPARED} SELECT 'left' AS source_table, count(*) AS n_dates, min(dt) AS first, max(dt) AS last, CAST(sum(row_count) AS BIGINT) AS total FROM l UNION ALL SELECT 'right', count(*), min(dt), max(dt), CAST(sum(row_count) AS BIGINT) FROM r")(
    lambda spark, d: reconcile.pair_status(rowcount.row_counts(sides(spark, d)[0], "o_orderdate").withColumn("source_table", F.lit("left")).unionByName(rowcount.row_counts(sides(spark, d)[1], "o_orderdate").withColumn("source_table", F.lit("right"))))
)

# --- the reference's own benchmark shapes ---

query("b_cte_join", "WITH t AS (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) SELECT c_custkey, c_mktsegment, n, total FROM customer JOIN t ON c_custkey = o_custkey")(
    lambda spark, d: table(spark, d, "customer").join(table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")), F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_mktsegment", "n", "total")
)
query("b_date_range", "SELECT count(*) AS n, round(avg(l_extendedprice), 2) AS mean FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-07-01'")(lambda spark, d: table(spark, d, "lineitem").where(P.between_dates(F.col("l_shipdate"), "1996-01-01", "1996-06-30")).agg(F.count("*").alias("n"), F.round(F.avg("l_extendedprice"), 2).alias("mean")))
query("b_serial_stats", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 4) AS mean, round(stddev_samp(l_quantity), 4) AS std FROM lineitem GROUP BY 1, 2")(lambda spark, d: table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 4).alias("mean"), F.round(F.stddev_samp("l_quantity"), 4).alias("std")))
