"""Reconciliation of two tables: row counts per date, column profiles per date, and what follows from both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.dates import bucket_text, vintage_label
from ledgerline.functions.scalars import match_key, parse_top

COUNTS = ["n_total", "n_missing", "n_unique"]
MATCHED = {"mean": "m", "std": "s", "min_val": "mn", "max_val": "mx"}


def compare_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """(dt, left_count, right_count, diff, status, in_overlap) of two series (dt, row_count): match, mismatch, left_only or right_only.
    The overlap runs from the later first to the earlier last date; null dates are left out."""
    both = left.where("dt is not null").select("dt", F.col("row_count").alias("left_count")).join(right.where("dt is not null").select("dt", F.col("row_count").alias("right_count")), "dt", "full_outer")
    a, b = F.col("left_count"), F.col("right_count")
    status = F.when(a.isNull(), "right_only").when(b.isNull(), "left_only").when(a == b, "match").otherwise("mismatch")
    window = overlap(both)
    return both.withColumns({"diff": b - a, "status": status}).join(F.broadcast(window), F.lit(True), "left").withColumn("in_overlap", F.coalesce(F.col("dt").between(F.col("overlap_start"), F.col("overlap_end")), F.lit(False))).drop("overlap_start", "overlap_end")


def overlap(both: DataFrame) -> DataFrame:
    """One row (overlap_start, overlap_end) of (dt, left_count, right_count); nulls if the ranges don't meet."""
    of = lambda c: F.when(F.col(c).isNotNull(), F.col("dt"))
    ranges = both.agg(F.min(of("left_count")).alias("l0"), F.max(of("left_count")).alias("l1"), F.min(of("right_count")).alias("r0"), F.max(of("right_count")).alias("r1"))
    known = F.col("l0").isNotNull() & F.col("r0").isNotNull()
    start, end = F.when(known, F.greatest("l0", "r0")), F.when(known, F.least("l1", "r1"))
    return ranges.select(F.when(start <= end, start).alias("overlap_start"), F.when(start <= end, end).alias("overlap_end"))


def row_summary(compared: DataFrame) -> DataFrame:
    """One row: ranges, totals and numbers of dates of either side, dates by status, misloads."""
    of = lambda c: F.when(F.col(c).isNotNull(), F.col("dt"))
    status = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(f"n_{s}")
    return compared.agg(
        F.min(of("left_count")).alias("left_first"), F.max(of("left_count")).alias("left_last"), F.min(of("right_count")).alias("right_first"), F.max(of("right_count")).alias("right_last"),
        F.coalesce(F.sum("left_count"), F.lit(0)).alias("left_total"), F.coalesce(F.sum("right_count"), F.lit(0)).alias("right_total"), F.count("left_count").alias("left_dates"), F.count("right_count").alias("right_dates"),
        *map(status, ("match", "mismatch", "left_only", "right_only")), F.count(F.when(_misload(), 1)).alias("n_misload"),
    )


def _misload() -> Column:
    return F.col("status").isin("left_only", "right_only") & F.col("in_overlap")


def misloads(compared: DataFrame) -> DataFrame:
    """One-sided dates within the overlap."""
    return compared.where(_misload())


def excluded_dates(compared: DataFrame) -> DataFrame:
    """(dt, reason): mismatched dates and misloads."""
    return compared.where((F.col("status") == "mismatch") | _misload()).select("dt", F.when(F.col("status") == "mismatch", "mismatch").otherwise("misload").alias("reason"))


def matching_dates(compared: DataFrame, manual: list[str] | None = None) -> DataFrame:
    """One row of sorted lists: matching (without dates excluded by hand), excluded, and non-matching dates of the overlap."""
    by_hand = F.col("dt").isin(manual) if manual else F.lit(False)
    out = (F.col("status") == "mismatch") | _misload()
    lists = {"matching": (F.col("status") == "match") & ~by_hand, "excluded": out | ((F.col("status") == "match") & by_hand), "non_matching": out}
    return compared.agg(*[F.array_sort(F.collect_list(F.when(c, F.col("dt")))).alias(n) for n, c in lists.items()])


def row_export(compared: DataFrame) -> DataFrame:
    """(category, in_overlap, excluded, date, left_count, right_count, diff) with zero for a missing side."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return compared.select(F.col("status").alias("category"), "in_overlap", ((F.col("status") == "mismatch") | _misload()).alias("excluded"), F.col("dt").alias("date"), zero("left_count").alias("left_count"), zero("right_count").alias("right_count"), (zero("right_count") - zero("left_count")).alias("diff"))


def bucket_check(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row (result, first_divergence, n_left_only, n_right_only) on two sets of bucket keys (dt)."""
    both = left.select("dt").distinct().withColumn("l", F.lit(1)).join(right.select("dt").distinct().withColumn("r", F.lit(1)), "dt", "full_outer")
    apart = F.col("l").isNull() | F.col("r").isNull()
    sums = both.agg(F.min(F.when(apart, F.col("dt"))).alias("first_divergence"), F.count(F.when(F.col("r").isNull(), 1)).alias("n_left_only"), F.count(F.when(F.col("l").isNull(), 1)).alias("n_right_only"))
    return sums.select(F.when(F.col("first_divergence").isNull(), "PASS").otherwise("WARNING").alias("result"), "first_divergence", "n_left_only", "n_right_only")


def new_and_updated(before: DataFrame, after: DataFrame) -> DataFrame:
    """(dt, state): dates of an upload that were not there, or were."""
    known = before.select("dt").distinct().withColumn("known", F.lit(True))
    return after.select("dt").distinct().join(known, "dt", "left").select("dt", F.when(F.col("known"), "updated").otherwise("new").alias("state"))


def resolved_type(left: Column, right: Column, override: Column) -> Column:
    """An override, else the type both sides have, else categorical."""
    return F.coalesce(override, F.when(left == right, left), F.lit("categorical"))


def compare_profiles(left: DataFrame, right: DataFrame, mapping: dict[str, str] | None = None, vintage: str = "day", matched: DataFrame | None = None, overrides: dict[str, str] | None = None) -> DataFrame:
    """Two profiles side by side, by (mapped) column and bucket: counts with differences, the other statistics with whether they match.

    mapping: left column -> right column (default: same name). matched: days (dt) to which the comparison is kept, by their buckets.
    A statistic that one side lacks matches neither way (null). top_10_match: whether the most frequent values agree, with their counts, in whatever order and spelling of the list; it is shown, and has no part in has_diff.
    """
    spark = left.sparkSession
    stats = [*COUNTS, *MATCHED, "top_10", "col_type"]
    side = lambda df, s, name: df.select(F.col("column_name").alias(name), "dt", *[F.col(c).alias(f"{c}_{s}") for c in stats])
    lhs, rhs = side(left, "left", "left_col"), side(right, "right", "right_col")
    if mapping is None:
        lhs = lhs.withColumn("right_col", F.col("left_col"))
    else:
        pairs = spark.createDataFrame(list(mapping.items()), "left_col string, right_col string")
        lhs = lhs.join(F.broadcast(pairs), "left_col")
    both = lhs.join(rhs, ["right_col", "dt"])
    if matched is not None:
        both = both.join(matched.select(bucket_text(F.col("dt"), vintage).alias("dt")).distinct(), "dt", "left_semi")
    override = F.get(F.transform(F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in (overrides or {"": ""}).items()]), lambda o: o["k"] == F.col("left_col")), lambda o: o["v"]), 0)
    keys = {c: (match_key(F.col(f"{c}_left").cast("string"), p), match_key(F.col(f"{c}_right").cast("string"), p)) for c, p in MATCHED.items()}
    both = both.withColumns({"vintage_label": vintage_label(F.col("dt"), vintage), "col_type": resolved_type(F.col("col_type_left"), F.col("col_type_right"), override)} | {f"{c}_diff": F.col(f"{c}_right") - F.col(f"{c}_left") for c in COUNTS} | {f"{c.removesuffix('_val')}_match": a == b for c, (a, b) in keys.items()})
    tops = [F.array_sort(F.map_entries(parse_top(F.col(f"top_10_{x}")))) for x in ("left", "right")]
    return both.withColumns({"has_diff": has_diff(), "worst": worst_stat(), "top_10_match": tops[0] == tops[1]})


def has_diff() -> Column:
    """Any count differs, or any other statistic is there on both sides and doesn't match."""
    out = F.lit(False)
    for c in COUNTS:
        out = out | (F.col(f"{c}_diff") != 0)
    for c in ("mean", "std", "min", "max"):
        out = out | ~F.coalesce(f"{c}_match", F.lit(True))
    return out


def worst_stat() -> Column:
    """What to show first of a difference: n_total with its share, n_missing, mean (numeric), n_unique, other."""
    share = F.when(F.col("n_total_left") > 0, F.abs(F.col("n_total_diff") / F.col("n_total_left")) * 100).otherwise(0.0)
    return (
        F.when(F.col("n_total_diff") != 0, F.format_string("n_total %.1f%%", share))
        .when(F.col("n_missing_diff") != 0, "n_missing")
        .when((F.col("col_type") == "numeric") & ~F.coalesce("mean_match", F.lit(True)), "mean")
        .when(F.col("n_unique_diff") != 0, "n_unique")
        .otherwise("other")
    )


def diff_map(compared: DataFrame) -> DataFrame:
    """(vintage_label, left_col, worst) of all differences."""
    return compared.where("has_diff").select("vintage_label", "left_col", "worst")


def column_summary(compared: DataFrame) -> DataFrame:
    """(left_col, right_col, n_vintages, n_diff, has_diff, type_mismatch), differing columns first: a column differs if any bucket does."""
    out = compared.groupBy("left_col", "right_col").agg(F.count("*").alias("n_vintages"), F.count(F.when(F.col("has_diff"), 1)).alias("n_diff"), F.max("has_diff").alias("has_diff"), F.max(F.col("col_type_left") != F.col("col_type_right")).alias("type_mismatch"))
    return out.orderBy(F.desc("has_diff"), "left_col")


def pair_summary(compared: DataFrame, left_columns: list[str], right_columns: list[str]) -> DataFrame:
    """One row on a pair: n_matched and n_diff columns, left_only and right_only (names that no comparison has), type_mismatches, n_vintages."""
    columns = column_summary(compared)
    sums = columns.agg(F.count("*").alias("n_matched"), F.count(F.when(F.col("has_diff"), 1)).alias("n_diff"), F.count(F.when(F.col("type_mismatch"), 1)).alias("type_mismatches"), F.collect_set("left_col").alias("__l"), F.collect_set("right_col").alias("__r"))
    only = lambda names, used: F.array_sort(F.array_except(F.array(*map(F.lit, names)) if names else F.array().cast("array<string>"), used))
    out = sums.select("n_matched", "n_diff", only(left_columns, "__l").alias("left_only"), only(right_columns, "__r").alias("right_only"), "type_mismatches")
    return out.crossJoin(compared.agg(F.count_distinct("dt").alias("n_vintages")))  # one row each


def pass_fail_rows(compared: DataFrame) -> DataFrame:
    """(left_col, vintage_label, result): PASS, or FAIL and the worst statistic of what differs, however many buckets there are."""
    return compared.select("left_col", "vintage_label", F.when(F.col("has_diff"), F.concat(F.lit("FAIL "), "worst")).otherwise("PASS").alias("result"))


def pass_fail(compared: DataFrame, most: int = 500) -> DataFrame:
    """One row per column, one field per vintage: PASS, or the worst statistic of what differs; buckets in order of time. More than `most` buckets are an error: pass_fail_rows() has them as rows."""
    labels = [r.vintage_label for r in compared.groupBy("vintage_label").agg(F.min("dt").alias("dt")).orderBy("dt").limit(most + 1).collect()]
    if len(labels) > most:
        raise ValueError(f"more than {most} buckets make too wide a table; take a coarser vintage or pass_fail_rows()")
    cell = F.first(F.when(F.col("has_diff"), F.concat(F.lit("FAIL "), "worst")).otherwise("PASS"))
    return compared.groupBy("left_col").pivot("vintage_label", labels).agg(cell)


def latest_stats(profile: DataFrame) -> DataFrame:
    """Each column's profile of its last bucket."""
    return profile.groupBy("column_name").agg(F.max_by(F.struct(*[c for c in profile.columns if c != "column_name"]), "dt").alias("s")).select("column_name", "s.*")


def pair_status(counts: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """(source_table, n_dates, first, last, total) of stored series, beside metadata (source_table, ...) if given."""
    sums = counts.groupBy("source_table").agg(F.count_distinct("dt").alias("n_dates"), F.min("dt").alias("first"), F.max("dt").alias("last"), F.sum("row_count").alias("total"))
    return sums if metadata is None else metadata.join(sums, "source_table", "left")
