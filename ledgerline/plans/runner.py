"""A pair from its two tables to its comparisons: count rows, compare, take the matching days, profile, compare."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.dates import vintage_label
from ledgerline.functions.intervals import DaySet, bucket_label
from ledgerline.functions.predicates import plan_filter
from ledgerline.operators.mapping import apply_rules, filter_columns, match_columns, pick_mapping
from ledgerline.operators.profile import profile
from ledgerline.operators.reconcile import compare_profiles, compare_rows
from ledgerline.operators.rowcount import daily_series, sample_dates
from ledgerline.plans.spec import Pair, Project
from ledgerline.sources.readers import Side, read_side, shaped
from ledgerline.sources.shares import read_shares
from ledgerline.sources.store import Store


@dataclass(frozen=True)
class Outcome:
    """rows and columns: the comparisons; matching: days (or months) on which both sides agree; undated: of each side the rows without a date and those whose date can't be read; mapping: left column -> right column.
    release() frees what the comparisons hold in memory."""

    pair: Pair
    rows: DataFrame
    columns: DataFrame | None
    left_profile: DataFrame | None
    right_profile: DataFrame | None
    seconds: dict[str, float]
    matching: list[str] = field(default_factory=list)
    undated: dict[str, tuple[int, int]] = field(default_factory=dict)
    mapping: dict[str, str] = field(default_factory=dict)

    def release(self) -> None:
        self.rows.unpersist()

    def warnings(self) -> list[str]:
        """What a reader of the comparisons should know."""
        out = [f"{self.pair.name}: {n} rows on the {side} have a date that can't be read as {s.date_type}" for side, s in (("left", self.pair.left), ("right", self.pair.right)) if (n := self.undated[side][1])]
        return out + ([] if self.matching else [f"{self.pair.name}: no day matches"])


def bounded(rows: DataFrame, side: Side, pair: Pair) -> DataFrame:
    """A side's rows within the pair's days, filtered in the spelling that its dates are stored in."""
    return rows.where(side.dated.between(pair.first, pair.last)) if side.dated and (pair.first or pair.last) else rows


class Shared:
    """What the pairs of a project have in common: tables by Side.rows_key, daily counts by side and bounds, and profiles by side, days and vintage with the columns of all pairs, each made once."""

    def __init__(self, tables: dict[str, DataFrame]):
        self.tables = tables
        self.columns: dict[str, dict[str, str | None]] = {}
        self._kept: dict[tuple, DataFrame] = {}

    def ask(self, side: Side, columns: list[str], overrides: dict[str, str]) -> None:
        """Note that a pair profiles columns of a side. Where pairs give one column different types, each keeps to its own columns."""
        own = self.columns.setdefault(side.rows_key, {})
        for c in columns:
            own[c] = overrides.get(c) if own.get(c, overrides.get(c)) == overrides.get(c) else "both"

    def columns_of(self, side: Side, columns: list[str], overrides: dict[str, str]) -> tuple[list[str], dict[str, str]]:
        """The columns to profile, and their types, for a pair that needs the given ones."""
        asked = self.columns.get(side.rows_key, {})
        if "both" in asked.values():
            return columns, overrides
        every = sorted({*columns, *asked})
        return every, {c: k for c, k in asked.items() if k} | {c: overrides[c] for c in columns if c in overrides}

    def once(self, key: tuple, make: Callable[[], DataFrame]) -> DataFrame:
        if key not in self._kept:
            self._kept[key] = make().persist()
        return self._kept[key]

    def release(self) -> None:
        for df in self._kept.values():
            df.unpersist()


def run_pair(spark: SparkSession, pair: Pair, seed: int = 2025, store: Store | None = None, shared: Shared | None = None, exact: bool = True) -> Outcome:
    """Both comparisons of a pair. Days that don't match, or are in exclude_dates or ignore_rows, are left out of the profiles; sample@N profiles N matching days together.

    A date that can't be read counts for no day: such rows are counted (Outcome.undated). Months (YYYYMM) are compared as they are, and profiled in buckets of their days.
    Columns are mapped by the pair's own mapping, else by the stored one of the two tables (either way round) and by name, and what is left by the pair's rules.
    store: where series, profiles, matching days, mappings and samples go; a sample that is there already is used again, and only buckets are profiled whose stored profile is of other filters, days or counts
    (all, with the mode `full`). shared: what the pairs of a project have in common. exact: whether distinct counts of numbers are exact.
    """
    took, began = {}, time.monotonic()
    alone = shared is None
    shared = shared or Shared({s.rows_key: read_side(spark, s) for s in (pair.left, pair.right)})
    left, right = (bounded(shared.tables[s.rows_key], s, pair) for s in (pair.left, pair.right))
    daily = [shared.once((s.rows_key, pair.first, pair.last), lambda rows=rows, s=s: daily_series(rows, s.dated)) for rows, s in ((left, pair.left), (right, pair.right))]
    compared = compare_rows(*daily).persist()
    try:
        undated = {n: tuple(d.where("dt is null").agg(F.coalesce(F.sum(F.col("row_count") - F.col("with_date")), F.lit(0)), F.coalesce(F.sum("with_date"), F.lit(0))).first()) for n, d in zip(("left", "right"), daily, strict=True)}
        ignored = {*pair.exclude_dates, *pair.ignore_rows}
        agreed = {r.dt: r.left_count for r in compared.where("status = 'match'").select("dt", "left_count").collect() if r.dt not in ignored}
        matching = sorted(agreed)
        took["rows"] = time.monotonic() - began
        if store:
            _keep_rows(store, pair, compared, ignored)
        out = Outcome(pair, compared, None, None, None, took, matching, undated, _picked(pair, left.columns, right.columns, store))
        if not out.mapping:
            return out
        profiles = _profiles(pair, (left, right), out.mapping, agreed, compared, seed, store, shared, exact)
        took["columns"] = time.monotonic() - began - took["rows"]
        vintage = "all" if pair.vintage.startswith("sample@") else pair.vintage
        return replace(out, columns=compare_profiles(*profiles, out.mapping, vintage, None, pair.overrides), left_profile=profiles[0], right_profile=profiles[1])
    except BaseException:
        compared.unpersist()
        raise
    finally:
        if alone:
            shared.release()


def _keep_rows(store: Store, pair: Pair, compared: DataFrame, ignored: set[str]) -> None:
    for s, n in ((pair.left, "left"), (pair.right, "right")):
        own = compared.where(F.col(f"{n}_count").isNotNull()).select(F.lit(s.qualified).alias("source_table"), "dt", F.col(f"{n}_count").alias("row_count"))
        store.replace("row_counts", s.qualified, own)
    state = F.when(F.col("dt").isin(sorted(ignored)), "excluded").otherwise(F.col("status"))
    store.replace("matching", pair.name, compared.where(F.col("dt").isNotNull()).select(F.lit(pair.name).alias("source_table"), "dt", state.alias("state")))


def _mapping(pair: Pair, left: list[str], right: list[str], store: Store | None) -> dict[str, str]:
    """The pair's mapping as it is, or what is stored for the two tables, what names and rules add to it, which is stored in turn."""
    if pair.col_map:
        return pair.col_map
    here = (pair.left.qualified, pair.right.qualified)
    stored: dict[tuple[str, str], dict[str, str]] = {}
    if store:
        for r in store.read("mappings").where(F.col("source_table").isin(*here) & F.col("right_table").isin(*here)).collect():
            stored.setdefault((r.source_table, r.right_table), {})[r.left_col] = r.right_col
    own = pick_mapping(here, stored)
    found = match_columns(left, right, own)
    by_rule = apply_rules(list(pair.rules), found.left_only, found.right_only)
    mapping = found.mapping | {c: to for c, (to, _) in by_rule.items()}
    if store and mapping != stored.get(here):
        rows = [(*here, c, to, "stored" if own.get(c) == to else f"rule {by_rule[c][1]}" if c in by_rule else "name") for c, to in sorted(mapping.items())]
        store.upsert("mappings", store.spark.createDataFrame(rows, "source_table string, right_table string, left_col string, right_col string, state string"))
    return mapping


def _picked(pair: Pair, left: list[str], right: list[str], store: Store | None) -> dict[str, str]:
    """The columns that are profiled, left -> right."""
    mapping = _mapping(pair, left, right, store)
    return {c: mapping[c] for c in filter_columns(list(mapping), pair.include, pair.exclude) if c not in pair.ignore_columns and c != pair.left.date_col}


def _types(pair: Pair, mapping: dict[str, str]) -> tuple[dict[str, str], dict[str, str]]:
    """The types that a pair gives columns, by their names on either side."""
    return {c: k for c, k in pair.overrides.items() if c in mapping}, {to: pair.overrides[c] for c, to in mapping.items() if c in pair.overrides}


def _profiles(pair: Pair, sides: tuple[DataFrame, DataFrame], mapping: dict[str, str], agreed: dict[str, int], compared: DataFrame, seed: int, store: Store | None, shared: Shared, exact: bool) -> list[DataFrame]:
    sampled, n = pair.vintage.startswith("sample@"), int(pair.vintage.partition("@")[2] or 0)
    vintage = "all" if sampled else pair.vintage
    sample = _sample(compared.where(F.col("dt").isin(sorted(agreed))), n, seed, pair, store) if sampled else None
    chosen = plan_filter(sorted(agreed), vintage, sample)
    out = []
    for rows, side, own, types in zip(sides, (pair.left, pair.right), (list(mapping), list(mapping.values())), _types(pair, mapping), strict=True):
        by = side.dated if side.dated and vintage != "all" else None
        columns, overrides = shared.columns_of(side, own, types)
        if store and by and not side.bucketed:
            found = _resumed(store, rows, side, columns, vintage, pair, overrides, agreed, exact)
        else:
            key = (side.rows_key, pair.first, pair.last, chosen, vintage, exact, tuple(columns), tuple(sorted(overrides.items())))
            found = shared.once(key, lambda rows=rows, side=side, by=by, columns=columns, overrides=overrides: profile(chosen.apply(rows, side.dated) if side.dated else rows, by, vintage, columns, overrides, exact))
        out.append(found.where(F.col("column_name").isin(own)) if columns != own else found)
    return out


def _sample(days: DataFrame, n: int, seed: int, pair: Pair, store: Store | None) -> list[str]:
    """The pair's stored sample of that size, or a new one, which is stored."""
    if store:
        stored = [r.dt for r in store.read("samples").where((F.col("source_table") == pair.name) & (F.col("vintage") == pair.vintage)).collect()]
        if stored:
            return sorted(stored)
    sample = sample_dates(days, n, seed)
    if store and sample:
        store.upsert("samples", days.sparkSession.createDataFrame([(pair.name, pair.vintage, d) for d in sample], "source_table string, vintage string, dt string"))
    return sample


def _digest(*parts: object) -> str:
    return hashlib.md5(json.dumps(parts, sort_keys=True).encode()).hexdigest()


def profile_key(side: Side, vintage: str) -> str:
    """Under which name a side's profile is stored: pairs that filter or date the same table otherwise have profiles of their own."""
    return f"{side.qualified}/{vintage}/{_digest(side.rows_key)[:12]}"


def bucket_fingerprints(agreed: dict[str, int], vintage: str, *more: object) -> dict[str, str]:
    """bucket -> a digest of the days that are in it with their counts, and of what else decides its profile."""
    days: dict[str, list[tuple[str, int]]] = {}
    for day, count in sorted(agreed.items()):
        days.setdefault(bucket_label(day, vintage), []).append((day, count))
    return {b: _digest(own, *more) for b, own in days.items()}


def _resumed(store: Store, rows: DataFrame, side: Side, columns: list[str], vintage: str, pair: Pair, overrides: dict[str, str], agreed: dict[str, int], exact: bool) -> DataFrame:
    """The side's profile by buckets of the days in `agreed`. Computed, and read from the source, are only the buckets that the store lacks for some column, or has for other days, counts, types or bounds."""
    spark = rows.sparkSession
    wanted = bucket_fingerprints(agreed, vintage, exact, sorted((c, k) for c, k in overrides.items() if c in columns))
    key = profile_key(side, vintage)
    prints = spark.createDataFrame(list(wanted.items()), "dt string, fingerprint string")
    stored = lambda: store.read("col_stats").where((F.col("source_table") == key) & F.col("column_name").isin(columns)).join(F.broadcast(prints), ["dt", "fingerprint"], "left_semi")  # noqa: E731  a row for each bucket of the calendar
    whole = set() if pair.mode == "full" else {r.dt for r in stored().groupBy("dt").agg(F.count_distinct("column_name").alias("n")).where(F.col("n") == len(columns)).select("dt").collect()}
    missing = DaySet.of(d for d in agreed if bucket_label(d, vintage) not in whole)
    new = profile(side.dated.within(rows, missing), side.dated, vintage, columns, overrides, exact)
    if missing:
        store.upsert("col_stats", new.join(F.broadcast(prints), "dt", "left").withColumn("source_table", F.lit(key)).withColumn("vintage_label", vintage_label(F.col("dt"), vintage)))
    return stored().select(*new.columns)


def run_project(spark: SparkSession, project: Project, store: Store | None = None, seed: int | None = None) -> dict[str, Outcome]:
    """All pairs but those to be skipped, by name. Sides that pairs share, filters and dates included, are counted once and, for the same days, profiled once with the columns of all; these small results stay in memory while the outcomes are
    used, and release() of any outcome's frames leaves them to Spark. Steps and their seconds go to the store's timing, those of a pair that fails too."""
    shared = Shared({s.rows_key: _read(spark, s, store) for s in project.sides()})
    for pair in project.pairs:
        if not pair.skip:
            mapping = _picked(pair, *(shared.tables[s.rows_key].columns for s in (pair.left, pair.right)), store)
            for side, columns, types in zip((pair.left, pair.right), (list(mapping), list(mapping.values())), _types(pair, mapping), strict=True):
                shared.ask(side, columns, types)
    seed = project.settings.get("seed", 2025) if seed is None else seed
    out: dict[str, Outcome] = {}
    for pair in project.pairs:
        if pair.skip:
            continue
        began, steps, status = datetime.now(UTC), {}, "ok"
        try:
            out[pair.name] = run_pair(spark, pair, seed, store, shared, project.settings.get("exact", True))
            steps = out[pair.name].seconds
        except Exception as e:
            steps, status = {"failed": (datetime.now(UTC) - began).total_seconds()}, f"error: {str(e).splitlines()[0]}"
            for done in out.values():
                done.release()
            raise
        finally:
            if store and steps:
                rows = [(pair.name, step, began.replace(tzinfo=None), seconds, status) for step, seconds in steps.items()]
                store.append("timing", spark.createDataFrame(rows, "source_table string, step string, start timestamp, elapsed_sec double, status string"))
    return out


def _read(spark: SparkSession, side: Side, store: Store | None) -> DataFrame:
    """A side's rows. A database's table with the option `shares` is read in so many partitions of equal rows, once the store has its daily counts."""
    if side.source == "jdbc" and side.options.get("shares") and store and side.date_col:
        series = store.read("row_counts").where(F.col("source_table") == side.qualified)
        if not series.isEmpty():
            return shaped(spark, side, read_shares(spark, side, series, int(side.options["shares"])))
    return read_side(spark, side)


def only_reads(spark: SparkSession, sql: str) -> bool:
    """Whether a query's parsed plan holds no command and no statement that writes; those that show or describe are allowed."""
    kinds = [spark._jvm.java.lang.Class.forName(f"org.apache.spark.sql.catalyst.plans.logical.{n}") for n in ("Command", "ParsedStatement")]

    def fine(plan) -> bool:
        name = plan.getClass().getSimpleName()
        if any(k.isInstance(plan) for k in kinds) and not name.startswith(("Show", "Describe", "Explain")):
            return False
        children = plan.children()
        return all(fine(children.apply(i)) for i in range(children.size()))

    return fine(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql))


def timed_sql(spark: SparkSession, sql: str, limit: int = 200) -> tuple[list, float]:
    """At most `limit` rows of a query that only reads, and its seconds; anything else, an empty text too, is an error."""
    if not sql.strip() or not only_reads(spark, sql):
        raise ValueError("only queries that read are run")
    began = time.monotonic()
    return spark.sql(sql).limit(limit).collect(), time.monotonic() - began


def store_sql(store: Store, sql: str, limit: int = 200, note: str = "") -> list:
    """Rows of a query over the store's tables, which are views of their names in it; the query, its time and, if it fails, its error are added to the store's history."""
    store.views()
    began = time.monotonic()
    try:
        rows, seconds = timed_sql(store.spark, sql, limit)
    except Exception as e:
        store.note(sql, time.monotonic() - began, None, "error", note, error=str(e).splitlines()[0] if str(e) else type(e).__name__)
        raise
    store.note(sql, seconds, len(rows), "ok", note)
    return rows
