import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import predicates as P
from ledgerline.functions import scalars as S
from ledgerline.operators import mapping, reconcile
from ledgerline.operators.diff import keyed_diff
from ledgerline.operators.profile import categorical_profile, missing_buckets, numeric_profile, profile
from ledgerline.operators.rowcount import canonical, sample_dates, summed
from ledgerline.plans import report
from ledgerline.plans.runner import run_pair, timed_sql
from ledgerline.plans.spec import Project
from ledgerline.sources import readers
from ledgerline.sources.store import Store, write_csv
from ledgerline.streaming.increments import load_increments


def frame(spark, columns, rows):
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))


# --- keyed differences ---


def test_diff_one_sided_and_text_exact(spark):
    d = keyed_diff(frame(spark, ["id", "n"], [("1", "10"), ("2", ""), ("3", "a")]), frame(spark, ["id", "n"], [("1", "10.0"), ("2", "0"), ("4", "a")]), ["id"], ["n"])
    assert tuple(d.summary().first()) == (2, 1, 1, 2, 1)
    assert [tuple(r) for r in d.examples().orderBy("place").collect()] == [("n", "1", "10", "10.0", 1), ("n", "2", "", "0", 2)]


def test_diff_caps_examples_and_composite_key(spark):
    left, right = frame(spark, ["id", "v"], [(str(i), "a") for i in range(5)]), frame(spark, ["id", "v"], [(str(i), "A") for i in range(5)])
    d = keyed_diff(left, right, ["id"], ["v"])
    assert tuple(d.by_column().first()) == ("v", 5) and d.examples(3).count() == 3
    two = keyed_diff(frame(spark, ["id", "d", "a"], [("1", "x", "5"), ("1", "y", "6"), (None, "z", None)]), frame(spark, ["id", "d", "a"], [("1", "x", "5"), ("1", "y", "99"), ("", "z", "")]), ["id", "d"], ["a"])
    assert tuple(two.summary().first()) == (3, 0, 0, 1, 1)


def test_diff_skips_and_errors(spark):
    left, right = frame(spark, ["id", "a", "b"], [("1", "x", "y")]), frame(spark, ["id", "a"], [("1", "x")])
    d = keyed_diff(left, right, ["id"], ["a", "b", "id"])
    assert d.skipped == {"b": "missing on right side", "id": "is a primary key"} and d.columns == ["a"]
    with pytest.raises(ValueError, match="missing on right"):
        keyed_diff(left, right, ["b"], ["a"])


# --- series ---


def series(spark, rows):
    return spark.createDataFrame(rows, "dt string, row_count bigint")


def test_series_from_text(spark):
    raw = frame(spark, ["d", "n"], [("2024-10-01", "3"), (" 2024-10-01", "4"), ("20241001", "5"), ("2024-10-02", "x"), ("", "1"), ("202410", "9")])
    sums = summed(raw, "d", "n")
    assert sorted(tuple(r) for r in sums.collect()) == [("2024-10-01", 7), ("202410", 9), ("20241001", 5)]
    assert sorted(tuple(r) for r in canonical(sums).collect()) == [("2024-10-01", 7), ("202410", 9)]
    assert [tuple(r) for r in canonical(sums, "2024-10-02", "2024-10-31").collect()] == [("202410", 9)]


def test_row_comparison_and_mirror(spark):
    left = series(spark, [("2024-10-01", 1), ("2024-10-02", 2), ("2024-10-03", 3), (None, 9)])
    right = series(spark, [("2024-10-02", 2), ("2024-10-03", 4), ("2024-10-04", 1)])
    status = lambda a, b: {r.dt: (r.status, r.in_overlap) for r in reconcile.compare_rows(a, b).collect()}
    assert status(left, right) == {"2024-10-01": ("left_only", False), "2024-10-02": ("match", True), "2024-10-03": ("mismatch", True), "2024-10-04": ("right_only", False)}
    turned = {"left_only": "right_only", "right_only": "left_only"}
    assert status(right, left) == {k: (turned.get(s, s), o) for k, (s, o) in status(left, right).items()}
    none = reconcile.compare_rows(left.limit(0), right)
    assert {(r.status, r.in_overlap) for r in none.collect()} == {("right_only", False)}
    assert reconcile.row_summary(none).first().left_total == 0
    s = reconcile.row_summary(reconcile.compare_rows(left, right)).first()
    assert (s.left_total, s.right_total, s.n_match, s.n_misload) == (6, 7, 1, 0)


def test_samples_repeat(spark):
    days = series(spark, [(f"2024-10-{i:02d}", i) for i in range(1, 31)])
    assert sample_dates(days, 5) == sample_dates(days.repartition(3), 5) and len(sample_dates(days, 99)) == 30


# --- profiles ---


def test_profiles(spark):
    df = spark.createDataFrame([("b", 1.0), ("B", 3.0), ("a", None), (" ", float("nan")), (None, 3.0), ("b", 2.0)], "c string, x double")
    r = categorical_profile(df, ["c"]).first()
    assert (r.n_total, r.n_missing, r.n_unique, r.min_val, r.max_val, r.top_10) == (6, 2, 3, "a=1", "b=2", "b(2); B(1); a(1)")
    assert r.mean == pytest.approx((1 + 2 + 3 * 2) / 4) and r.std == pytest.approx(((1 + 4 + 18) / 4 - 2.25**2) ** 0.5)
    n = numeric_profile(df, ["x"]).first()
    assert (n.n_total, n.n_missing, n.n_unique, n.mean, n.min_val, n.max_val) == (6, 2, 3, 2.25, "1.0", "3.0")
    assert numeric_profile(df.limit(1), ["x"]).first().std is None


def test_ranks_over_many_ranges(spark):
    """Ranks, extremes and top values of columns whose values lie in several tasks equal a plain count; null dates and blanks included."""
    rows = [(None if i % 50 == 0 else f"1995-0{i % 3 + 1}-01", None if i % 17 == 0 else " " if i % 19 == 0 else f"{'vV'[i % 2]}{i * 7919 % 997}", f"c{i % 3}") for i in range(6000)]
    df = spark.createDataFrame(rows, "day string, v string, w string").withColumn("day", F.to_date("day"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        got = {(r.column_name, r.dt): r for r in categorical_profile(df, ["v", "w"], "day", "month").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want: dict = {}
    for day, *values in rows:
        for name, x in zip(["v", "w"], values, strict=True):
            want.setdefault((name, day), []).append(x)
    assert got.keys() == want.keys()
    for key, values in want.items():
        there = [x for x in values if x is not None and x.strip()]
        counts = {x: there.count(x) for x in set(there)}
        rank = {x: i + 1 for i, x in enumerate(sorted(counts, key=lambda x: (x.upper(), x)))}
        mean = sum(rank[x] for x in there) / len(there)
        r = got[key]
        assert (r.n_total, r.n_missing, r.n_unique) == (len(values), len(values) - len(there), len(counts))
        assert abs(r.mean - mean) < 1e-9 and abs(r.std - (sum((rank[x] - mean) ** 2 for x in there) / len(there)) ** 0.5) < 1e-6
        first, last = min(rank, key=rank.get), max(rank, key=rank.get)
        assert (r.min_val, r.max_val) == (f"{first}={counts[first]}", f"{last}={counts[last]}")
        assert r.top_10 == "; ".join(f"{x}({counts[x]})" for x in sorted(counts, key=lambda x: (-counts[x], x))[:10])


def test_no_window_holds_all_values(spark):
    """The frequencies are shuffled once for both uses; the only window over values is cut down to the top before its shuffle."""
    df = spark.createDataFrame([("a",)], "v string")
    plan = categorical_profile(df, ["v"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and plan.count("rangepartitioning") == 1 and "Join" not in plan


def test_distinct_counts_can_be_estimated(spark):
    df = spark.range(20_000).select((F.col("id") % 5000).alias("v"))
    exact, near = (numeric_profile(df, ["v"], exact=e).first().n_unique for e in (True, False))
    assert exact == 5000 and abs(near - exact) < 500


def test_profiles_depend_on_frequencies_only(spark):
    rows = [(random.Random(i).choice("abc"), float(i % 7)) for i in range(50)]
    of = lambda r: sorted(map(tuple, profile(spark.createDataFrame(r, "c string, x double")).select("column_name", "n_unique", F.round("mean", 9), F.round("std", 9), "min_val", "top_10").collect()))
    assert of(rows) == of(rows[::-1])
    assert of(rows) != of([({"a": "b", "b": "a"}.get(c, c), x) for c, x in rows])


def test_compare_profiles(spark):
    df = spark.createDataFrame([(f"2024-10-{i % 28 + 1:02d}", "x" if i % 3 else "y", float(i)) for i in range(200)], "d string, c string, v double").withColumn("d", F.to_date("d"))
    same = profile(df, "d", "month")
    assert not any(r.has_diff for r in reconcile.compare_profiles(same, same, vintage="month").collect())
    other = profile(df.withColumn("v", F.when(F.col("v") == 5, 6.0).otherwise(F.col("v"))).withColumnRenamed("c", "cc"), "d", "month")
    out = reconcile.compare_profiles(same, other, {"v": "v", "c": "cc"}, "month")
    assert {r.left_col: (r.has_diff, r.worst) for r in out.collect()} == {"v": (True, "mean"), "c": (False, "other")}
    days = series(spark, [("2024-11-03", 1)])
    assert reconcile.compare_profiles(same, other, {"v": "v"}, "month", days).collect() == []
    assert missing_buckets(df, same.where("column_name = 'v'"), "d", "month").count() == 0
    assert "v" in report.column_html(out, "t<") and "t&lt;" in report.column_html(out, "t<") and any(x.startswith("DIFF  v") for x in report.log_lines(out))


# --- functions ---


def test_scalars(spark):
    rows = frame(spark, ["v"], [("0.4400",), ("0.44",), (" x ",), ("",), (None,), ("1d",), ("-0",), ("1e3",), ("a=5",)])
    got = [tuple(r) for r in rows.select(S.match_key(F.col("v"), "m"), S.normalize(F.col("v"), False), S.to_count(F.col("v"))).collect()]
    assert got == [("m_0.4400", "0.44", 0), ("m_0.4400", "0.44", 0), ("m_x", "x", 0), (None, "", 0), (None, "", 0), ("m_1d", "1d", 0), ("m_0.0000", "-0", 0), ("m_1000.0000", "1000", 1000), ("m_a=5", "a=5", 0)]
    top = frame(spark, ["v"], [("a(3); b; c(1)(2)",), ('[["a","3"],["b","1"]]',)]).select(S.parse_top(F.col("v")).alias("m")).collect()
    assert [r.m for r in top] == [{"a": 3, "c(1)": 2}, {"a": 3, "b": 1}]


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).select(F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(cast(id as int), 23, 59, 59.5)").alias("ts"), "id").write.parquet(path)
    rows = spark.read.parquet(path)
    kept = rows.where(P.between_dates(F.col("ts"), "2024-01-02", "2024-01-03"))
    assert [r.id for r in kept.orderBy("id").collect()] == [1, 2]
    assert "GreaterThanOrEqual(ts" in kept._jdf.queryExecution().toString()
    assert P.in_dates(rows, "ts", []).count() == 0 and P.in_dates(rows, "ts", ["2024-01-05"]).count() == 1
    many = [f"2024-01-{i % 28 + 1:02d}" for i in range(1500)]
    assert P.in_dates(rows, "ts", many).count() == 28 and P.except_dates(rows, "ts", ["2024-01-01"]).count() == 99


def test_mapping():
    m = mapping.match_columns(["A", "b", "c"], ["a", "B", "d"], {"c": "d"})
    assert m.mapping == {"A": "a", "b": "B", "c": "d"} and not m.left_only and not m.right_only
    assert mapping.match_columns(["c"], ["d"], {"c": "d"}, replace=True).mapping == {}
    rules = [mapping.Rule("AMT_*", "amount_*"), mapping.Rule("(", "x", "regex"), mapping.Rule(r"amt_(.*)", r"amount_\1", "regex"), mapping.Rule("k", "key")]
    assert mapping.apply_rules(rules, ["AMT_TOTAL", "amt_total", "k"], ["amount_TOTAL", "amount_total", "key"]) == {"AMT_TOTAL": ("amount_TOTAL", 0), "amt_total": ("amount_total", 0), "k": ("key", 3)}
    assert mapping.filter_columns(["Ab", "ac", "b"], ["a*"], ["*C"]) == ["Ab"] and mapping.filter_columns(["b", "a"]) == ["a", "b"]
    assert mapping.unmapped_matches(["a", "b"], {"a": "x"}) == ["b"] and mapping.parse_mapping("A=b, C=d,x") == {"A": "b", "C": "d"}
    assert mapping.pick_mapping(("l", "r"), {("r", "l"): {"x": "y"}}) == {"y": "x"}


# --- sources, store, project ---


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Run_Date,CNT\n2024-10-01,3\n2024-10-01,4\n")
    (tmp_path / "b.csv").write_text("Run_Date,CNT\n2024-10-02,5\n")
    assert sorted(tuple(r) for r in readers.read_row_counts(spark, str(tmp_path)).collect()) == [("2024-10-01", 7), ("2024-10-02", 5)]
    (tmp_path / "p").mkdir()
    (tmp_path / "p/x.csv").write_text("column_name,dt,col_count,col_avg,freq\nc,2024-10-01,5,1.5,a(1)\n")
    r = readers.read_profile(spark, str(tmp_path / "p")).first()
    assert (r.n_total, r.mean, r.top_10, r.std) == (5, 1.5, "a(1)", None)
    (tmp_path / "q").mkdir()
    (tmp_path / "q/x.csv").write_text("id,v\n1,\n2,NULL\n")
    assert [tuple(x) for x in readers.read_text_csv(spark, str(tmp_path / "q")).orderBy("id").collect()] == [("1", ""), ("2", "NULL")]
    assert readers.parse_sql_file("-- Generated by x\n-- one\nSELECT 1;\n-- a comment here\n-- two\nSELECT\n2\n") == {"one": "SELECT 1;\n-- a comment here", "two": "SELECT\n2"}
    with pytest.raises(ValueError, match="unknown source"):
        readers.read_side(spark, readers.Side("x", "nowhere"))
    df = spark.createDataFrame([("a", 1)], "p string, v int")
    assert readers.unreadable_partitions(df, "p") == []
    bad = df.withColumn("v", F.expr("cast(concat('x', p) as int)"))
    assert [p for p, _ in readers.unreadable_partitions(bad, "p")] == ["a"]


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    rows = lambda *r: spark.createDataFrame([(t, d, n) for t, d, n in r], "source_table string, dt string, row_count bigint")
    got = lambda: sorted(tuple(r) for r in store.read("row_counts").collect())
    assert got() == []
    store.append("row_counts", rows(("a", "1", 1), ("b", "1", 2)))
    with pytest.raises(ValueError):
        store.append("row_counts", rows(("a", "1", 5)))
    store.upsert("row_counts", rows(("a", "1", 5), ("a", "2", 6)))
    assert got() == [("a", "1", 5), ("a", "2", 6), ("b", "1", 2)]
    store.replace("row_counts", "a", rows(("a", "3", 7)))
    assert got() == [("a", "3", 7), ("b", "1", 2)]
    store.patch("a", source="x", date_var="d")
    store.patch("a", source="y")
    store.backfill()
    meta = {r.source_table: r for r in store.read("metadata").collect()}
    assert (meta["a"].source, meta["a"].date_var, meta["a"].row_count_total, meta["b"].max_date_loaded) == ("y", "d", 7, "1")
    store.delete("row_counts", F.col("source_table") == "b")
    assert got() == [("a", "3", 7)]
    store.note("select 1", 0.5, 1, "ok")
    store.note("select 2", 0.5, 1, "ok")
    assert [r.sql for r in store.history(1).collect()] == ["select 2"]
    write_csv(store.read("row_counts"), str(tmp_path / "out"), ["dt"])
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 1


def test_increments_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.csv").write_text("dt,row_count\n2025-01-01,3\n")
    store = Store(spark, f"file://{tmp_path}/store")
    for more in ("", "dt,row_count\n2025-01-01,4\n2025-01-02,5\n"):
        if more:
            (tmp_path / "in/2.csv").write_text(more)
        load_increments(spark, str(tmp_path / "in"), "t", store, str(tmp_path / "cp")).awaitTermination(60)
    assert sorted((r.dt, r.row_count) for r in store.read("row_counts").collect()) == [("2025-01-01", 4), ("2025-01-02", 5)]


def test_project_end_to_end(spark, tmp_path):
    df = spark.range(300).select("id", F.date_add(F.lit("2024-10-01").cast("date"), (F.col("id") % 30).cast("int")).alias("d"), (F.col("id") % 5).alias("v"), F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("Flag"))
    df.write.parquet(str(tmp_path / "l"))
    df.where("id <> 3").withColumn("v", F.when(F.col("id") == 40, 9).otherwise(F.col("v"))).withColumnRenamed("Flag", "flag").write.parquet(str(tmp_path / "r"))
    side = lambda x: {"source": "parquet", "table": str(tmp_path / x), "name": x, "date_col": "d"}
    config = {"pairs": {"p": {"left": side("l"), "right": side("r"), "vintage": "month", "ignore_columns": ["id"]}, "s": {"left": side("l"), "right": side("r"), "vintage": "sample@4"}}}
    project = Project.from_json(json.dumps(config))
    assert len(project.sides()) == 2
    out = run_pair(spark, project.pairs[0])
    assert {r.dt for r in out.rows.where("status = 'mismatch'").collect()} == {"2024-10-04"}
    assert {r.left_col: (r.right_col, r.has_diff) for r in out.columns.collect()} == {"v": ("v", True), "Flag": ("flag", False)}
    assert "2024-10-04" in report.row_html(out.rows, "pair")
    assert run_pair(spark, project.pairs[1]).left_profile.first().n_total == 40
    for bad in ({"pairs": {}}, {"pairs": {"p": {"left": {}, "right": side("r")}}}, {"pairs": {"p": {"left": side("l"), "right": side("r"), "vintage": "decade"}}}):
        with pytest.raises(ValueError):
            Project.from_json(json.dumps(bad))
    assert timed_sql(spark, "SELECT 1")[0][0][0] == 1
    with pytest.raises(ValueError):
        timed_sql(spark, "DROP TABLE x")


def test_texts():
    assert [report.count_text(n) for n in (None, 999, 12_345, 3_400_000, 1_200_000_000)] == ["-", "999", "12,345", "3.4M", "1.2B"]
    assert [report.duration_text(s) for s in (1.23, 65, 3700)] == ["1.2s", "1m 5s", "1h 1m"]
