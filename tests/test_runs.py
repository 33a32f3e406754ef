"""Date types, conditions, records without keys, the store's commits, whole projects and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerline.__main__ import main
from ledgerline.functions import predicates as P
from ledgerline.functions.dates import write_date
from ledgerline.functions.datetypes import DATE_TYPES, DateColumn
from ledgerline.operators import diff
from ledgerline.plans.runner import only_reads, run_pair, run_project
from ledgerline.plans.spec import Project
from ledgerline.sources.readers import Side, fill_meta, read_side
from ledgerline.sources.store import Conflict, Store


def days(spark, kind):
    day = F.date_add(F.lit("2024-10-01").cast("date"), F.col("id").cast("int"))
    written = day if kind == "date" else day.cast("timestamp_ntz") if kind in ("timestamp", "datetime") else write_date(day, DATE_TYPES[kind])
    number = kind.startswith("num") or kind.startswith("int")
    return spark.range(92).select("id", (written.cast("int") if number else written).alias("d"), day.alias("day"))


@pytest.mark.parametrize("kind", DATE_TYPES)
def test_every_date_type_filters_at_the_scan(spark, tmp_path, kind):
    days(spark, kind).write.parquet(str(tmp_path / "t"))
    rows, c = spark.read.parquet(str(tmp_path / "t")), DateColumn("d", kind)
    kept = rows.where(c.between("2024-11-01", "2024-11-30"))
    assert kept.count() == 30 and rows.where(c.day() != (F.trunc("day", "month") if c.monthly else F.col("day"))).count() == 0
    plan = kept._jdf.queryExecution().toString()
    pushed = plan[plan.index("PushedFilters") :].split("]")[0]
    assert "In(d" in pushed or "StringEndsWith(d" in pushed or ("GreaterThanOrEqual(d" in pushed and "LessThan" in pushed)
    some = ["202410"] if c.monthly else ["2024-10-03", "2024-12-30"]
    n = 31 if c.monthly else 2
    assert c.within(rows, some).count() == n and c.without(rows, some).count() == 92 - n
    given = spark.createDataFrame([(x,) for x in some], "dt string")
    assert c.within(rows, given).count() == n and c.without(rows, given).count() == 92 - n
    assert c.within(rows, []).count() == 0 and c.without(rows, []).count() == 92
    assert rows.where(c.between("2024-12-01", None)).count() == 31 and rows.where(c.between(None, "2024-10-31")).count() == 31


def test_unknown_date_types_are_errors():
    with pytest.raises(ValueError, match="unknown date type"):
        DateColumn("d", "roman")


def test_conditions(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("a,b",), ("10%",), ("abc",), ("=x",), ("",)], "v string")
    got = lambda text: sorted(r.v for r in rows.where(P.conditions({"v": text})).collect())
    assert got("a") == ["a"] == got("=a") and got("a, b") == ["a", "b"] and got("'a,b'") == ["a,b"] and got("'a,b',abc") == ["a,b", "abc"]
    assert got("'10%'") == ["10%"] and got("a%") == ["a", "a,b", "abc"] == got("~=a%") and got("!~=a%") == ["", "10%", "=x", "b"]
    assert got("!=a") == ["", "10%", "=x", "a,b", "abc", "b"] and got("==x") == ["=x"] and len(rows.where(P.conditions({})).collect()) == 7


def test_long_lists_reach_the_scan(spark, tmp_path):
    days(spark, "date").write.parquet(str(tmp_path / "t"))
    many = [f"{y}-01-{i:02d}" for y in range(1990, 2025) for i in range(1, 29)] + ["2024-10-01"] * 100
    out = P.except_dates(spark.read.parquet(str(tmp_path / "t")), "d", many)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 91 and "Join" not in plan and "LessThan(d" in plan[plan.index("PushedFilters") :]


def test_records_without_key_match_nothing(spark):
    left = spark.createDataFrame([(None, "x")] * 300 + [(1, "a"), (2, "b"), (2, "c")], "k long, v string")
    right = spark.createDataFrame([(None, "x")] * 200 + [(1, "z"), (3, "c")], "k long, v string")
    found = diff.keyed_diff(left, right, ["k"], ["v"])
    assert tuple(found.summary().first()) == (1, 302, 201, 1, 1)
    assert sorted(tuple(r) for r in found.warnings().collect()) == [("left", "no key", 300), ("left", "repeated key", 1), ("right", "no key", 200)]
    parts = diff.keyed_diff(spark.createDataFrame([("a", None, "1")], "k string, j string, v string"), spark.createDataFrame([("a", "", "2")], "k string, j string, v string"), ["k", "j"], ["v"])
    assert tuple(parts.summary().first()) == (1, 0, 0, 1, 1)  # a part of a key may be empty
    mixed = diff.keyed_diff(spark.createDataFrame([(1, "1")], "k long, v string"), spark.createDataFrame([("1", "1")], "k string, v string"), ["k"], ["v"])
    assert mixed.summary().first().matched == 1 and mixed.examples().collect() == []


def test_only_queries_that_read(spark):
    for good in ("SELECT 1", " select * from range(3)", "WITH x AS (SELECT 1) SELECT * FROM x", "VALUES (1)", "SHOW TABLES", "DESCRIBE QUERY SELECT 1", "SELECT 1 UNION ALL SELECT 2"):
        assert only_reads(spark, good)
    for bad in ("DROP TABLE x", "WITH x AS (SELECT 1 AS a) INSERT INTO t SELECT * FROM x", "INSERT INTO t VALUES (1)", "CREATE TABLE t AS SELECT 1", "SET a=b", "TRUNCATE TABLE t", "CACHE TABLE t"):
        assert not only_reads(spark, bad)


def test_history(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    a = store.note("A", 0.1, 1, "ok")
    b = store.note("B", None, None, "error", engine="oracle", conn="x", error="syntax error")
    rows = store.history().collect()
    assert [r.id for r in rows] == [b, a] and rows[0].error == "syntax error" and rows[0].rows is None and rows[0].at is not None
    assert store.set_note(a, "hello") and not store.set_note(99, "nope") and store.history().collect()[1].note == "hello"
    assert store.forget(a) and not store.forget(a) and [r.id for r in store.history().collect()] == [b]


def test_a_write_takes_effect_at_once_or_not_at_all(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    rows = lambda t, n: spark.createDataFrame([(t, str(i), i) for i in range(n)], "source_table string, dt string, row_count bigint")
    store.append("row_counts", rows("a", 3).unionAll(rows("b", 2)))
    number, folders = store._last("row_counts")
    before = store.read("row_counts")
    store.replace("row_counts", "a", rows("a", 1))
    assert before.count() == 5 and store.read("row_counts").count() == 3  # a reader keeps what it has opened
    with pytest.raises(Conflict):
        store._commit("row_counts", number, folders)
    assert len(store._last("row_counts")[1]) == 2  # b was not written anew
    for i in range(25):
        store.upsert("row_counts", rows(f"t{i}", 1))
    assert store.read("row_counts").count() == 28 and len(store._last("row_counts")[1]) <= store.FOLDERS
    store.vacuum("row_counts", keep=1)
    assert store.read("row_counts").count() == 28
    with pytest.raises(ValueError, match="no columns nope"):
        store.upsert("row_counts", rows("a", 1).withColumn("nope", F.lit(1)))


def project(tmp_path, spark):
    for name, kind, rows in (("l", "string_mon", days(spark, "string_mon")), ("r", "int", days(spark, "int").where("id <> 5"))):
        rows.select("id", "d", (F.col("id") % 7).alias("v")).write.parquet(str(tmp_path / name))
    side = lambda x, kind: {"source": "parquet", "table": str(tmp_path / x), "name": x, "date_col": "d", "date_type": kind}
    pair = {"left": side("l", "string_mon"), "right": side("r", "int"), "ignore_columns": ["id"]}
    return {"pairs": {"month": pair | {"vintage": "month", "fromDate": "2024-10-02", "toDate": "2024-12-30", "ignore_rows": ["2024-10-09"]}, "sample": pair | {"vintage": "sample@4"}, "not": pair | {"skip": True}}}


def test_a_whole_project(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    config = Project.from_json(json.dumps(project(tmp_path, spark)))
    out = run_project(spark, config, store)
    assert list(out) == ["month", "sample"] and len(out["month"].matching) == 88  # 90 days, one missing, one ignored
    assert {r.status for r in out["month"].rows.collect()} == {"match", "left_only"}
    assert [r.has_diff for r in out["month"].columns.collect()] == [False] * 3
    assert out["sample"].left_profile.first().n_total == 4
    kept = {r.dt for r in store.read("samples").collect()}
    assert len(kept) == 4 and store.read("timing").count() == 4 and store.read("matching").where("state = 'excluded'").count() == 1
    stored = store.read("col_stats").count()
    again = run_pair(spark, config.pairs[0], store=store)
    assert store.read("col_stats").count() == stored == 6 and again.left_profile.count() == 3  # nothing was left to be profiled
    other = run_pair(spark, config.pairs[1], seed=1, store=store)
    assert {r.dt for r in store.read("samples").collect()} == kept and other.left_profile.first().n_total == 4  # the stored sample is used again
    for o in (*out.values(), again, other):
        o.release()


def test_command_line(spark, tmp_path, capsys):
    config = project(tmp_path, spark)
    (tmp_path / "p.json").write_text(json.dumps(config))
    main(["run", str(tmp_path / "p.json"), "--out", str(tmp_path / "out")])
    assert spark.read.option("header", True).csv(str(tmp_path / "out/month-columns")).columns == ["left_col", "Oct 2024", "Nov 2024", "Dec 2024"]
    left, right = str(tmp_path / "l"), str(tmp_path / "r")
    main(["diff", left, right, "--keys", "id", "--columns", "v"])
    assert "only_left" in capsys.readouterr().out
    main(["profile", left, "--date", "d", "--date-type", "string_mon", "--vintage", "quarter"])
    assert "2024-10-01" in capsys.readouterr().out
    main(["compare-row", left, left, "--date", "d", "--date-type", "string_mon"])
    assert "match" in capsys.readouterr().out
    main(["compare-col", left, left])
    assert "PASS" in capsys.readouterr().out


def test_derived_sides_and_metadata(spark, tmp_path):
    spark.range(5).select("id", F.col("id").alias("source_id")).write.parquet(str(tmp_path / "t"))
    side = lambda sql: Side("t", "parquet", str(tmp_path / "t"), processed=sql)
    assert read_side(spark, side("SELECT source_id FROM {source} WHERE source_id > 2")).count() == 2
    assert read_side(spark, side("SELECT source_id FROM cte_t WHERE source_id > 3")).count() == 1
    meta = spark.createDataFrame([("t", "a", ""), ("t", "b", "int")], "source_table string, column_name string, data_type string")
    more = spark.createDataFrame([("t", "a", "date"), ("t", "b", "long"), ("t", "c", "x")], meta.schema)
    assert sorted(tuple(r) for r in fill_meta(meta, more).collect()) == [("t", "a", "date"), ("t", "b", "int"), ("t", "c", "x")]
