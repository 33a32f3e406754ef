"""Sets of days, and the predicates made of them on columns of every type."""

import random
from datetime import date, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerline.functions.dates import DATE_TYPES, write_date
from ledgerline.functions.datetypes import DateColumn
from ledgerline.functions.intervals import DaySet, bucket_label, runs_of_months

_DAYS = st.sets(st.integers(0, 400), max_size=60)
_START = date(2023, 12, 20)


def of(numbers) -> DaySet:
    return DaySet.of((_START + timedelta(days=n)).isoformat() for n in numbers)


@settings(max_examples=60, deadline=None)
@given(_DAYS, _DAYS)
def test_operations_are_those_of_sets(a, b):
    x, y = of(a), of(b)
    for got, want in ((x | y, a | b), (x & y, a & b), (x - y, a - b)):
        assert got == of(want) and got.days() == sorted(_START + timedelta(days=n) for n in want) and len(got) == len(want)
        assert all(p[1] + timedelta(days=1) < q[0] for p, q in zip(got.runs, got.runs[1:], strict=False))
    assert all((_START + timedelta(days=n) in x) == (n in a) for n in range(401))
    for most in (1, 3, 400):
        rough = x.coarse(most)
        assert len(rough.runs) <= most and not x - rough and (most < len(x.runs) or rough == x)
    firsts, rest = x.whole_months()
    assert DaySet.of(f"{d:%Y%m}" for d in firsts) | rest == x and not rest.whole_months()[0]
    assert {(d.year, d.month) for d in x.months().days()} == {(d.year, d.month) for d in x.days()}


def test_labels():
    assert DaySet.of(["202402"]) == DaySet.between("2024-02-01", "2024-02-29") == DaySet.between("202402", "202402") and not DaySet.between("2024-02-02", "2024-02-01")
    for wrong in ("2024", "202413", "2024-02-30", "soon"):
        with pytest.raises(ValueError, match="no day"):
            DaySet.of([wrong])
    assert [bucket_label("2024-05-15", v) for v in ("day", "week", "month", "quarter", "year", "all")] == ["2024-05-15", "2024-05-13", "2024-05-01", "2024-04-01", "2024-01-01", "all"]
    assert bucket_label("202405", "day") == "202405" and bucket_label("202405", "quarter") == "2024-04-01"
    assert runs_of_months([date(2024, 2, 1), date(2023, 12, 1), date(2024, 1, 1), date(2024, 5, 1)]) == [(date(2023, 12, 1), date(2024, 2, 1)), (date(2024, 5, 1), date(2024, 5, 1))]


def columns(spark, kind, n=3000):
    day = F.date_add(F.lit("2016-01-01").cast("date"), F.col("id").cast("int"))
    written = day if kind == "date" else (day.cast("timestamp_ntz") + F.expr("INTERVAL 23 HOURS")) if kind in ("timestamp", "datetime") else write_date(day, DATE_TYPES[kind])
    return spark.range(n).select("id", (written.cast("int") if kind.startswith(("num", "int")) else written).alias("d"), day.alias("day"))


def pushed(rows) -> str:
    plan = rows._jdf.queryExecution().executedPlan().toString()
    return plan[plan.index("PushedFilters") :].split("\n")[0]


@pytest.mark.parametrize("kind", ["date", "timestamp", "string_compact", "string_dash", "string_mon", "string_mon_dash", "string_us", "num", "num_yyyymm"])
def test_thousands_of_gaps_reach_the_scan(spark, tmp_path, kind):
    columns(spark, kind).write.parquet(str(tmp_path / "t"))
    rows, c = spark.read.parquet(str(tmp_path / "t")), DateColumn("d", kind)
    rng = random.Random(1)
    gaps = {(date(2016, 1, 1) + timedelta(days=i)).isoformat() for i in rng.sample(range(3000), 1300)} | {f"2018-{m:02d}-{d:02d}" for m in (3, 4) for d in range(1, 31)}
    chosen = DaySet.between("2016-01-01", "2024-03-18") - DaySet.of(gaps)
    kept = rows.where(c.inside(chosen))
    months = {(d.year, d.month) for d in chosen.days()}
    want = sum((d.year, d.month) in months if c.monthly else d in chosen for d in (date(2016, 1, 1) + timedelta(days=i) for i in range(3000)))
    assert kept.count() == want and c.without(rows, chosen).count() == 3000 - want
    assert "d" in pushed(kept) and "PushedFilters: []" not in pushed(kept)
    assert "Join" not in kept._jdf.queryExecution().toString()


@pytest.mark.parametrize("kind", ["num", "string_compact"])
def test_days_and_months_in_one_column(spark, kind):
    values = ["20240115", "202401", "202402", "20240301", "202412", "20231231", "oops", None] if kind == "string_compact" else [20240115, 202401, 202402, 20240301, 202412, 20231231, 7, None]
    rows, c = spark.createDataFrame([(v,) for v in values], f"d {'string' if kind == 'string_compact' else 'int'}"), DateColumn("d", kind)
    got = lambda p: [str(r.d) for r in rows.where(p).collect()]
    assert got(c.between("2024-01-10", "2024-02-10")) == ["20240115", "202401", "202402"]
    assert got(c.between("2024-02-10", None)) == ["202402", "20240301", "202412"] + (["oops"] if kind == "string_compact" else [])
    assert [x for x in got(c.between(None, "2024-01-31")) if x != "7"] == ["20240115", "202401", "20231231"]
    assert [r.b for r in rows.select(c.bucket("day").alias("b")).collect()] == ["2024-01-15", "202401", "202402", "2024-03-01", "202412", "2023-12-31", None, None]
    assert [r.b for r in rows.select(c.bucket("month").alias("b")).collect()][:3] == ["2024-01-01", "2024-01-01", "2024-02-01"]


def test_transforms(spark):
    rows = spark.sql("SELECT make_timestamp_ntz(2024, 1, id, 13, 5, 6) AS d FROM VALUES (3), (4), (9) AS t(id)")
    assert [r.b for r in rows.select(DateColumn("d", "timestamp", "datetime_to_date").bucket("day").alias("b")).collect()] == ["2024-01-03", "2024-01-04", "2024-01-09"]
    shifted = DateColumn("d", "timestamp", "date_add({col}, 30)")
    assert rows.where(shifted.between("2024-02-01", "2024-02-03")).count() == 2 and rows.select(shifted.bucket("month").alias("b")).distinct().first().b == "2024-02-01"
    assert rows.select(DateColumn("d", "timestamp", bucketed="concat('w', weekofyear({col}))").bucket("week").alias("b")).distinct().count() == 2
    with pytest.raises(ValueError, match="unknown date transform"):
        DateColumn("d", "date", "upside_down")
