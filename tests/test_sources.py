"""Databases read in equal shares, and spellings learnt from whole columns."""

import json
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerline.functions.datetypes import DateColumn
from ledgerline.functions.learning import format_counts, learn_formats
from ledgerline.plans.runner import run_project
from ledgerline.plans.spec import Project
from ledgerline.sources.shares import equal_shares, share_predicates
from ledgerline.sources.store import Store

DRIVER = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def skewed(n=60):
    rng = random.Random(3)
    return [(f"2024-{1 + i // 28:02d}-{1 + i % 28:02d}", rng.choice([1, 2, 5, 200])) for i in range(n)]


def test_equal_shares():
    counts = skewed()
    cuts = equal_shares(counts, 6)
    sums = [sum(n for dt, n in counts if a <= date.fromisoformat(dt) < z) for a, z in zip([date.min, *cuts], [*cuts, date.max], strict=True)]
    assert len(sums) == 6 and max(sums) - min(sums) <= 2 * 200
    assert equal_shares([], 4) == [] == equal_shares([("2024-01-01", 9)], 4) and equal_shares([("202401", 5), ("202402", 5)], 2) == [date(2024, 2, 1)]
    assert equal_shares([("2024-01-01", 1), ("2024-01-02", 10**6), ("2024-01-03", 1)], 8)  # a day is never cut
    assert share_predicates(DateColumn("d", "num"), [date(2024, 1, 2), date(2024, 2, 3)]) == ["d < 20240102 OR d IS NULL", "d >= 20240102 AND d < 20240203", "d >= 20240203"]
    assert share_predicates(DateColumn("d", "string_compact"), [date(2024, 1, 2)])[1] == "d >= '20240102'" and share_predicates(DateColumn("d"), []) == ["1 = 1"]
    with pytest.raises(ValueError, match="don't sort by time"):
        share_predicates(DateColumn("d", "string_us"), [date(2024, 1, 2)])


def test_a_database_is_read_in_equal_shares(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, dt) for i, dt in enumerate(dt for dt, n in [(f"2024-{1 + k // 28:02d}-{1 + k % 28:02d}", rng.choice([5, 10, 60])) for k in range(112)] for _ in range(n))]
    df = spark.createDataFrame(rows, "id long, d string").withColumn("d", F.to_date("d"))
    df = df.unionByName(spark.createDataFrame([(-1, None)], "id long, d date"))
    url = "jdbc:derby:memory:shares;create=true"
    df.toDF("ID", "D").write.jdbc(url, "T", mode="overwrite", properties={"driver": DRIVER})
    df.write.parquet(f"{tmp_path}/t")
    base = {"name": "t", "table": "T", "source": "jdbc", "date_col": "D", "options": {"url": url, "driver": DRIVER, "shares": "8"}}
    config = Project.from_json(json.dumps({"pairs": {"p": {"left": base, "right": {"name": "u", "source": "parquet", "table": f"{tmp_path}/t", "date_col": "d"}, "vintage": "month"}}}))
    store = Store(spark, f"file://{tmp_path}/s")
    for _ in range(2):  # the first run leaves the counts that the second is cut by
        out = run_project(spark, config, store)["p"]
        assert {r.status for r in out.rows.collect()} == {"match"} and out.undated["left"] == (1, 0)
        out.release()
    from ledgerline.plans.runner import _read

    read = _read(spark, config.pairs[0].left, store)
    sizes = [r["count"] for r in read.groupBy(F.spark_partition_id()).count().collect()]
    assert read.count() == len(rows) + 1 and len(sizes) == 8 and max(sizes) <= 1.2 * sum(sizes) / 8 and min(sizes) >= 0.8 * sum(sizes) / 8


def test_formats_are_learnt_from_whole_columns(spark):
    rows = [(f"{1 + i % 12:02d}/{1 + i % 28:02d}/2024", f"{1 + i % 28:02d}/{1 + i % 12:02d}/2024", f"{1 + i % 9:02d}.0{1 + i % 9}.2024", f"{1 + i % 28:02d}JAN2024" if i % 10 else "soon", f"{13 + i % 9}/01/2024" if i % 2 else f"01/{13 + i % 9}/2024") for i in range(120)]
    df = spark.createDataFrame([*rows, (None, " ", "", None, None)], "us string, eu string, same string, mon string, both string")
    counts = format_counts(df, df.columns)
    halves = [format_counts(df.where(F.coalesce(F.xxhash64("us", "eu", "mon"), F.lit(0)) % 2 == i), df.columns) for i in (0, 1, -1)]
    got = learn_formats(counts)
    assert learn_formats(halves[0].unionByName(halves[1]).unionByName(halves[2])) == got  # counts add up
    assert (got["us"].label, got["us"].day_first, got["us"].sure) == ("MM/DD/YYYY", False, True) and (got["eu"].label, got["eu"].day_first, got["eu"].sure) == ("DD/MM/YYYY", True, True)
    assert (got["same"].label, got["same"].sure) == ("MM.DD.YYYY", False) and (got["both"].label, got["both"].day_first) == ("mixed order", None)
    assert (got["mon"].label, got["mon"].unread, got["mon"].blank) == ("DDMONYYYY", 12, 1) and got["eu"].blank == 1
    back = df.where("us is not null").select(*[got[c].written(got[c].day(F.col(c))).alias(f"w_{c}") for c in ("us", "eu")], "us", "eu", got["both"].day(F.col("both")).alias("b"))
    assert all(r.us == r.w_us and r.eu == r.w_eu and r.b.month == 1 for r in back.collect())
