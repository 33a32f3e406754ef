import pytest
from pyspark.sql import functions as F

from ledgerline.functions.dates import bucket_spans, bucket_text, detect_format, parse_date, vintage_label

CASES = [
    ("2024-10-01", "2024-10-01", "YYYY-MM-DD"),
    ("2024-10-01 00:00:00", "2024-10-01", "YYYY-MM-DD HH:MM:SS"),
    ("2024-10-01T00:00:00.123Z", "2024-10-01", "YYYY-MM-DDTHH:MM:SS.ffffff"),
    (" 2024-1-5 ", "2024-01-05", "YYYY-MM-DD"),
    ("10MAR2025:00:00:00.5", "2025-03-10", "DDMONYYYY:HH:MM:SS.ffffff"),
    ("15JAN2026", "2026-01-15", "DDMONYYYY"),
    ("15jan26", "2026-01-15", "DDMONYY"),
    ("15JAN95", "1995-01-15", "DDMONYY"),
    ("15-JAN-2026 10:00:00", "2026-01-15", "DD-MON-YYYY HH24:MI:SS"),
    ("15-JAN-26", "2026-01-15", "DD-MON-YY"),
    ("2026/01/15", "2026-01-15", "YYYY/MM/DD"),
    ("01/15/2026", "2026-01-15", "MM/DD/YYYY"),
    ("20260115", "2026-01-15", "YYYYMMDD"),
    ("202601", "202601", "YYYYMM"),
    ("18000", "2009-04-13", "SAS_DATE"),
    ("2043360000", "2024-10-01", "SAS_DATETIME"),
]


def test_parse_and_detect(spark):
    rows = spark.createDataFrame([(c[0],) for c in CASES], "v string").select("v", parse_date(F.col("v")).alias("dt"), detect_format(F.col("v")).alias("label"))
    assert sorted(tuple(r) for r in rows.collect()) == sorted(CASES)


def test_what_is_no_date(spark):
    values = ["all", "", None, "20241399", "2024-13-01", "01Jan20241", "x" * 1000, "99999999999999", "-5", "12.5", "2025-11-03 00:00:00:000"]
    got = [r.dt for r in spark.createDataFrame([(v,) for v in values], "v string").select(parse_date(F.col("v")).alias("dt")).collect()]
    assert got == [None] * 10 + ["2025-11-03"]


@pytest.mark.parametrize(
    ("vintage", "key", "label"),
    [("day", "2025-03-05", "Mar 5, 2025"), ("week", "2025-03-03", "2025-W10"), ("month", "2025-03-01", "Mar 2025"), ("quarter", "2025-01-01", "Q1 2025"), ("year", "2025-01-01", "2025")],
)
def test_buckets_and_labels(spark, vintage, key, label):
    rows = spark.createDataFrame([("2025-03-05",), ("202503",), ("all",), (None,)], "dt string")
    got = rows.select(bucket_text(F.col("dt"), vintage).alias("b"), vintage_label(F.col("dt"), vintage).alias("l")).collect()
    assert [r.b for r in got] == [key, "202503", "all", None]
    assert [r.l for r in got] == [label, "Mar 2025", "all", None]


def test_spans(spark):
    got = spark.range(1).select(bucket_spans(F.lit("2025-01-30").cast("date"), F.lit("2025-02-04").cast("date"), "month").alias("s")).first().s
    assert [(r["key"], str(r.start), str(r["end"])) for r in got] == [("2025-01-01", "2025-01-30", "2025-01-31"), ("2025-02-01", "2025-02-01", "2025-02-04")]
