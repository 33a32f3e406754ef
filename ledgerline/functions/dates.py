"""Dates in many spellings, as Column expressions: canonical form, spelling labels, buckets, labels, spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spelling label, shape (after upper-casing), Spark pattern.
FORMATS = [
    ("YYYY-MM-DDTHH:MM:SS.ffffff", r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}\.\d{1,6}$", "yyyy-M-d'T'H:m:s"),
    ("YYYY-MM-DDTHH:MM:SS", r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}$", "yyyy-M-d'T'H:m:s"),
    ("YYYY-MM-DD HH:MM:SS.ffffff", r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}\.\d{1,6}$", "yyyy-M-d H:m:s"),
    ("YYYY-MM-DD HH:MM:SS", r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$", "yyyy-M-d H:m:s"),
    ("YYYY-MM-DD", r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    ("DDMONYYYY:HH:MM:SS.ffffff", r"^\d{1,2}[A-Z]{3}\d{4}:\d{1,2}:\d{1,2}:\d{1,2}\.\d{1,6}$", "dMMMyyyy:H:m:s"),
    ("DDMONYYYY:HH:MM:SS", r"^\d{1,2}[A-Z]{3}\d{4}:\d{1,2}:\d{1,2}:\d{1,2}$", "dMMMyyyy:H:m:s"),
    ("DDMONYYYY", r"^\d{1,2}[A-Z]{3}\d{4}$", "dMMMyyyy"),
    ("DDMONYY", r"^\d{1,2}[A-Z]{3}\d{2}$", "dMMMyy"),
    ("DD-MON-YYYY HH24:MI:SS", r"^\d{1,2}-[A-Z]{3}-\d{4} \d{1,2}:\d{1,2}:\d{1,2}$", "d-MMM-yyyy H:m:s"),
    ("DD-MON-YYYY", r"^\d{1,2}-[A-Z]{3}-\d{4}$", "d-MMM-yyyy"),
    ("DD-MON-YY", r"^\d{1,2}-[A-Z]{3}-\d{2}$", "d-MMM-yy"),
    ("YYYY/MM/DD HH:MM:SS", r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$", "yyyy/M/d H:m:s"),
    ("YYYY/MM/DD", r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    ("MM/DD/YYYY", r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
]

# Spark patterns by which a date is written in each spelling.
WRITE = {
    "YYYY-MM-DD": "yyyy-MM-dd",
    "YYYYMMDD": "yyyyMMdd",
    "YYYYMM": "yyyyMM",
    "DDMONYYYY": "ddMMMyyyy",
    "DDMONYY": "ddMMMyy",
    "DD-MON-YYYY": "dd-MMM-yyyy",
    "DD-MON-YY": "dd-MMM-yy",
    "YYYY/MM/DD": "yyyy/MM/dd",
    "MM/DD/YYYY": "MM/dd/yyyy",
    "YYYY-MM-DD HH:MM:SS": "yyyy-MM-dd HH:mm:ss",
    "DDMONYYYY:HH:MM:SS": "ddMMMyyyy:HH:mm:ss",
}

# The spelling that each configured date type has.
DATE_TYPES = {
    "string_compact": "YYYYMMDD",
    "string_dash": "YYYY-MM-DD",
    "string": "YYYY-MM-DD",
    "string_mon": "DDMONYYYY",
    "string_mon_dash": "DD-MON-YYYY",
    "string_us": "MM/DD/YYYY",
    "num": "YYYYMMDD",
    "integer": "YYYYMMDD",
    "int": "YYYYMMDD",
    "number": "YYYYMMDD",
    "num_yyyymm": "YYYYMM",
    "date": "YYYY-MM-DD",
    "timestamp": "YYYY-MM-DD",
    "datetime": "YYYY-MM-DD",
}

VINTAGES = ("day", "week", "month", "quarter", "year")


#: A colon between two digits of seconds and a fraction of three or more at the end.
_FRACTION = r"(?<=:[0-9]{2}):(?=[0-9]{3,}$)"


def _clean(value: Column) -> Column:
    """Trimmed, upper-cased, without a trailing Z; a fraction of a second is set off by a point."""
    return F.regexp_replace(F.rtrim(F.upper(F.trim(value)), F.lit("Z")), _FRACTION, ".")


def _as_timestamp(whole: Column, pattern: str) -> Column:
    """A spelling without fraction as a timestamp, or null. Two-digit years are those from 1969 to 2068."""
    if pattern.endswith("yy") and not pattern.endswith("yyyy"):
        year = F.right(whole, F.lit(2))
        century = F.when(year >= "69", "19").otherwise("20")
        whole, pattern = F.concat(F.substr(whole, F.lit(1), F.length(whole) - 2), century, year), f"{pattern}yy"
    return F.try_to_timestamp(whole, F.lit(pattern))


def parse_date(value: Column) -> Column:
    """A date as text YYYY-MM-DD, six digits as they are (YYYYMM); null if no spelling fits.

    Eight digits are YYYYMMDD; other runs of five and more are days since 1960-01-01, or seconds from 100,000,000 on.
    """
    v = _clean(value)
    whole = F.regexp_replace(v, r"\.\d{1,6}$", "")
    out = F.lit(None).cast("string")
    out = F.when(
        v.rlike(r"^\d{5,}$"),
        F.when(F.length(v) == 8, F.date_format(F.try_to_date(v, "yyyyMMdd"), "yyyy-MM-dd"))
        .when(F.length(v) == 6, v)
        .when(F.length(v) <= 8, _days(v))
        .otherwise(_seconds(v)),
    ).otherwise(out)
    for _, shape, pattern in reversed(FORMATS):
        out = F.when(v.rlike(shape), F.date_format(_as_timestamp(whole, pattern), "yyyy-MM-dd")).otherwise(out)
    return out


def _days(digits: Column) -> Column:
    return F.date_format(F.date_add(F.lit("1960-01-01").cast("date"), digits.try_cast("int")), "yyyy-MM-dd")


def _seconds(digits: Column) -> Column:
    n = F.when(F.length(digits) <= 12, digits.try_cast("long"))
    return F.when(n >= 100_000_000, F.date_format(F.timestamp_seconds(n - 315_619_200), "yyyy-MM-dd"))


def detect_format(value: Column) -> Column:
    """The label of a spelling; null if none fits."""
    v = F.regexp_replace(F.upper(F.trim(value)), "Z+$", "")
    whole = F.regexp_replace(v, r"\.\d{1,6}$", "")
    n = F.length(v)
    out = F.when(v.rlike(r"^\d{5,}$"), F.when(n == 8, "YYYYMMDD").when(n == 6, "YYYYMM").when(n >= 9, "SAS_DATETIME").otherwise("SAS_DATE"))
    for label, shape, pattern in reversed(FORMATS):
        out = F.when(v.rlike(shape) & _as_timestamp(whole, pattern).isNotNull(), label).otherwise(out)
    return out


def write_date(date: Column, label: str) -> Column:
    """A date in a spelling; months in capitals. The labels are those of WRITE, SAS_DATE and SAS_DATETIME."""
    if label == "SAS_DATE":
        return F.datediff(date, F.lit("1960-01-01").cast("date")).cast("string")
    if label == "SAS_DATETIME":
        return (F.datediff(date, F.lit("1960-01-01").cast("date")).cast("long") * 86_400).cast("string")
    return F.upper(F.date_format(date, WRITE[label]))


def bucket(date: Column, vintage: str) -> Column:
    """The first day of the day, week (Monday), month, quarter or year, as text; all: one bucket."""
    if vintage == "all":
        return F.lit("all")
    if vintage not in VINTAGES:
        raise ValueError(f"unknown vintage {vintage!r}")
    return (date.cast("date") if vintage == "day" else F.trunc(date.cast("date"), vintage)).cast("string")


def bucket_text(dt: Column, vintage: str) -> Column:
    """bucket() of canonical text; what isn't ten characters long (YYYYMM, labels) stays."""
    return F.when(F.length(dt) == 10, bucket(F.try_to_date(dt, "yyyy-MM-dd"), vintage)).otherwise(dt)


def vintage_label(dt: Column, vintage: str) -> Column:
    """Mar 5, 2025 / 2025-W10 / Mar 2025 / Q1 2025 / 2025; YYYYMM as a month, other text as it is."""
    d = F.try_to_date(dt, "yyyy-MM-dd")
    six = F.date_format(F.try_to_date(F.concat(dt, F.lit("01")), "yyyyMMdd"), "MMM yyyy")
    of = {
        "day": F.date_format(d, "MMM d, yyyy"),
        "week": F.concat(F.extract(F.lit("YEAROFWEEK"), d).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(d).cast("string"), 2, "0")),
        "month": F.date_format(d, "MMM yyyy"),
        "quarter": F.concat(F.lit("Q"), F.quarter(d).cast("string"), F.lit(" "), F.year(d).cast("string")),
        "year": F.year(d).cast("string"),
    }
    return F.coalesce(F.when(F.length(dt) == 6, six).otherwise(of.get(vintage, dt)), dt)


def bucket_spans(first: Column, last: Column, vintage: str) -> Column:
    """Array of (key, start, end) of all buckets that first to last touch, cut to that range."""
    days = F.transform(F.sequence(first, last), lambda d: F.struct(bucket(d, vintage).alias("key"), d.alias("d")))
    keys = F.array_sort(F.array_distinct(F.transform(days, lambda x: x["key"])))

    def span(k: Column) -> Column:
        own = F.transform(F.filter(days, lambda x: x["key"] == k), lambda x: x["d"])
        return F.struct(k.alias("key"), F.array_min(own).alias("start"), F.array_max(own).alias("end"))

    return F.transform(keys, span)
