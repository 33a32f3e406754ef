"""Comparison keys, normal forms and lenient parsing, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.functions.dates import parse_date

#: What counts as a number in text: no type suffixes, no digit separators.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
#: Numbers are compared after rounding to so many places.
PLACES = 4


def to_number(text: Column) -> Column:
    """Text as double, or null; blanks around it are ignored."""
    bare = F.trim(text)
    return F.when(bare.rlike(NUMBER), bare.try_cast("double"))


def to_count(text: Column) -> Column:
    """Text as a whole number, cut towards zero; blank or not a number: 0."""
    return F.coalesce(to_number(text).cast("long"), F.lit(0).cast("long"))


def match_key(value: Column, prefix: str, printed: bool = False) -> Column:
    """prefix_ and the number rounded, or the text itself where it is no number; null for null and blank. All zeros have one key.

    printed: of a column of doubles, each number as printf writes it, where a negative zero has its sign and what isn't finite is nan, inf or -inf."""
    bare = F.trim(value.cast("string"))
    number = to_number(bare)
    short = F.round(number, PLACES) + F.lit(0.0)
    rounded = F.when(number.isNotNull(), F.format_string(f"%.{PLACES}f", short))
    if printed:
        rounded = F.when(bare.startswith("-") & (short == 0), F.concat(F.lit("-"), rounded)).when(bare == "NaN", "nan").when(bare == "Infinity", "inf").when(bare == "-Infinity", "-inf").otherwise(rounded)
    return F.when(F.length(bare) > 0, F.concat(F.lit(f"{prefix}_"), F.coalesce(rounded, bare)))


def numbers_match(left: Column, right: Column) -> Column:
    """Whether two doubles agree after rounding; null where one is missing."""
    return F.round(F.nanvl(left, F.lit(None)), PLACES) == F.round(F.nanvl(right, F.lit(None)), PLACES)


def normalize(value: Column, dates: bool = False) -> Column:
    """Trimmed text in one normal form: dates canonical (if asked for), numbers without trailing zeros, else as it is; null becomes empty."""
    bare = F.trim(F.coalesce(value.cast("string"), F.lit("")))
    number = to_number(bare)
    text = F.regexp_replace(F.regexp_replace(F.format_string("%.10f", number), r"0+$", ""), r"\.$", "")
    out = F.coalesce(F.when(number.isNotNull() & (F.abs(number) < 1e15), text), bare)
    return F.coalesce(parse_date(bare), out) if dates else out


def apply_transform(template: str, column: str) -> Column:
    """A user expression in which {col} stands for the column."""
    return F.expr(template.replace("{col}", f"`{column}`"))


def parse_top(text: Column) -> Column:
    """`value(count); value(count)` or a JSON list of [value, count] as map<string, bigint>."""
    entry = lambda e: F.struct(F.regexp_extract(e, r"^(.*)\((\d+)\)$", 1).alias("key"), F.regexp_extract(e, r"^(.*)\((\d+)\)$", 2).try_cast("long").alias("value"))
    plain = F.map_from_entries(F.transform(F.filter(F.split(text, "; "), lambda e: e.rlike(r"^.*\(\d+\)$")), entry))
    pair = lambda p: F.struct(F.get(p, F.lit(0)).alias("key"), F.get(p, F.lit(1)).try_cast("long").alias("value"))
    listed = F.map_from_entries(F.transform(F.from_json(text, "array<array<string>>"), pair))
    return F.when(text.startswith("["), listed).otherwise(plain)
