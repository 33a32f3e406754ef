"""How the dates of a whole column are spelled: shares per spelling, which orders of day and month its values allow, and what can't be read. Learnt by one aggregate over all rows, which can be added up."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.dates import WRITE, _clean, detect_format, parse_date, write_date

#: Two numbers and a year of four digits, set off by slashes, dashes or points.
_NUMBERED = r"^(\d{1,2})([/.-])(\d{1,2})\2(\d{4})$"
# The spellings of such dates, by what comes first, for each sign.
_ORDERS = {"/": ("MM/DD/YYYY", "DD/MM/YYYY"), "-": ("MM-DD-YYYY", "DD-MM-YYYY"), ".": ("MM.DD.YYYY", "DD.MM.YYYY")}
# Spark patterns of the spellings that only a column can tell.
_PATTERNS = {"DD/MM/YYYY": "dd/MM/yyyy", "MM-DD-YYYY": "MM-dd-yyyy", "DD-MM-YYYY": "dd-MM-yyyy", "MM.DD.YYYY": "MM.dd.yyyy", "DD.MM.YYYY": "dd.MM.yyyy"}


def format_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, label, n, first_over, second_over): how many values each spelling has; under the spellings of two numbers and a year, and a sign between, how many have a first, and a second number over 12.
    label is null for what can't be read; null and blank values have the label `blank`. Counts of several tables add up."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column_name", "value")
    rows = long.withColumn("v", _clean(F.col("value"))).withColumn("parts", F.when(F.col("v").rlike(_NUMBERED), F.split("v", "[/.-]")))
    label = F.when(F.coalesce(F.length("v"), F.lit(0)) == 0, "blank").when(F.col("parts").isNotNull(), F.concat(F.lit("numbered "), F.regexp_extract("v", "([/.-])", 1))).otherwise(detect_format(F.col("v")))
    over = lambda i: F.count(F.when(F.get("parts", F.lit(i)).try_cast("int") > 12, 1))
    return rows.withColumn("label", label).groupBy("column_name", "label").agg(F.count("*").alias("n"), over(0).alias("first_over"), over(1).alias("second_over"))


@dataclass(frozen=True)
class Learned:
    """label: the spelling of most values; day_first: what the numbered dates of the column are read as (None: there are none, or both orders occur); sure: whether some value tells the order; unread and blank: how many values have no date."""

    label: str | None
    day_first: bool | None
    sure: bool
    unread: int
    blank: int
    shares: dict[str, int]

    def day(self, value: Column) -> Column:
        """The date of a value of the column, read in the order that was learnt; where both orders occur, only values that allow one order."""
        v = _clean(value)
        a, b, year = (F.lpad(F.regexp_extract(v, _NUMBERED, i), n, "0") for i, n in ((1, 2), (3, 2), (4, 4)))
        day_first = F.lit(self.day_first) if self.day_first is not None else F.when(a > "12", F.lit(True)).when(b > "12", F.lit(False))
        number = F.when(day_first, F.concat_ws("-", year, b, a)).when(~day_first, F.concat_ws("-", year, a, b))
        return F.when(v.rlike(_NUMBERED), F.try_to_date(number, "yyyy-MM-dd")).otherwise(F.try_to_date(parse_date(value), "yyyy-MM-dd"))

    def written(self, day: Column) -> Column:
        """A date in the column's own spelling; as YYYY-MM-DD, if none was learnt."""
        if self.label in _PATTERNS:
            return F.date_format(day, _PATTERNS[self.label])
        return write_date(day, self.label if self.label in WRITE or self.label in ("SAS_DATE", "SAS_DATETIME") else "YYYY-MM-DD")


def learn_formats(counts: DataFrame) -> dict[str, Learned]:
    """What format_counts(), or sums of several, say of each column. Numbered dates are day first if a first number is over 12 and no second one is, month first if it is the other way round, and, if no number is over 12, as the column's other signs have it, or else month first, unsure."""
    found: dict[str, list] = {}
    for r in counts.groupBy("column_name", "label").agg(*[F.sum(c).alias(c) for c in ("n", "first_over", "second_over")]).collect():
        found.setdefault(r.column_name, []).append(r)
    out = {}
    for column, rows in found.items():
        numbered = [r for r in rows if r.label and r.label.startswith("numbered ")]
        first, second = sum(r.first_over for r in numbered), sum(r.second_over for r in numbered)
        day_first = None if not numbered or (first and second) else first > 0
        shares: dict[str, int] = {}
        for r in rows:
            if r.label in (None, "blank"):
                continue
            label = _ORDERS[r.label[-1]][1 if day_first else 0] if r in numbered and day_first is not None else "mixed order" if r in numbered else r.label
            shares[label] = shares.get(label, 0) + r.n
        of = lambda name: sum(r.n for r in rows if r.label == name)
        out[column] = Learned(max(sorted(shares), key=shares.get, default=None), day_first, bool(first) != bool(second), of(None), of("blank"), shares)
    return out
