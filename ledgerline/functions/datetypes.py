"""Date columns as they are stored: each type knows how a day is written, so that filters are typed literals on the raw column and reach the scan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.dates import DATE_TYPES, bucket, parse_date
from ledgerline.functions.intervals import DaySet, days_of, runs_of_months
from ledgerline.functions.predicates import between_dates

# Python's patterns of the spellings that columns are stored in.
_WRITTEN = {"YYYY-MM-DD": "%Y-%m-%d", "YYYYMMDD": "%Y%m%d", "YYYYMM": "%Y%m", "DDMONYYYY": "%d%b%Y", "DD-MON-YYYY": "%d-%b-%Y", "MM/DD/YYYY": "%m/%d/%Y"}
#: Spellings whose order is that of time.
_SORTED = ("YYYY-MM-DD", "YYYYMMDD", "YYYYMM")
_NATIVE = ("date", "timestamp", "datetime")
_NUMBERS = ("num", "integer", "int", "number", "num_yyyymm")
#: More ranges than this are joined to coarser ones, whose gaps are listed.
RANGES = 32
# The date transforms that have a name.
TRANSFORMS = {"datetime_to_date": "CAST({col} AS DATE)", "to_char": "date_format({col}, 'yyyy-MM-dd')"}


@dataclass(frozen=True)
class DateColumn:
    """A column that holds dates of one of the types of DATE_TYPES: dates and timestamps, numbers such as 20241001 or 202410, or text in one spelling. Numbers and compact text of six digits are months (YYYYMM), of eight days.

    transform: an expression in which {col} stands for the column, or one of the names of TRANSFORMS; it gives a date, a timestamp, or text that begins with YYYY-MM-DD or is YYYYMMDD or YYYYMM. Filters then hold for what it gives. bucketed: an expression of the bucket in which {col} stands for the date.
    """

    name: str
    kind: str = "date"
    transform: str = ""
    bucketed: str = ""

    def __post_init__(self) -> None:
        if self.kind not in DATE_TYPES:
            raise ValueError(f"unknown date type {self.kind!r} of {self.name}; known are {', '.join(DATE_TYPES)}")
        if self.transform and "{col}" not in self.transform and self.transform not in TRANSFORMS:
            raise ValueError(f"unknown date transform {self.transform!r} of {self.name}: it has no {{col}} and is none of {', '.join(TRANSFORMS)}")

    @property
    def monthly(self) -> bool:
        return DATE_TYPES[self.kind] == "YYYYMM"

    @property
    def _digits(self) -> bool:
        """Whether both days (YYYYMMDD) and months (YYYYMM) can be written in the column."""
        return self.kind in _NUMBERS or self.kind == "string_compact"

    @property
    def _column(self) -> Column:
        return F.col(self.name)

    @property
    def _text(self) -> Column:
        """The column as text; of a transformed one what the transform gives."""
        if not self.transform:
            return self._column.cast("string")
        return F.expr(TRANSFORMS.get(self.transform, self.transform).replace("{col}", f"`{self.name}`")).cast("string")

    def day(self) -> Column:
        """The date; of a month its first day; null for what can't be read."""
        if self.kind in _NATIVE and not self.transform:
            return self._column.cast("date")
        if self._digits or self.transform:
            text = F.trim(self._text)
            digits = F.try_to_date(F.when(F.length(text) == 6, F.concat(text, F.lit("01"))).when(F.length(text) == 8, text), "yyyyMMdd")
            return F.coalesce(digits, F.try_to_date(F.left(text, F.lit(10)), "yyyy-MM-dd")) if self.transform else digits
        return F.try_to_date(parse_date(self._column), "yyyy-MM-dd")

    def bucket(self, vintage: str) -> Column:
        """bucket() of the day; a month's day bucket is the month itself, as YYYYMM."""
        if self.bucketed:
            return F.expr(self.bucketed.replace("{col}", f"`{self.name}`")).cast("string")
        if vintage == "day" and (self._digits or self.transform):
            text = F.trim(self._text)
            return F.when(self.day().isNull(), None).when(F.length(text) == 6, text).otherwise(bucket(self.day(), "day"))
        return bucket(self.day(), vintage)

    def written(self, day: str) -> Column:
        """A day (YYYY-MM-DD) or month (YYYYMM) as a literal of the column's type."""
        return self._literal(days_of(day)[0], DATE_TYPES[self.kind])

    def _literal(self, at: date, label: str) -> Column:
        if self.kind in _NATIVE:
            return F.lit(at)
        text = at.strftime(_WRITTEN[label]).upper()
        return F.lit(int(text)) if self.kind in _NUMBERS else F.lit(text)

    def inside(self, days: DaySet) -> Column:
        """Whether the day is one of the days, or the month has one, by comparisons of the raw column with literals of its type, which reach the scan: at most RANGES ranges and, where there are more runs than that, a list of the days that are missing in
        them (or of all days, if those are fewer). Text whose order isn't that of time is held against how whole months begin and end, and a list of other days. Null for null."""
        at, spelling = self._column, DATE_TYPES[self.kind]
        if self.transform:
            return self._held(self.day(), self.day(), days, F.lit)
        if self.kind in _NATIVE:
            return self._held(at, at.cast("date"), days, F.lit, lambda a, z: between_dates(at, a.isoformat(), z.isoformat()))
        if self._digits or spelling in _SORTED:
            tests = [] if self.monthly else [self._held(at, at, days, lambda d: self._literal(d, spelling))]
            if self._digits and (months := days.months().whole_months()[0]):
                runs = runs_of_months(months)
                month = lambda d: self._literal(d, "YYYYMM")
                # as text, days lie between months
                tests.append(reduce(Column.__or__, [at.between(month(a), month(z)) for a, z in runs]) if self.kind in _NUMBERS and len(runs) <= RANGES else at.isin([month(d) for d in months]))
            return reduce(Column.__or__, tests) if tests else F.lit(False)
        firsts, rest = days.whole_months()
        ends = _WRITTEN[spelling].split("%d")  # what stands before and behind the day
        tests = [at.like(f"{d.strftime(ends[0]).upper()}%{d.strftime(ends[1]).upper()}") for d in firsts]
        if rest:
            tests.append(at.isin([self._literal(d, spelling) for d in rest.days()]))
        return _any(tests)

    @staticmethod
    def _held(at: Column, listed: Column, days: DaySet, literal: Callable[[date], Column], ranged: Callable[[date, date], Column] | None = None) -> Column:
        rough = days.coarse(RANGES)
        out = _any([ranged(a, z) if ranged else at.between(literal(a), literal(z)) for a, z in rough.runs])
        if holes := rough - days:
            few = len(holes) <= len(days)
            of = listed.isin([literal(d) for d in (holes if few else days).days()])
            out = out & (~of if few else of)
        return out

    def between(self, first: str | None, last: str | None) -> Column:
        """first <= day <= last; months are held against the bounds' months."""
        if not first and not last:
            return F.lit(True)
        if self.kind in _NATIVE and not self.transform:
            return between_dates(self._column, first, last)
        if first and last:
            return self.inside(DaySet.between(first, last))
        day = self.day()
        if self.transform or not (self._digits or DATE_TYPES[self.kind] in _SORTED):
            return day >= F.lit(days_of(first)[0]) if first else day <= F.lit(days_of(last)[1])
        at, month = self._column, self._literal(days_of(first or last)[0], "YYYYMM")
        if self.monthly:
            return at >= month if first else at <= month
        own = self.written(first or last)
        if not self._digits:
            return at >= own if first else at <= own
        if self.kind in _NUMBERS:  # those of six digits lie below all of eight
            return (at >= own) | at.between(month, F.lit(999_999)) if first else at.between(F.lit(10_000_000), own) | (at <= month)
        return (at >= own) | (at == month) if first else at <= own

    def _listed(self, rows: DataFrame, days: DataFrame) -> DataFrame:
        return days.select(F.coalesce(F.try_to_date("dt", "yyyy-MM-dd"), F.try_to_date(F.concat("dt", F.lit("01")), "yyyyMMdd")).alias("__day")).where("__day is not null").distinct()

    def within(self, rows: DataFrame, days: list[str] | DaySet | DataFrame) -> DataFrame:
        """Rows of the given days (YYYY-MM-DD, or YYYYMM): a list or set, however long, becomes ranges at the scan; a DataFrame (dt) a semi-join."""
        if isinstance(days, DataFrame):
            return rows.join(self._listed(rows, days), self.day() == F.col("__day"), "left_semi")
        return rows.where(self.inside(days if isinstance(days, DaySet) else DaySet.of(days)))

    def without(self, rows: DataFrame, days: list[str] | DaySet | DataFrame) -> DataFrame:
        """Rows of other days; rows without a day stay."""
        if isinstance(days, DataFrame):
            return rows.join(self._listed(rows, days), self.day() == F.col("__day"), "left_anti")
        gone = days if isinstance(days, DaySet) else DaySet.of(days)
        if not gone:
            return rows
        # what has no day is null, or text that no range holds
        return rows.where(~F.coalesce(self.inside(gone), F.lit(False)) if self.transform else self._column.isNull() | ~self.inside(gone))


def _any(tests: list[Column]) -> Column:
    """Whether one of the tests holds, as a tree of little depth."""
    half = len(tests) // 2
    return F.lit(False) if not tests else tests[0] if len(tests) == 1 else _any(tests[:half]) | _any(tests[half:])
