"""Row filters as predicates on raw columns, so that they reach the scan."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.intervals import DaySet


def _day(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def between_dates(column: Column, first: str | None = None, last: str | None = None) -> Column:
    """first <= day <= last on a timestamp or date, as a half-open range that keeps the whole last day."""
    out = F.lit(True)
    if first:
        out = column >= _day(first)
    if last:
        end = column < _day((date.fromisoformat(last) + timedelta(days=1)).isoformat())
        out = out & end if first else end
    return out


def between_written(column: Column, label: str, first: str, last: str, number: bool = False) -> Column:
    """The same for a column that holds dates in a spelling that sorts by time (YYYYMMDD, YYYY-MM-DD, YYYYMM), as text or number: typed literals, which the scan can use."""
    pattern = {"YYYYMMDD": "%Y%m%d", "YYYY-MM-DD": "%Y-%m-%d", "YYYYMM": "%Y%m"}[label]
    low, high = (date.fromisoformat(x).strftime(pattern) for x in (first, last))
    return column.between(F.lit(int(low)), F.lit(int(high))) if number else column.between(low, high)


def in_dates(rows: DataFrame, column: str, dates: list[str] | DataFrame) -> DataFrame:
    """Rows whose day is in dates: a list becomes ranges for the scan, a DataFrame (dt) a semi-join."""
    from ledgerline.functions.datetypes import DateColumn

    return DateColumn(column).within(rows, dates)


def except_dates(rows: DataFrame, column: str, dates: list[str]) -> DataFrame:
    """Rows whose day is not in dates; rows without a day stay."""
    from ledgerline.functions.datetypes import DateColumn

    return DateColumn(column).without(rows, dates)


def canonical_range(dt: Column, first: str | None = None, last: str | None = None) -> Column:
    """first <= dt <= last on canonical text; YYYYMM is held against the bounds' months."""

    def side(bound: str, low: bool) -> Column:
        b = F.when(F.length(dt) == 6, bound[:7].replace("-", "")).otherwise(bound)
        return dt >= b if low else dt <= b

    out = F.lit(True)
    for bound, low in ((first, True), (last, False)):
        if bound:
            out = out & side(bound, low)
    return out


#: What a condition can begin with, and what then holds between the column and the rest of the text. The first that fits counts.
_OPERATORS: list[tuple[str, Callable[[Column, str], Column]]] = [
    ("!~=", lambda c, x: ~c.like(x)),
    ("~=", lambda c, x: c.like(x)),
    ("!=", lambda c, x: c != x),
    ("=", lambda c, x: c == x),
]


def _one_of(c: Column, text: str) -> Column:
    """Values set apart by commas; a value in single quotes is taken as it is, commas and percent signs included. A single value with a percent sign is a pattern."""
    pieces = [(quoted is not None, quoted if quoted is not None else bare.strip()) for quoted, bare in ((m["quoted"], m["bare"]) for m in _VALUE.finditer(text))]
    if len(pieces) == 1 and not pieces[0][0] and "%" in pieces[0][1]:
        return c.like(pieces[0][1])
    return c.isin([value for _, value in pieces])


_VALUE = re.compile(r"(?:^|(?<=,))\s*(?:'(?P<quoted>[^']*)'|(?P<bare>[^,]*))\s*(?=,|$)")


def conditions(where: dict[str, str]) -> Column:
    """All of the conditions on columns: `value` or `=value`, `!=value`, `~=pattern`, `!~=pattern` (LIKE), `a,b` (one of), `%x%` (LIKE); `'a,b'` is one value."""
    tests = []
    for name, text in where.items():
        operator, test = next(((o, t) for o, t in _OPERATORS if text.startswith(o)), ("", _one_of))
        tests.append(test(F.col(name), text[len(operator) :]))
    return reduce(Column.__and__, tests, F.lit(True))


@dataclass(frozen=True)
class DateFilter:
    """Which days a profile covers: none (all), between (with gaps), or in_list."""

    kind: str = "none"
    days: DaySet = field(default_factory=DaySet)

    @property
    def excluded(self) -> DaySet:
        """The gaps between the first and the last day."""
        return DaySet(((self.days.runs[0][0], self.days.runs[-1][1]),)) - self.days if self.days else DaySet()

    def apply(self, rows: DataFrame, column) -> DataFrame:
        """column: a name, of dates or timestamps, or a DateColumn."""
        from ledgerline.functions.datetypes import DateColumn

        column = DateColumn(column) if isinstance(column, str) else column
        return rows if self.kind == "none" else column.within(rows, self.days)


def plan_filter(matching: list[str], vintage: str, sample: list[str] | None = None) -> DateFilter:
    """A sample is listed; matching days (or months) are a range without its gaps, and where no day matches, no row is kept. The vintage `all` has no filter."""
    if sample is not None:
        return DateFilter("in_list", DaySet.of(sample))
    if vintage == "all":
        return DateFilter()
    return DateFilter("between", DaySet.of(matching))
