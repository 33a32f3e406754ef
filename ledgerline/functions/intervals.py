"""Sets of days as sorted runs: union, intersection, difference, whole months, and coarser sets that hold them."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import date, timedelta

_ONE = timedelta(days=1)


def days_of(label: str) -> tuple[date, date]:
    """The first and last day of a canonical label: YYYY-MM-DD is a day, YYYYMM a month. Anything else is an error that says so."""
    try:
        if len(label) == 6:
            first = date(int(label[:4]), int(label[4:]), 1)
            return first, (first + timedelta(days=31)).replace(day=1) - _ONE
        return date.fromisoformat(label), date.fromisoformat(label)
    except ValueError as e:
        raise ValueError(f"{label!r} is no day (YYYY-MM-DD) and no month (YYYYMM)") from e


@dataclass(frozen=True)
class DaySet:
    """Days as runs (first, last): sorted, apart from each other by a day or more."""

    runs: tuple[tuple[date, date], ...] = ()

    @classmethod
    def of(cls, labels: Iterable[str]) -> DaySet:
        """From days and months in any order, repeated or not."""
        return cls.joined(map(days_of, labels))

    @classmethod
    def between(cls, first: str, last: str) -> DaySet:
        """All days from first to last; none, if last comes before first."""
        a, z = days_of(first)[0], days_of(last)[1]
        return cls(((a, z),)) if a <= z else cls()

    @classmethod
    def joined(cls, runs: Iterable[tuple[date, date]]) -> DaySet:
        out: list[tuple[date, date]] = []
        for a, z in sorted(runs):
            if out and a <= out[-1][1] + _ONE:
                out[-1] = (out[-1][0], max(z, out[-1][1]))
            else:
                out.append((a, z))
        return cls(tuple(out))

    def __bool__(self) -> bool:
        return bool(self.runs)

    def __len__(self) -> int:
        return sum((z - a).days + 1 for a, z in self.runs)

    def __contains__(self, day: date) -> bool:
        i = bisect_right(self.runs, (day, date.max)) - 1
        return i >= 0 and day <= self.runs[i][1]

    def __or__(self, other: DaySet) -> DaySet:
        return self.joined((*self.runs, *other.runs))

    def __and__(self, other: DaySet) -> DaySet:
        out, i, j = [], 0, 0
        while i < len(self.runs) and j < len(other.runs):
            (a, z), (b, y) = self.runs[i], other.runs[j]
            if max(a, b) <= min(z, y):
                out.append((max(a, b), min(z, y)))
            i, j = (i + 1, j) if z < y else (i, j + 1)
        return DaySet(tuple(out))

    def __sub__(self, other: DaySet) -> DaySet:
        if not self or not other:
            return self
        edges = [date.min, *(d for a, z in other.runs for d in (a, z)), date.max]
        gaps = [(a if a == date.min else a + _ONE, z if z == date.max else z - _ONE) for a, z in zip(edges[::2], edges[1::2], strict=True)]
        return self & DaySet(tuple((a, z) for a, z in gaps if a <= z))

    def days(self) -> list[date]:
        return [a + timedelta(days=i) for a, z in self.runs for i in range((z - a).days + 1)]

    def months(self) -> DaySet:
        """All days of every month that has one of the days."""
        return self.joined((a.replace(day=1), days_of(f"{z:%Y%m}")[1]) for a, z in self.runs)

    def coarse(self, most: int) -> DaySet:
        """A set of at most so many runs that holds this one: the smallest gaps are closed."""
        if len(self.runs) <= most:
            return self
        gaps = sorted(range(1, len(self.runs)), key=lambda i: ((self.runs[i][0] - self.runs[i - 1][1]).days, i))
        closed = {i for i in gaps[: len(self.runs) - most]}
        starts = [i for i in range(len(self.runs)) if i not in closed]
        return DaySet(tuple((self.runs[i][0], self.runs[j - 1][1]) for i, j in zip(starts, [*starts[1:], len(self.runs)], strict=True)))

    def whole_months(self) -> tuple[list[date], DaySet]:
        """The months that are there from the first day to the last, by their first days, and what is left."""
        firsts: list[date] = []
        for a, z in self.runs:
            at = a if a.day == 1 else days_of(f"{a:%Y%m}")[1] + _ONE
            while (end := days_of(f"{at:%Y%m}")[1]) <= z:
                firsts.append(at)
                at = end + _ONE
        return firsts, self - DaySet.of(f"{d:%Y%m}" for d in firsts)


def runs_of_months(firsts: list[date]) -> list[tuple[date, date]]:
    """Months that follow one another as runs (first month, last month)."""
    out: list[tuple[date, date]] = []
    for d in sorted(firsts):
        if out and days_of(f"{out[-1][1]:%Y%m}")[1] + _ONE == d:
            out[-1] = (out[-1][0], d)
        else:
            out.append((d, d))
    return out


# The calendar buckets, each by the rule that leads from a day to its first day.
_FIRST: dict[str, Callable[[date], date]] = {
    "day": lambda d: d,
    "week": lambda d: d - timedelta(days=d.weekday()),
    "month": lambda d: d.replace(day=1),
    "quarter": lambda d: d.replace(month=(d.month - 1) // 3 * 3 + 1, day=1),
    "year": lambda d: d.replace(month=1, day=1),
}


def bucket_label(label: str, vintage: str) -> str:
    """The bucket of a canonical label, as the bucket() of columns gives it; a month stays as it is under `day`."""
    if vintage == "all":
        return "all"
    return label if vintage == "day" else _FIRST[vintage](days_of(label)[0]).isoformat()
