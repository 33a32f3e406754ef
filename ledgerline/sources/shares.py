"""Reads from databases in shares of about equal rows, cut by the daily counts that the store has of a table."""

from __future__ import annotations

from bisect import bisect_left
from datetime import date
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession

from ledgerline.functions.dates import DATE_TYPES
from ledgerline.functions.datetypes import DateColumn
from ledgerline.functions.intervals import days_of
from ledgerline.sources.readers import Side

# How a day is written in a database's SQL for each spelling whose order is that of time. Dates and timestamps are written in JDBC's own escapes.
_LITERALS = {"YYYY-MM-DD": "'{:%Y-%m-%d}'", "YYYYMMDD": "'{:%Y%m%d}'", "YYYYMM": "'{:%Y%m}'"}


def equal_shares(counts: list[tuple[str, int]], shares: int) -> list[date]:
    """The first days of all shares but the first: days are cut where the sum of counts before them comes closest to equal parts. A share has a day at least, so there may be fewer than asked for."""
    known = sorted((days_of(dt)[0], n) for dt, n in counts if n > 0)
    sums = [0, *accumulate(n for _, n in known)]
    cuts: list[int] = []
    for i in range(1, shares):
        target = sums[-1] * i / shares
        at = bisect_left(sums, target)
        if at and target - sums[at - 1] < sums[min(at, len(sums) - 1)] - target:
            at -= 1
        at = min(at, len(known) - 1)
        if at > (cuts[-1] if cuts else 0):
            cuts.append(at)
    return [known[at][0] for at in cuts]


def share_predicates(dated: DateColumn, cuts: list[date]) -> list[str]:
    """Conditions that hold for every row once: before the first cut or without a date, from cut to cut, from the last cut on. Counts that are out of date make shares uneven, and lose no row."""
    label = DATE_TYPES[dated.kind]
    if dated.transform or (dated.kind not in ("date", "timestamp", "datetime") and label not in _LITERALS):
        raise ValueError(f"{dated.name}: dates of type {dated.kind} don't sort by time, so that the table can't be cut by them")

    def written(day: date) -> str:
        if dated.kind == "date":
            return f"{{d '{day}'}}"
        if dated.kind in ("timestamp", "datetime"):
            return f"{{ts '{day} 00:00:00'}}"
        text = _LITERALS[label].format(day)
        return text.strip("'") if dated.kind in ("num", "integer", "int", "number", "num_yyyymm") else text

    if not cuts:
        return ["1 = 1"]
    at = [written(d) for d in cuts]
    return [f"{dated.name} < {at[0]} OR {dated.name} IS NULL", *[f"{dated.name} >= {a} AND {dated.name} < {z}" for a, z in zip(at, at[1:], strict=False)], f"{dated.name} >= {at[-1]}"]


def read_shares(spark: SparkSession, side: Side, series: DataFrame, shares: int) -> DataFrame:
    """A side of the source jdbc in about `shares` partitions of equal rows, by series(dt, row_count), which has a row for each day of the calendar. options: url, driver and what else the connection needs."""
    counts = [(r.dt, r.row_count) for r in series.where("dt is not null").select("dt", "row_count").collect()]
    cuts = equal_shares(counts, shares)
    options = {k: v for k, v in side.options.items() if k not in ("url", "shares")}
    return spark.read.jdbc(side.options["url"], side.table, predicates=share_predicates(side.dated, cuts), properties={"fetchsize": "5000"} | options)
