"""Reports of comparisons, which are of the size of a calendar and are collected for the purpose."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.scalars import parse_top
from ledgerline.operators.reconcile import row_summary


def count_text(n: int | None) -> str:
    """1.2B, 3.4M, or digits with commas."""
    if n is None:
        return "-"
    for size, sign in ((10**9, "B"), (10**6, "M")):
        if abs(n) >= size:
            return f"{n / size:.1f}{sign}"
    return f"{n:,}"


def duration_text(seconds: float) -> str:
    minutes, s = divmod(round(seconds), 60)
    hours, m = divmod(minutes, 60)
    return f"{hours}h {m}m" if hours else f"{m}m {s}s" if m else f"{seconds:.1f}s"


def row_html(compared: DataFrame, title: str, shown: int = 10) -> str:
    """A section on row counts: ranges, totals, and the dates that don't match (the first ones open, the rest to unfold)."""
    s = row_summary(compared).first()
    rows = compared.where("status <> 'match'").orderBy("dt").collect()
    ok = not rows
    cells = lambda r: f"<tr class='{r.status}{' overlap' if r.in_overlap else ''}'><td>{escape(r.dt)}</td><td>{r.status}</td><td>{count_text(r.left_count)}</td><td>{count_text(r.right_count)}</td></tr>"
    head = "<tr><th>date</th><th>status</th><th>left</th><th>right</th></tr>"
    more = f"<details><summary>{len(rows) - shown} more</summary><table>{head}{''.join(map(cells, rows[shown:]))}</table></details>" if len(rows) > shown else ""
    return (
        f"<section><h2>{escape(title)}</h2><p class='{'ok' if ok else 'diff'}'>{'all dates match' if ok else f'{len(rows)} dates differ'}</p>"
        f"<p>left {s.left_first} to {s.left_last}, {count_text(s.left_total)} rows; right {s.right_first} to {s.right_last}, {count_text(s.right_total)} rows; {s.n_match} of {s.left_dates} dates match</p>"
        f"<table>{head}{''.join(map(cells, rows[:shown]))}</table>{more}</section>"
    )


def column_html(compared: DataFrame, title: str, vintages: int = 3) -> str:
    """A section on columns: each differing one with its worst statistic in its first buckets."""
    found: dict[str, list] = {}
    for r in compared.where("has_diff").select("left_col", "vintage_label", "dt", "worst").orderBy("left_col", "dt").collect():
        found.setdefault(r.left_col, []).append(r)
    items = "".join(f"<li><b>{escape(c)}</b>: {', '.join(f'{escape(r.vintage_label)} ({escape(r.worst)})' for r in rs[:vintages])}{f' and {len(rs) - vintages} more' if len(rs) > vintages else ''}</li>" for c, rs in found.items())
    return f"<section><h2>{escape(title)}</h2><p class='{'diff' if found else 'ok'}'>{f'{len(found)} columns differ' if found else 'all columns match'}</p><ul>{items}</ul></section>"


def top_lines(compared: DataFrame, shown: int = 10) -> list[str]:
    """The most frequent values of the columns and buckets in which they don't agree, both sides in one line each: value: left count, right count. In order of the larger count."""
    rows = compared.where("not top_10_match").select("left_col", "dt", "vintage_label", parse_top(F.col("top_10_left")).alias("l"), parse_top(F.col("top_10_right")).alias("r")).orderBy("left_col", "dt").collect()
    out = []
    for r in rows:
        out.append(f"TOP   {r.left_col} {r.vintage_label}")
        both = sorted({*r.l, *r.r}, key=lambda v: (-max(r.l.get(v, 0), r.r.get(v, 0)), v))
        out += [f"      {v}: {r.l.get(v, '-')}, {r.r.get(v, '-')}" for v in both[:shown]]
    return out


def log_lines(compared: DataFrame) -> list[str]:
    """MATCH or DIFF per column and bucket."""
    rows = compared.select("left_col", "right_col", "dt", "vintage_label", "has_diff", "worst").orderBy("left_col", "dt").collect()
    return [f"{'DIFF ' if r.has_diff else 'MATCH'} {r.left_col} = {r.right_col} {r.vintage_label}{f' {r.worst}' if r.has_diff else ''}" for r in rows]
