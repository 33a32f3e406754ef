"""python -m ledgerline: profile, compare-row, compare-col, diff, run; load-row, load-col, sql and history on a store. Results go to the screen, or with --out to a folder as CSV."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.datetypes import DateColumn
from ledgerline.operators.diff import keyed_diff
from ledgerline.operators.profile import profile
from ledgerline.operators.reconcile import compare_profiles, compare_rows, pass_fail, pass_fail_rows
from ledgerline.operators.rowcount import canonical, row_counts
from ledgerline.plans.report import top_lines
from ledgerline.plans.runner import run_project, store_sql
from ledgerline.plans.spec import Project
from ledgerline.session import session
from ledgerline.sources.readers import Side, read_profile, read_row_counts, read_side
from ledgerline.sources.store import Store


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="ledgerline")
    commands = top.add_subparsers(dest="command", required=True)
    for name, tables in (("profile", ["table"]), ("compare-row", ["left", "right"]), ("compare-col", ["left", "right"]), ("diff", ["left", "right"])):
        p = commands.add_parser(name)
        for t in tables:
            p.add_argument(t)
        p.add_argument("--source", default="parquet")
        p.add_argument("--date")
        p.add_argument("--date-type", default="date")
        p.add_argument("--vintage", default="month")
        p.add_argument("--keys", default="")
        p.add_argument("--columns", default="")
        p.add_argument("--out")
    run = commands.add_parser("run")
    run.add_argument("project")
    run.add_argument("--store")
    run.add_argument("--out")
    for name in ("load-row", "load-col"):
        p = commands.add_parser(name)
        p.add_argument("store")
        p.add_argument("name")
        p.add_argument("path")
    p = commands.add_parser("sql")
    p.add_argument("store")
    p.add_argument("query")
    p.add_argument("--limit", type=int, default=200)
    p = commands.add_parser("history")
    p.add_argument("store")
    p.add_argument("--limit", type=int, default=50)
    return top


def _on_store(args: argparse.Namespace, store: Store) -> None:
    """Commands on a store: series and profiles from CSV files go in, queries over its tables come out."""
    if args.command == "load-row":
        store.upsert("row_counts", canonical(read_row_counts(store.spark, args.path)).withColumn("source_table", F.lit(args.name)))
        store.backfill()
    elif args.command == "load-col":
        store.upsert("col_stats", read_profile(store.spark, args.path).withColumn("source_table", F.lit(args.name)))
    elif args.command == "history":
        store.history(args.limit).show(args.limit, truncate=60)
    else:
        for row in store_sql(store, args.query, args.limit):
            print("\t".join("" if v is None else str(v) for v in row))


def _show(rows: DataFrame, out: str | None, name: str) -> None:
    if out:
        rows.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{out}/{name}")
    else:
        rows.show(1000, truncate=False)


def main(argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = session()
    if args.command in ("load-row", "load-col", "sql", "history"):
        _on_store(args, Store(spark, args.store))
        return
    if args.command == "run":
        project = Project.from_json(Path(args.project).read_text())
        for name, outcome in run_project(spark, project, Store(spark, args.store) if args.store else None).items():
            _show(outcome.rows.where("status <> 'match'").orderBy("dt"), args.out, f"{name}-rows")
            for warning in outcome.warnings():
                print(f"WARNING {warning}")
            if outcome.columns is not None:
                daily = outcome.pair.vintage in ("day", "week")
                _show((pass_fail_rows if daily else pass_fail)(outcome.columns), args.out, f"{name}-columns")
                for line in top_lines(outcome.columns):
                    print(line)
            outcome.release()
        return
    names = [c for c in args.columns.split(",") if c]
    tables = [read_side(spark, Side(t, args.source, t)) for t in ([args.table] if args.command == "profile" else [args.left, args.right])]
    if args.command == "diff":
        keys = [k for k in args.keys.split(",") if k]
        found = keyed_diff(*tables, keys, names or [c for c in tables[0].columns if c not in keys])
        for part in ("summary", "by_column", "examples", "warnings"):
            _show(getattr(found, part)(), args.out, part)
        return
    dated = DateColumn(args.date, args.date_type) if args.date else None
    if args.command == "compare-row":
        _show(compare_rows(*[row_counts(t, dated) for t in tables]).orderBy("dt"), args.out, "rows")
        return
    picked = [c for c in names or tables[0].columns if c != args.date]
    profiles = [profile(t.select(*picked, *([dated.day().alias("__day")] if dated else [])), "__day" if dated else None, args.vintage if dated else "all", picked) for t in tables]
    _show(profiles[0] if args.command == "profile" else pass_fail(compare_profiles(*profiles, vintage=args.vintage)), args.out, args.command)


if __name__ == "__main__":
    main()
