"""The store among several writers, its versions, SQL over it, and the commands on it."""

import pytest
from pyspark.sql import functions as F

from ledgerline.__main__ import main
from ledgerline.operators.reconcile import compare_profiles, pass_fail, pass_fail_rows
from ledgerline.plans.report import top_lines
from ledgerline.plans.runner import store_sql
from ledgerline.sources.store import Conflict, Store


def counts(spark, name, n):
    return spark.createDataFrame([(name, f"2024-01-{i + 1:02d}", i) for i in range(n)], "source_table string, dt string, row_count bigint")


def test_second_writer_follows_the_first(spark, tmp_path):
    one, two = (Store(spark, f"file://{tmp_path}/s") for _ in range(2))
    one.upsert("row_counts", counts(spark, "a", 2).unionAll(counts(spark, "b", 2)))
    number, folders = two._last("row_counts")
    one.replace("row_counts", "a", counts(spark, "a", 5))
    two._put("row_counts", counts(spark, "b", 7), ["b"], number, folders)  # begun before the other's commit
    assert {r.source_table: r.n for r in one.read("row_counts").groupBy("source_table").agg(F.count("*").alias("n")).collect()} == {"a": 5, "b": 7}
    for instead_of in (["a"], None):
        with pytest.raises(Conflict):
            two._put("row_counts", counts(spark, "a", 1), instead_of, number, folders)
    assert [one.read("row_counts", at=n).count() for n in (0, *one.versions("row_counts"))] == [0, 4, 7, 12]
    one.vacuum("row_counts", keep=1)
    with pytest.raises(ValueError, match="no commit 1"):
        one.read("row_counts", at=1)


def test_sql_over_the_store_and_its_history(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.upsert("row_counts", counts(spark, "a", 3))
    assert [tuple(r) for r in store_sql(store, "SELECT source_table, sum(row_count) FROM row_counts GROUP BY 1", note="totals")] == [("a", 3)]
    assert len(store_sql(store, "SELECT * FROM row_counts", limit=2)) == 2
    for bad in ("SELECT nope FROM row_counts", "DROP TABLE row_counts"):
        with pytest.raises(Exception):
            store_sql(store, bad)
    kept = store.history().collect()
    assert [r.status for r in kept] == ["error", "error", "ok", "ok"] and kept[0].error == "only queries that read are run" and "nope" in kept[1].error and (kept[3].note, kept[3].rows, kept[3].seconds > 0) == ("totals", 1, True)


def test_commands_on_a_store(spark, tmp_path, capsys):
    (tmp_path / "rows.csv").write_text("run_date,cnt\n01JAN2024,5\n20240102,7\n2024-01-02,9\n")
    (tmp_path / "cols.csv").write_text("column_name,dt,col_type,col_count,col_avg\nx,2024-01-01,numeric,5,1.5\n")
    at = f"file://{tmp_path}/s"
    main(["load-row", at, "t", f"{tmp_path}/rows.csv"])
    main(["load-col", at, "t", f"{tmp_path}/cols.csv"])
    main(["sql", at, "SELECT dt, row_count FROM row_counts ORDER BY dt"])
    assert "2024-01-01\t5\n2024-01-02\t9" in capsys.readouterr().out
    main(["sql", at, "SELECT n_total, mean FROM col_stats"])
    assert "5\t1.5" in capsys.readouterr().out
    main(["history", at])
    assert "SELECT n_total" in capsys.readouterr().out
    assert Store(spark, at).read("metadata").first().row_count_total == 14


def test_most_frequent_values_are_compared(spark):
    stats = "column_name string, dt string, col_type string, n_total bigint, n_missing bigint, n_unique bigint, mean double, std double, min_val string, max_val string, top_10 string"
    of = lambda *tops: spark.createDataFrame([("c", f"2024-0{i + 1}-01", "categorical", 9, 0, 3, None, None, "a", "c", t) for i, t in enumerate(tops)], stats)
    out = compare_profiles(of("a(3); b(2)", "a(3); b(2)", "a(3)", None), of("b(2); a(3)", '[["a", 3], ["b", 1]]', "a(3); z (4)(1)", "a(1)"), vintage="month")
    assert [r.top_10_match for r in out.orderBy("dt").collect()] == [True, False, False, None]
    assert top_lines(out) == ["TOP   c Feb 2024", "      a: 3, 3", "      b: 2, 1", "TOP   c Mar 2024", "      a: 3, 3", "      z (4): -, 1"]
    assert {(r.vintage_label, r.result) for r in pass_fail_rows(out).collect()} == {(f"{m} 2024", "PASS") for m in ("Jan", "Feb", "Mar", "Apr")}
    with pytest.raises(ValueError, match="more than 3 buckets"):
        pass_fail(out, most=3)
