"""Kept results, paired alternatives in rules, raw columns in buckets, a profile's file."""

import csv
import glob

import pytest

from ledgerline.operators.mapping import Rule
from ledgerline.plans.cache import ResultCache, cache_key
from ledgerline.sources.readers import read_columns
from ledgerline.sources.store import PROFILE_COLUMNS, write_profile_csv


def test_keys():
    assert cache_key("SELECT  a\n FROM t ;") == cache_key("SELECT a FROM t")
    assert cache_key("SELECT 'a  b'") != cache_key("SELECT 'a b'")
    assert cache_key("SELECT 'it''s  so',  1") == cache_key("SELECT 'it''s  so', 1")
    assert cache_key("SELECT 1", "x") != cache_key("SELECT 1", "y")


def test_results_are_kept(spark, tmp_path):
    at = str(tmp_path / "t")
    spark.range(3).write.parquet(at)
    cache, sql = ResultCache(spark, str(tmp_path / "cache")), f"SELECT count(*) AS n FROM parquet.`{at}`"
    assert cache.sql(sql).first().n == 3
    spark.range(4).write.mode("append").parquet(at)
    assert cache.sql(f"  {sql} ;".replace("count", " count")).first().n == 3
    assert cache.sql(sql, refresh=True).first().n == 7
    assert cache.sql(sql).first().n == 7
    (tmp_path / "cache" / cache_key(sql) / "broken").mkdir()  # a write that never ended
    assert cache.sql(sql).first().n == 7
    assert cache.drop(sql) and not cache.drop(sql)
    with pytest.raises(ValueError):
        cache.sql("DROP TABLE t")


def test_paired_alternatives():
    rule = Rule("(amt|cnt)_*_(dr|cr)", "(amount|number)_*_(debit|credit)")
    assert rule.apply("AMT_x_cr") == "amount_x_credit"
    assert rule.apply("cnt_y_DR") == "number_y_debit"
    assert rule.apply("sum_y_dr") is None
    assert Rule("(a|b)", "(A|B|C)").apply("a") is None
    assert Rule("(a|b)_x", "x").apply("b_x") == "x"
    assert Rule("*_(a|b)*", "*-(1|2)-*").apply("q_bz") == "q-2-q"


def test_raw_columns(spark, tmp_path):
    (tmp_path / "raw.csv").write_text("day,x,y\n05MAR2024,1,a\n20240331,2,b\n2024-04-01,3,c\nnever,4,d\n")
    got = {(r.dt, r.x) for r in read_columns(spark, str(tmp_path / "raw.csv"), "day", ["x"], "month", "2024-03-01", "2024-03-01").collect()}
    assert got == {("2024-03-01", "1"), ("2024-03-01", "2")}
    assert read_columns(spark, str(tmp_path / "raw.csv"), "day").columns == ["dt", "x", "y"]
    assert read_columns(spark, str(tmp_path / "raw.csv"), "day").count() == 4


def test_profile_file(spark, tmp_path):
    rows = spark.createDataFrame([("b", "2024", 1, "z"), ("a", "2025", 2, "z"), ("a", "2024", 3, "z")], "column_name string, dt string, n_total long, more string")
    write_profile_csv(rows, str(tmp_path / "out"))
    with open(glob.glob(f"{tmp_path}/out/*.csv")[0]) as f:
        lines = list(csv.DictReader(f))
    assert list(lines[0]) == PROFILE_COLUMNS
    assert [(x["column_name"], x["dt"], x["n_total"]) for x in lines] == [("a", "2024", "3"), ("a", "2025", "2"), ("b", "2024", "1")]
