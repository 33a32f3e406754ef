"""States that add up, and record differences by digests."""

import pytest
from pyspark.sql import functions as F

from ledgerline.operators.diff import keyed_diff
from ledgerline.operators.digests import digest_diff
from ledgerline.operators.profile import numeric_profile
from ledgerline.operators.states import merged_states, profile_states, stats_of
from ledgerline.sources.store import Store


def rows(spark, n=6000):
    k = F.col("id")
    day = F.date_add(F.lit("2024-01-20").cast("date"), (k % 90).cast("int"))
    # a large mean with a small deviation: sums of squares would lose it
    return spark.range(n).select(day.alias("d"), F.when(k % 7 != 0, 1e9 + (k * 37 % 1009) / 100).alias("x"), F.when(k % 11 == 0, float("nan")).otherwise((k % 500).cast("double")).alias("y"), F.when(k % 5 == 0, " ").otherwise(F.concat(F.lit("v"), (k % 300).cast("string"))).alias("t"), k)


def test_states_add_up_to_the_profile(spark):
    df = rows(spark)
    days = profile_states(df, "d", "day", ["x", "y", "t"])
    for vintage in ("week", "month", "all"):
        got = {(r.column_name, r.dt): r for r in stats_of(merged_states(days, vintage), [0.5]).collect()}
        for want in numeric_profile(df, ["x", "y"], "d", vintage).collect():
            r = got[want.column_name, want.dt]
            assert (r.n_total, r.n_missing, float(r.min_val), float(r.max_val)) == (want.n_total, want.n_missing, float(want.min_val), float(want.max_val))
            assert r["mean"] == pytest.approx(want["mean"], rel=1e-12) and r.std == pytest.approx(want.std, rel=1e-7)
            assert abs(r.n_unique - want.n_unique) <= 0.08 * want.n_unique
            if want.column_name == "y":
                middle = df.where("not isnan(y)" + ("" if vintage == "all" else f" and date_format(trunc(d, '{vintage}'), 'yyyy-MM-dd') = '{want.dt}'")).agg(F.percentile_approx("y", 0.5).alias("m")).first().m
                assert abs(r["q50"] - middle) <= 25
        text = got["t", "all" if vintage == "all" else "2024-02-01" if vintage == "month" else "2024-01-22"]
        assert text.col_type == "categorical" and text.n_missing > 0 and text["mean"] is None and text["q50"] is None and text.min_val.startswith("v")


def test_increments_and_the_store(spark, tmp_path):
    store, df = Store(spark, f"file://{tmp_path}/store"), rows(spark, 900)
    whole = {(r.column_name, r.dt): (r.n_total, r.n_missing, r.n_unique, r.min_val) for r in stats_of(profile_states(df, "d", "month", ["x", "t"])).collect()}
    for i in range(3):
        store.add_states("t", profile_states(df.where(F.col("id") % 3 == i), "d", "month", ["x", "t"]), "month")
    store.add_states("other", profile_states(df.limit(5), "d", "month", ["x"]), "month")
    got = stats_of(store.read("profile_states").where("source_table = 't'"))
    assert {(r.column_name, r.dt): (r.n_total, r.n_missing, r.n_unique, r.min_val) for r in got.collect()} == whole


def test_states_of_nothing(spark):
    df = spark.createDataFrame([(None, None, None), ("2024-01-01", None, None)], "d string, x double, t string").withColumn("d", F.to_date("d"))
    for r in stats_of(merged_states(profile_states(df, "d"), "month"), [0.5]).collect():
        assert (r.n_total, r.n_missing, r.n_unique, r["mean"], r.std, r.min_val, r["q50"]) == (1, 1, 0, None, None, None, None) and r.dt in (None, "2024-01-01")
    assert stats_of(merged_states(profile_states(df.limit(0), "d"))).collect() == [] and profile_states(df.select("d"), "d").collect() == []


CASES = {
    "same": ([(1, "a", 1.0), (2, "b", 2.0)], [(2, "b", 2.0), (1, "a", 1.0)]),
    "value": ([(1, "a", 1.0), (2, "b", 2.0)], [(1, "a", 1.5), (2, "b", 2.0)]),
    "null and empty": ([(1, None, None)], [(1, "", None)]),
    "left only": ([(1, "a", 1.0), (3, "c", 3.0)], [(1, "a", 1.0)]),
    "right only": ([], [(1, "a", 1.0)]),
    "nothing": ([], []),
    "no keys": ([(None, "a", 1.0), (1, "a", 1.0)], [(None, "a", 1.0), (1, "a", 1.0)]),
    "swapped": ([(1, "a", 1.0), (2, "b", 1.0)], [(1, "b", 1.0), (2, "a", 1.0)]),
    "many": ([(i, str(i % 9), i / 2) for i in range(500)], [(i, str(i % 9) if i % 100 else "z", i / 2) for i in range(3, 503)]),
}


@pytest.mark.parametrize("name", CASES)
def test_digests_find_what_the_join_finds(spark, name):
    left, right = (spark.createDataFrame(x, "k long, v string, n double") for x in CASES[name])
    want, got = keyed_diff(left, right, ["k"], ["v", "n", "absent"]), digest_diff(left, right, ["k"], ["v", "n", "absent"], (3, 6))
    assert got.summary().collect() == want.summary().collect() and sorted(got.by_column().collect()) == sorted(want.by_column().collect()) and sorted(got.examples().collect()) == sorted(want.examples().collect())
    assert got.found.skipped == {"absent": "missing on left and right side"} and (got.parts == [0, 0]) == (name in ("same", "nothing", "null and empty", "no keys"))


def test_few_differences_shuffle_little(spark, tmp_path):
    wide = spark.range(200_000).select("id", *[F.sha2(F.concat(F.col("id").cast("string"), F.lit(str(i))), 256).alias(f"c{i}") for i in range(4)])
    wide.write.parquet(f"{tmp_path}/l")
    wide.withColumn("c2", F.when(F.col("id") % 1000 == 7, "x").otherwise(F.col("c2"))).write.parquet(f"{tmp_path}/r")
    left, right = spark.read.parquet(f"{tmp_path}/l"), spark.read.parquet(f"{tmp_path}/r")

    def shuffled(f) -> tuple[int, tuple]:
        executors = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False)
        total = lambda: sum(x.totalShuffleWrite() for x in map(executors().apply, range(executors().size())))
        before = total()
        return tuple(f().summary().first()), total() - before

    columns = ["c0", "c1", "c2", "c3"]
    (a, by_join), (b, by_digest) = shuffled(lambda: keyed_diff(left, right, ["id"], columns)), shuffled(lambda: digest_diff(left, right, ["id"], columns))
    assert a == b == (200_000, 0, 0, 200, 1) and by_digest < by_join / 10, (by_join, by_digest)
