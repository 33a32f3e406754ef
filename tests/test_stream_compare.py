"""Streams compared day by day: late rows, one-sided days, a restart, and the same result as in batch."""

from pyspark.sql import functions as F

from ledgerline.operators.reconcile import compare_rows
from ledgerline.operators.rowcount import row_counts
from ledgerline.streaming.compare import compare_streams, keep_comparison


def test_comparison_of_streams(spark, tmp_path):
    def put(side, *days):
        rows = [(f"2024-01-{d:02d} {h:02d}:30:00",) for d, n in days for h in range(n)]
        spark.createDataFrame(rows, "at string").select(F.to_timestamp("at").alias("at")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{side}")

    def run():
        sides = [spark.readStream.schema("at timestamp").parquet(f"{tmp_path}/{s}") for s in "lr"]
        keep_comparison(compare_streams(*sides, "at", "at", "2 days"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        return {r.dt: (r.left_count, r.right_count, r.diff, r.status) for r in spark.read.parquet(f"{tmp_path}/out").collect()}

    put("l", (1, 3), (2, 2), (4, 5))
    put("r", (1, 3), (3, 4), (4, 1))
    assert "2024-01-04" not in run()  # still open
    put("l", (4, 2), (12, 1))  # within two days of the last
    put("r", (4, 6), (12, 1))
    run()  # a new run goes on from the checkpoint
    put("l", (2, 9), (20, 1))  # too late for the second
    put("r", (20, 1))
    got = run()
    want = {"2024-01-01": (3, 3, 0, "match"), "2024-01-02": (2, None, None, "left_only"), "2024-01-03": (None, 4, None, "right_only"), "2024-01-04": (7, 7, 0, "match"), "2024-01-12": (1, 1, 0, "match")}
    assert got == want and spark.read.parquet(f"{tmp_path}/out").count() == len(want)
    late = (F.to_date("at") == "2024-01-02") & (F.hour("at") > 1)  # hours that only the late rows have
    batch = compare_rows(*[row_counts(spark.read.parquet(f"{tmp_path}/{s}").where(~late & (F.col("at") < "2024-01-13")), "at") for s in "lr"])
    same = {r.dt: (r.left_count, r.right_count, r.diff, r.status) for r in batch.collect()}
    assert {d: v for d, v in same.items() if d != "2024-01-02"} == {d: v for d, v in want.items() if d != "2024-01-02"}
