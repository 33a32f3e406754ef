"""Two streams held against each other day by day, as compare_rows() does with tables: a day is judged once the watermarks of both sides have passed it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _counted(rows: DataFrame, time: str, late: str, name: str) -> DataFrame:
    days = rows.select(F.col(time).cast("timestamp").alias("__at")).withWatermark("__at", late).groupBy(F.window("__at", "1 day").alias("day"))
    return days.agg(F.count("*").alias(f"{name}_count"))


def _judged(left: Column, right: Column) -> Column:
    return F.when(left.isNull(), "right_only").when(right.isNull(), "left_only").when(left == right, "match").otherwise("mismatch")


def compare_streams(left: DataFrame, right: DataFrame, left_time: str, right_time: str, late: str = "1 day") -> DataFrame:
    """(dt, left_count, right_count, diff, status) of the days of two streams, each day once: when no row of it can come any more on either side. A row that comes later than `late` behind its side's last one is not counted;
    rows without a time have no day. The state holds the days that are still open, a row each; as with all streams, a side that stands still holds up the days of both."""
    sides = _counted(left, left_time, late, "left"), _counted(right, right_time, late, "right")
    both = sides[0].join(sides[1], "day", "full_outer")
    a, b = F.col("left_count"), F.col("right_count")
    return both.select(F.date_format("day.start", "yyyy-MM-dd").alias("dt"), a, b, (b - a).alias("diff"), _judged(a, b).alias("status"))


def keep_comparison(compared: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what is there of a comparison to a folder of Parquet files; begun again with the same checkpoint, it goes on where it ended. Each day is written once."""
    return compared.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
