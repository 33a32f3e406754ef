"""Increments of row counts as they arrive: files in a folder are upserted into the store; events are counted by day with late data allowed for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerline.operators.rowcount import summed
from ledgerline.sources.store import Store


def load_increments(spark: SparkSession, folder: str, source_table: str, store: Store, checkpoint: str) -> StreamingQuery:
    """Upsert each new `dt,row_count` CSV file of a folder under source_table; ends when all files are read. A batch that is run again changes nothing."""
    files = spark.readStream.schema("dt string, row_count string").option("header", True).csv(folder)

    def put(batch: DataFrame, _: int) -> None:
        store.upsert("row_counts", summed(batch, "dt", "row_count").withColumn("source_table", F.lit(source_table)))

    return files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_counts(events: DataFrame, time: str, late: str = "2 days") -> DataFrame:
    """(dt, row_count) per day of a stream (or a table) of events; days close when the watermark has passed them."""
    rows = events.withColumn("__t", F.col(time).cast("timestamp"))
    rows = rows.withWatermark("__t", late) if events.isStreaming else rows
    days = rows.groupBy(F.window("__t", "1 day").alias("w")).agg(F.count("*").alias("row_count"))
    return days.select(F.date_format("w.start", "yyyy-MM-dd").alias("dt"), "row_count")
