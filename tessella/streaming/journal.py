"""The append-only journals as streams: daily counts, receipts without repeats, the page ledger, live status."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_time(events: DataFrame, column: str = "ts") -> DataFrame:
    """Event time as a timestamp with zone: watermarks don't take the kind without."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def daily_counts(events: DataFrame, kind: str, time: str = "ts", late: str = "2 days") -> DataFrame:
    """``day``, kind, ``n``: events by day; those later than the watermark are dropped, as a closed day's log stays closed."""
    days = with_time(events, time).withWatermark(time, late).groupBy(F.window(time, "1 day"), kind).agg(F.count("*").alias("n"))
    return days.select(F.to_date("window.start").alias("day"), kind, "n")


def first_receipts(events: DataFrame, key: str, time: str = "ts", late: str = "2 days") -> DataFrame:
    """Each receipt once, however often it is delivered within the watermark."""
    return with_time(events, time).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def sessions(events: DataFrame, key: str, time: str = "ts", gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """``key``, ``started``, ``ended``, ``n``: runs of events with no longer pause than the gap."""
    rows = with_time(events, time).withWatermark(time, late).groupBy(key, F.session_window(time, gap)).agg(F.count("*").alias("n"))
    return rows.select(key, F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "n")


def to_ledger(path: str, key: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer that appends rows whose key the ledger doesn't have; a batch run again adds nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
        new = batch.dropDuplicates([key])
        if there:
            new = new.join(spark.read.schema(batch.schema).parquet(path).select(key), key, "left_anti").select(*batch.columns)
        new.write.mode("append").parquet(path)

    return write
