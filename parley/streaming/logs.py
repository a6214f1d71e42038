"""Structured Streaming sinks of the logs, and labelled extensions with event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import analytics


def read(spark: SparkSession, path: str, schema, files: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def append(rows: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append-only sink, partitioned by day so that retention drops partitions; exactly once through the checkpoint."""
    dated = rows.withColumn("day", F.to_date("ts"))
    writer = dated.writeStream.outputMode("append").format("parquet").partitionBy("day").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()


def kept(events: DataFrame) -> DataFrame:
    """Events of visitors who haven't opted out, where the events tell (dnt, gpc)."""
    asked = [F.col(c) if c in events.columns else F.lit(None).cast("string") for c in ("dnt", "gpc")]
    return events.where(~analytics.opted_out(*asked))


def search_log(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return append(analytics.search_log(kept(events)), path, checkpoint)


def pageviews(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return append(analytics.pageviews(kept(events)), path, checkpoint)


def per_day(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """(day, n) with a watermark, so the state of past days is dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counted = timed.groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").cast(events.schema["ts"].dataType).alias("day"), "n")


def daily_uniques(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """Extension: approximate visitors per day with a watermark, so state of past days is dropped."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", "1 day")).agg(F.approx_count_distinct("visitor").alias("visitors"))


def sessions(log: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Extension: a visitor's sessions."""
    return log.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "visitor").agg(F.count("*").alias("n"))
