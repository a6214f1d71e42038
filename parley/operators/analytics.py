"""Search and page logs: cleaning, retention, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAYS = 180


def search_log(events: DataFrame) -> DataFrame:
    """events (ts, query, query_norm, hits, strong, had_movie, took_ms, visitor) as log rows: no blank queries, texts of 200 characters, counts of 16 bits."""
    short = lambda c: F.least(F.col(c), F.lit(65535)).cast("int")
    return events.where(F.trim("query_norm") != "").select(
        "ts", F.substring("query", 1, 200).alias("query"), F.substring("query_norm", 1, 200).alias("query_norm"), short("hits").alias("hits"), short("strong").alias("strong"),
        F.col("had_movie").cast("int").alias("had_movie"), F.least(F.floor(F.col("took_ms") + 0.5), F.lit(65535)).cast("int").alias("took_ms"), "visitor",
    )


def opted_out(dnt: Column, gpc: Column) -> Column:
    return F.coalesce(dnt == "1", F.lit(False)) | F.coalesce(gpc == "1", F.lit(False))


def is_pageview(method: Column, status: Column, path: Column, kind: Column, purpose: Column) -> Column:
    ok = (method == "GET") & status.between(200, 299) & ~path.startswith("/api") & kind.startswith("text/html")
    return ok & ~F.coalesce(purpose.contains("prefetch"), F.lit(False))


def pageviews(events: DataFrame) -> DataFrame:
    return events.select("ts", F.substring("path", 1, 200).alias("path"), F.substring("referrer", 1, 200).alias("referrer"), "visitor")


def retained(log: DataFrame, now: Column, days: int = DAYS) -> DataFrame:
    return log.where(F.col("ts") >= now - F.make_dt_interval(F.lit(days)))


def missed_queries(log: DataFrame) -> DataFrame:
    """Queries that found nothing, most missed first."""
    return log.where("hits = 0").groupBy("query_norm").agg(F.count("*").alias("misses")).orderBy(F.desc("misses"), "query_norm")


def daily_visitors(log: DataFrame) -> DataFrame:
    """Distinct visitors per UTC day (an extension)."""
    return log.groupBy(F.to_date("ts").alias("day")).agg(F.count_distinct("visitor").alias("visitors"))


def bar_heights(counts: DataFrame, value: str = "n", least: float = 3.0) -> DataFrame:
    """Chart heights in per cent of the largest, at least `least`."""
    top = counts.agg(F.max(value).alias("__top"))
    return counts.join(F.broadcast(top)).withColumn("height", F.greatest(F.col(value) / F.greatest(F.col("__top"), F.lit(1)) * 100, F.lit(least))).drop("__top")  # one row
