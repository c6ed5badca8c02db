"""The query log: appended rows, and its windows as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "log_id long, query_text string, mode string, corpus string, latency_ms int, result_count int, created_at timestamp"


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def read_log_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(LOG).parquet(path)


def traffic(log: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Searches and latency by window and mode; rows later than the watermark are left out in a stream."""
    return log.withWatermark("created_at", late).groupBy(F.window("created_at", window), "mode").agg(F.count("*").alias("searches"), F.avg("latency_ms").alias("latency_ms"))


def once(log: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The log with each log_id once: a stream remembers ids as long as their rows may still come, a table has all of them."""
    marked = log.withWatermark("created_at", late)
    return marked.dropDuplicatesWithinWatermark(["log_id"]) if log.isStreaming else marked.dropDuplicates(["log_id"])


def sessions(log: DataFrame, late: str = "10 minutes", gap: str = "30 minutes", by: tuple[str, ...] = ("mode",)) -> DataFrame:
    """Searches and results by session: rows of one group (columns `by`) at most `gap` apart, each log_id once. A stream gives a session
    when no more of its rows can come, with the same values as the table of all rows."""
    return once(log, late).groupBy(F.session_window("created_at", gap), *by).agg(F.count("*").alias("searches"), F.sum("result_count").alias("results"), F.max("latency_ms").alias("slowest_ms"))
