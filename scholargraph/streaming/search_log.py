"""The search log as a stream: counts by event-time windows, and an append sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scholargraph.sources.stores import search_log_rows


def windowed_counts(log: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, end, query_type, n, results) per tumbling window; rows later than ``late`` are left out of a stream."""
    timed = log.withColumn("created_at", F.col("created_at").cast("timestamp"))
    grouped = timed.withWatermark("created_at", late).groupBy(F.window("created_at", window).alias("w"), "query_type")
    return grouped.agg(F.count("*").alias("n"), F.sum("results_count").alias("results")).select("w.start", "w.end", "query_type", "n", "results")


def append_stream(log: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    """Appends a stream of searches to the log table, a folder per day; exactly once by its checkpoint."""
    rows = search_log_rows(log)
    writer = rows.writeStream.format("parquet").partitionBy("event_date").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return writer.trigger(**(options or {"availableNow": True})).start()
