"""Structured Streaming over inference events: an extension beyond the batch operators.

Late events are bounded by watermarks; state that a watermark has passed is dropped by Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def without_replays(events: DataFrame, ts: str = "ts", nonce: str = "nonce", late: str = "1 hour") -> DataFrame:
    """First event of each nonce within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([nonce])


def rate_by_window(events: DataFrame, ts: str = "ts", by: str = "event_type", width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and value moments of tumbling windows."""
    w = events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), by)
    return w.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd")).select(F.col("w.start").alias("start"), by, "n", "mean", "sd")


def sessions(events: DataFrame, ts: str = "ts", by: str = "user_id", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    w = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), by)
    return w.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def run_once(df: DataFrame, name: str, checkpoint: str, mode: str = "append"):
    """Processes what is there into an in-memory table and stops; for tests and backfills."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
