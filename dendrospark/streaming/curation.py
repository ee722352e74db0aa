"""Streaming counterparts of append-only logs; the reference has no streaming of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def status_counts(log: DataFrame, time: str = "ts", status: str = "status", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts per window and status of a streaming (or static) download log."""
    rows = log.withWatermark(time, late) if log.isStreaming else log
    return rows.groupBy(F.window(time, width), status).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), status, "n")


def once(log: DataFrame, key: str, time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """The log with one row per key; for streams within the watermark, so state stays bounded."""
    return log.withWatermark(time, late).dropDuplicatesWithinWatermark([key]) if log.isStreaming else log.dropDuplicates([key])
