"""Streams over append-only logs: audit counts, idempotent ingest, open-state upkeep.

Everything is Structured Streaming with event-time watermarks, so state is bounded by
the watermark and a restart resumes from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def audit_per_minute(events: DataFrame, at: str = "ts", kind: str = "event_type", late: str = "10 minutes") -> DataFrame:
    """Count per minute and kind; rows later than the watermark are dropped by the engine."""
    return events.withWatermark(at, late).groupBy(F.window(at, "1 minute"), kind).agg(F.count("*").alias("n")).select(
        F.col("window.start").alias("minute"), kind, "n"
    )


def sessions(events: DataFrame, key: str, at: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Activity sessions per key."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n")).select(
        key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n"
    )


def idempotent(statements: DataFrame, hash_col: str = "content_hash", at: str = "received_at", late: str = "1 day") -> DataFrame:
    """Each content hash once within the watermark, however often it is delivered."""
    return statements.withWatermark(at, late).dropDuplicatesWithinWatermark([hash_col])


def start_upserts(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a stream that hands each batch to ``write`` (exactly once if the write is keyed by batch id)."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
