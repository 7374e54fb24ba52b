"""Observed edges as a stream: windowed sample counts, duplicates within the watermark, staleness, incremental sinks.

Beyond batch semantics: every operator takes a streaming or batch frame of ``from_id, to_id, env, at``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

KEY = ["from_id", "to_id", "env"]


def _watermarked(observed: DataFrame, late: str | None) -> DataFrame:
    """With a watermark, unless the frame has one already (``late`` is None)."""
    return observed.withWatermark("at", late) if late else observed


def windowed_counts(observed: DataFrame, size: str = "1 hour", slide: str | None = None, late: str | None = "2 hours") -> DataFrame:
    """Samples per edge and tumbling or sliding window; rows later than ``late`` are left out."""
    w = F.window("at", size, slide) if slide else F.window("at", size)
    counted = _watermarked(observed, late).groupBy(w.alias("w"), *KEY).agg(F.count(F.lit(1)).alias("sample_count"))
    return counted.select(*KEY, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "sample_count")


def session_counts(observed: DataFrame, gap: str = "30 minutes", late: str | None = "2 hours") -> DataFrame:
    counted = _watermarked(observed, late).groupBy(F.session_window("at", gap).alias("w"), *KEY).agg(F.count(F.lit(1)).alias("sample_count"))
    return counted.select(*KEY, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "sample_count")


def once(observed: DataFrame, late: str = "2 hours") -> DataFrame:
    """Repeated deliveries of an event (``event_id``) once, as far as the watermark reaches."""
    return observed.withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])


def last_seen(observed: DataFrame) -> DataFrame:
    return observed.groupBy(*KEY).agg(F.max("at").alias("last_seen"), F.count(F.lit(1)).alias("sample_count"))


def stale(seen: DataFrame, now: str, after: str = "24 hours") -> DataFrame:
    """Marks edges not seen for ``after`` before ``now``, which is given, not read from a clock."""
    limit = F.to_timestamp(F.lit(now)) - F.expr(f"INTERVAL {after}")
    return seen.withColumn("stale", F.col("last_seen") < limit)


def into(stream: DataFrame, write: Callable[[DataFrame], None], checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Runs a stream to its present end and hands each batch to a sink such as GraphStore.write_runtime."""
    return stream.writeStream.outputMode(mode).foreachBatch(lambda batch, _: write(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
