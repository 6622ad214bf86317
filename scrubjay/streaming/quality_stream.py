"""Structured Streaming forms of the cleaning operators.

* :func:`dedup_stream` - exact de-duplication inside a watermark
  (``dropDuplicatesWithinWatermark``), state bounded by the watermark.
* :func:`windowed_quality` - per event-time window row count, NULL counts and
  flagged count; state is one row per open window.
* :func:`guarded_batches` - ``foreachBatch`` sink that cleans each micro-batch,
  audits it, and routes it to the clean table or, when the circuit breaker
  trips, to a quarantine table; audit rows are appended either way.

Sinks write to folders the caller names (shared storage on a cluster); the
stream checkpoint lives under the session's checkpoint directory.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubjay.functions.flags import FLAG, flagged_count
from scrubjay.operators import guard as G
from scrubjay.session import ensure_checkpoint_dir


def stream_checkpoint(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"


def _session_tz(df: DataFrame) -> str:
    return df.sparkSession.conf.get("spark.sql.session.timeZone")


def _event_time(stream: DataFrame, ts_col: str) -> DataFrame:
    """Watermarks need TIMESTAMP; local date-times (TIMESTAMP_NTZ) are read as
    UTC instants in ``__event_time``, whatever the session time zone."""
    tz = _session_tz(stream)
    et = F.convert_timezone(F.lit("UTC"), F.lit(tz), F.col(ts_col).cast("timestamp_ntz")).cast("timestamp")
    return stream.withColumn("__event_time", et)


def _utc_wall_clock(instant, tz: str):
    """An instant rendered as a UTC local date-time (TIMESTAMP_NTZ)."""
    return F.convert_timezone(F.lit(tz), F.lit("UTC"), instant.cast("timestamp_ntz"))


def dedup_stream(stream: DataFrame, keys: list[str], ts_col: str, watermark: str = "1 hour") -> DataFrame:
    """Drop rows whose key was already seen within the watermark delay."""
    s = _event_time(stream, ts_col).withWatermark("__event_time", watermark)
    return s.dropDuplicatesWithinWatermark(keys).drop("__event_time")


def windowed_quality(stream: DataFrame, ts_col: str, columns: list[str], window: str = "1 day",
                     watermark: str = "1 day") -> DataFrame:
    """Rows, NULL counts per column and flagged rows per event-time window."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    aggs += [F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in columns]
    aggs.append(flagged_count(stream).alias("flagged"))
    tz = _session_tz(stream)
    return (_event_time(stream, ts_col).withWatermark("__event_time", watermark)
            .groupBy(F.window("__event_time", window).alias("w")).agg(*aggs)
            .select(_utc_wall_clock(F.col("w.start"), tz).alias("window_start"),
                    _utc_wall_clock(F.col("w.end"), tz).alias("window_end"), *[
                c for c in ["rows"] + [f"nulls_{c}" for c in columns] + ["flagged"]]))


def guarded_batches(clean_fn: Callable[[DataFrame], DataFrame], clean_path: str, quarantine_path: str,
                    audit_path: str, max_row_reduction: float = G.DEFAULT_MAX_ROW_REDUCTION):
    """A ``foreachBatch`` function: clean, audit and route every micro-batch.

    The batch is persisted so the audit and the write read it once; the
    audit is one row per batch. Each batch overwrites its own folder
    ``batch=<id>`` below the three paths, so a replayed batch replaces what it
    wrote; readers of the paths get ``batch`` as a partition column.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        out = clean_fn(batch).persist()
        own = f"batch={batch_id}"
        try:
            audit = G.circuit_breaker(G.audit(batch, out), max_row_reduction).withColumn(
                "batch_id", F.lit(batch_id).cast("long"))
            row = audit.first()
            if row["circuit_breaker_hit"]:
                batch.write.mode("overwrite").parquet(f"{quarantine_path}/{own}")
            else:
                out.write.mode("overwrite").parquet(f"{clean_path}/{own}")
            audit.write.mode("overwrite").parquet(f"{audit_path}/{own}")
        finally:
            out.unpersist()
            batch.unpersist()
    return run


def run_available(stream_writer, timeout_s: int = 600) -> None:
    """Run a stream over everything available now, then stop (tests, back-fills).

    A failed stream raises its error; one that is not done in time is stopped and raises.
    """
    q = stream_writer.trigger(availableNow=True).start()
    if not q.awaitTermination(timeout_s):
        q.stop()
        raise TimeoutError(f"stream not done after {timeout_s} s; its sink holds a part only")


def has_flag(df: DataFrame) -> bool:
    return FLAG in df.columns
