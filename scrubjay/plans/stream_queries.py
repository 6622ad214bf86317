"""Registered queries for the streaming forms (bounded replay of the events table).

The events table is replayed as a file stream (a copy of the dirty input is
written once to a scratch folder under the checkpoint directory), processed
with ``availableNow``, written to a parquet sink, and read back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from scrubjay.operators import dedup as D
from scrubjay.plans.catalog import register
from scrubjay.plans.tables import load
from scrubjay.session import ensure_checkpoint_dir
from scrubjay.streaming import quality_stream as QS


def _scratch(spark, name):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/scrubjay-stream/{uuid.uuid4().hex}/{name}"


def _events_dup(spark, sf):
    ev = load(spark, sf, "events")
    return ev.unionByName(ev.filter(F.col("event_id") % 10 == 0))


def _as_stream(spark, df, name, files_per_trigger=None):
    """File stream over a copy of ``df``. The copy is unordered in event time,
    so the watermarked queries read it in one trigger (a replay of history is
    not late data); the complete-mode aggregate takes several triggers."""
    src = _scratch(spark, name)
    df.repartition(8).write.parquet(src)
    r = spark.readStream.schema(df.schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(src)


@register("s1_stream_dedup",
          "SELECT DISTINCT event_id, ts, user_id, event_type, value, props FROM (SELECT * FROM events UNION ALL "
          "SELECT * FROM events WHERE event_id % 10 = 0)")
def s1_stream_dedup(spark, sf):
    stream = _as_stream(spark, _events_dup(spark, sf), "events_dup")
    out = _scratch(spark, "dedup_out")
    w = (QS.dedup_stream(stream, ["event_id"], "ts", "1 hour").writeStream.format("parquet")
         .option("path", out).option("checkpointLocation", QS.stream_checkpoint(spark, "s1")).outputMode("append"))
    QS.run_available(w)
    return spark.read.parquet(out)


@register("s2_windowed_quality",
          "SELECT date_trunc('day', ts) AS window_start, count(*) AS rows, count_if(value IS NULL) AS nulls_value, "
          "count_if(props IS NULL) AS nulls_props, CAST(0 AS BIGINT) AS flagged FROM events GROUP BY 1")
def s2_windowed_quality(spark, sf):
    stream = _as_stream(spark, load(spark, sf, "events"), "events", files_per_trigger=2)
    out = _scratch(spark, "quality_out")

    def write(batch, _bid):  # complete mode: each batch holds every window so far
        batch.write.mode("overwrite").parquet(out)
    agg = QS.windowed_quality(stream, "ts", ["value", "props"], "1 day", "1 day")
    w = (agg.writeStream.outputMode("complete").foreachBatch(write)
         .option("checkpointLocation", QS.stream_checkpoint(spark, "s2")))
    QS.run_available(w)
    return spark.read.parquet(out).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "rows",
                                          "nulls_value", "nulls_props", "flagged")


@register("s3_guarded_batches",
          "SELECT count(*) AS rows_before FROM (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 10 = 0)")
def s3_guarded_batches(spark, sf):
    stream = _as_stream(spark, _events_dup(spark, sf), "events_dup")
    clean, quarantine, audit = _scratch(spark, "clean"), _scratch(spark, "quarantine"), _scratch(spark, "audit")
    fn = QS.guarded_batches(lambda b: D.dedup_exact(b, ["event_id"], order_by=["ts"]), clean, quarantine, audit,
                            max_row_reduction=0.30)
    w = stream.writeStream.foreachBatch(fn).option("checkpointLocation", QS.stream_checkpoint(spark, "s3"))
    QS.run_available(w)
    return spark.read.parquet(audit).agg(F.sum("rows_before").cast("bigint").alias("rows_before"))
