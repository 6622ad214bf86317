"""Streaming forms on a bounded file stream."""
import os
import uuid

from pyspark.sql import functions as F

from scrubjay.session import ensure_checkpoint_dir
from scrubjay.streaming import quality_stream as QS


def _scratch(spark, name):
    return os.path.join(ensure_checkpoint_dir(spark).replace("file:", ""), "test-stream", uuid.uuid4().hex, name)


def test_guard_routes_tripped_batch_to_quarantine(spark):
    src = _scratch(spark, "src")
    df = spark.range(100).select(F.col("id"), (F.col("id") % 3).alias("k"),
                                 F.timestamp_seconds(F.col("id") + 1_700_000_000).cast("timestamp_ntz").alias("ts"))
    df.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    clean, quarantine, audit = _scratch(spark, "c"), _scratch(spark, "q"), _scratch(spark, "a")
    # keeping one row per k drops 97 of 100 rows: the 30 % row-loss guard must trip
    fn = QS.guarded_batches(lambda b: b.dropDuplicates(["k"]), clean, quarantine, audit, max_row_reduction=0.30)
    QS.run_available(stream.writeStream.foreachBatch(fn).option("checkpointLocation", _scratch(spark, "ck")))
    a = spark.read.parquet(audit).first()
    assert a["circuit_breaker_hit"] and (a["rows_before"], a["rows_after"]) == (100, 3)
    assert spark.read.parquet(quarantine).count() == 100
    assert not os.path.exists(clean)


def test_stream_dedup_matches_batch(spark):
    src = _scratch(spark, "src")
    base = spark.range(50).select(F.col("id"), F.timestamp_seconds(F.col("id") * 60 + 1_700_000_000).cast("timestamp_ntz").alias("ts"))
    base.unionByName(base.filter(F.col("id") % 5 == 0)).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(base.schema).parquet(src)
    out = _scratch(spark, "out")
    w = (QS.dedup_stream(stream, ["id"], "ts", "1 hour").writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", _scratch(spark, "ck")))
    QS.run_available(w)
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == list(range(50))
