"""Row audit, circuit breaker and job roll-ups (H2-H9).

The audit is one aggregation over both sides (a union of marker rows);
the breaker is a ``when`` chain over that one-row result, so
a guard never pulls data to the driver beyond a single row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubjay.functions.flags import FLAG, flagged_count

# Fixed values from the reference: flagged-share limit (strict >) and per-task row-loss limits.
MAX_FLAGGED_RATE = 0.20
MAX_ROW_REDUCTION = {
    "deduplication": 0.30,
    "entity_resolution": 0.10,
    "format_standardization": 0.02,
    "missing_value_imputation": 0.01,
    "type_coercion": 0.05,
}
DEFAULT_MAX_ROW_REDUCTION = 0.30
MIN_CONFIDENCE = {
    "deduplication": 0.75,
    "entity_resolution": 0.80,
    "format_standardization": 0.70,
    "missing_value_imputation": 0.65,
    "type_coercion": 0.75,
}
DEFAULT_MIN_CONFIDENCE = 0.70


def delta_rate(before: Column, after: Column) -> Column:
    """(after - before) / max(before, 1)  (H3)."""
    return (after - before) / F.greatest(before, F.lit(1))


def audit(before: DataFrame, after: DataFrame) -> DataFrame:
    """One-row audit: ``rows_before, rows_after, row_delta_rate, flagged_record_count`` (H2, H3).

    Both sides are reduced to marker rows and counted in one aggregation over
    their union: each side is scanned once and nothing is joined.
    """
    fl = (F.coalesce(F.col(FLAG).cast("boolean"), F.lit(False)) if FLAG in after.columns else F.lit(False))
    b = before.select(F.lit(True).alias("__before"), F.lit(False).alias("__fl"))
    a = after.select(F.lit(False).alias("__before"), fl.alias("__fl"))
    u = b.unionByName(a).agg(F.count_if(F.col("__before")).alias("rows_before"),
                             F.count_if(~F.col("__before")).alias("rows_after"),
                             F.count_if(F.col("__fl")).alias("flagged_record_count"))
    return u.select("rows_before", "rows_after",
                    delta_rate(F.col("rows_before"), F.col("rows_after")).alias("row_delta_rate"),
                    "flagged_record_count")


def breaker_exprs(rows_before: Column, delta: Column, flagged: Column,
                  max_row_reduction: float = DEFAULT_MAX_ROW_REDUCTION,
                  max_flagged_rate: float = MAX_FLAGGED_RATE) -> tuple[Column, Column]:
    """(triggered, reason) of the circuit breaker (H4).

    Row-loss test first (strict ``<`` on the signed delta), then the flagged
    share, only when there were rows before.
    """
    loss = delta < -max_row_reduction
    frate = flagged / rows_before
    too_flagged = (rows_before > 0) & (frate > max_flagged_rate)
    reason = (F.when(loss, F.format_string(
        "Row reduction %.1f%% exceeds circuit-breaker threshold %.1f%%", F.abs(delta) * 100,
        F.lit(max_row_reduction * 100)))
        .when(too_flagged, F.format_string(
            "Flagged-record rate %.1f%% > %s %% - human review required", frate * 100,
            F.lit(f"{max_flagged_rate * 100:g}")))
        .otherwise(F.lit("")))
    return (loss | too_flagged), reason


def circuit_breaker(audit_df: DataFrame, max_row_reduction: float = DEFAULT_MAX_ROW_REDUCTION,
                    max_flagged_rate: float = MAX_FLAGGED_RATE) -> DataFrame:
    """Audit rows plus ``circuit_breaker_hit`` and ``breaker_reason`` (H4)."""
    hit, reason = breaker_exprs(F.col("rows_before"), F.col("row_delta_rate"), F.col("flagged_record_count"),
                                max_row_reduction, max_flagged_rate)
    return audit_df.withColumn("circuit_breaker_hit", hit).withColumn("breaker_reason", reason)


def grouped_breaker(before: DataFrame, after: DataFrame, key: str,
                    max_row_reduction: float = DEFAULT_MAX_ROW_REDUCTION,
                    max_flagged_rate: float = MAX_FLAGGED_RATE) -> DataFrame:
    """Circuit breaker per group (H5): a group that vanished has after = 0.

    Two grouped counts (map-side combined) and a full outer join of group
    summaries, so the join sees one row per group on each side.
    """
    b = before.groupBy(F.col(key).alias("__k")).agg(F.count(F.lit(1)).alias("rows_before"))
    a = after.groupBy(F.col(key).alias("__k")).agg(F.count(F.lit(1)).alias("rows_after"),
                                                   flagged_count(after).alias("flagged_record_count"))
    j = b.join(a, b["__k"].eqNullSafe(a["__k"]), "full_outer").select(
        F.coalesce(b["__k"], a["__k"]).alias(key),
        F.coalesce(F.col("rows_before"), F.lit(0)).alias("rows_before"),
        F.coalesce(F.col("rows_after"), F.lit(0)).alias("rows_after"),
        F.coalesce(F.col("flagged_record_count"), F.lit(0)).cast("bigint").alias("flagged_record_count"))
    j = j.withColumn("row_delta_rate", delta_rate(F.col("rows_before"), F.col("rows_after")))
    return circuit_breaker(j, max_row_reduction, max_flagged_rate)


def job_outcomes(attempts: DataFrame, max_retries: int = 3) -> DataFrame:
    """Roll an attempts log up to one outcome per job (H7).

    Attempts are replayed in ``attempt`` order with the reference's routing:
    a passing attempt (success and no breaker) completes the job; a breaker
    hit escalates to human review; otherwise the retry counter grows and the
    job escalates once it reaches ``max_retries``. Attempts after the
    stopping one are ignored. A job that has not stopped is still in
    ``engineering``.

    Output ``job_id, attempts, retry_count, status, rows_before, rows_after,
    flagged_record_count``. Computed with ``min_by``/``max_by`` aggregates,
    so a job with millions of attempts is still combined map-side.
    """
    passed = F.col("success") & ~F.col("circuit_breaker_hit")
    stop = passed | F.col("circuit_breaker_hit") | (F.col("attempt") >= F.lit(max_retries))
    rec = F.struct("attempt", passed.alias("passed"), "circuit_breaker_hit", "rows_before", "rows_after",
                   "flagged_record_count")
    g = attempts.groupBy("job_id").agg(
        F.min_by(rec, F.when(stop, F.col("attempt"))).alias("s"),
        F.max_by(rec, F.col("attempt")).alias("last"),
        F.count(F.lit(1)).alias("n"))
    r = F.coalesce(F.col("s"), F.col("last"))
    stopped = F.col("s").isNotNull()
    status = (F.when(~stopped, F.lit("engineering"))
              .when(F.col("s.passed"), F.lit("complete"))
              .otherwise(F.lit("human_review")))
    used = F.when(stopped, F.col("s.attempt")).otherwise(F.col("n"))
    retry = F.when(stopped & F.col("s.passed"), F.col("s.attempt") - 1).otherwise(used)
    return g.select(
        "job_id", used.cast("bigint").alias("attempts"), retry.cast("bigint").alias("retry_count"),
        status.alias("status"), r["rows_before"].alias("rows_before"), r["rows_after"].alias("rows_after"),
        r["flagged_record_count"].alias("flagged_record_count"))


def attempt_log(attempts: DataFrame) -> DataFrame:
    """Audit-log view of an attempts table: one ``qa_node`` entry per attempt (H8 input)."""
    passed = F.col("success") & ~F.col("circuit_breaker_hit")
    status = (F.when(passed, F.lit("pass")).when(F.col("circuit_breaker_hit"), F.lit("circuit_break"))
              .otherwise(F.lit("fail")))
    return attempts.select(F.col("job_id"), F.lit("qa_node").alias("node"), status.alias("status"), "attempt")


def audit_summary(log: DataFrame) -> DataFrame:
    """Audit-log summary by node and status (H8)."""
    return log.groupBy("node", "status").agg(F.count(F.lit(1)).alias("entries"),
                                             F.countDistinct("job_id").alias("jobs"))


def confidence_gate(df: DataFrame, confidence_col: str, min_confidence: float = DEFAULT_MIN_CONFIDENCE,
                    reason: str | None = None) -> DataFrame:
    """Flag rows whose confidence is below ``min_confidence`` (H9)."""
    from scrubjay.functions.flags import add_flag
    return add_flag(df, F.col(confidence_col) < min_confidence, reason or f"low_confidence:{confidence_col}")


def has_flags(df: DataFrame) -> bool:
    return FLAG in df.columns
