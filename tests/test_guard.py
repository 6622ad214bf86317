"""Circuit-breaker cases of the reference's unit tests, as DataFrame rows."""
import pytest
from pyspark.sql import functions as F

from scrubjay.operators import guard as G

# (before, after, delta, flagged, limit) -> tripped
CASES = [
    (10000, 9800, -0.05, 0, 0.30, False),
    (10000, 5000, -0.50, 0, 0.30, True),
    (10000, 7001, -0.2999, 0, 0.30, False),
    (10000, 6999, -0.3001, 0, 0.30, True),
    (10000, 10000, 0.0, 2500, 0.30, True),
    (10000, 10000, 0.0, 1999, 0.30, False),
    (1000, 900, -0.10, 0, 0.05, True),
    (1000, 900, -0.10, 0, 0.20, False),
]


@pytest.mark.parametrize("before,after,delta,flagged,limit,tripped", CASES)
def test_breaker_cases(spark, before, after, delta, flagged, limit, tripped):
    df = spark.createDataFrame([(before, after, delta, flagged)],
                               "rows_before long, rows_after long, row_delta_rate double, flagged_record_count long")
    r = G.circuit_breaker(df, max_row_reduction=limit).first()
    assert r["circuit_breaker_hit"] is tripped
    if tripped:
        assert r["breaker_reason"]


def test_audit_counts_and_delta(spark):
    before = spark.range(100)
    after = spark.range(40).withColumn("__flagged__", F.col("id") < 5)
    r = G.circuit_breaker(G.audit(before, after), 0.30).first()
    assert (r["rows_before"], r["rows_after"], r["flagged_record_count"]) == (100, 40, 5)
    assert r["row_delta_rate"] == pytest.approx(-0.6)
    assert r["circuit_breaker_hit"] and r["breaker_reason"].startswith("Row reduction 60.0%")


def test_audit_zero_before(spark):
    empty = spark.range(0)
    r = G.circuit_breaker(G.audit(empty, empty)).first()
    assert r["row_delta_rate"] == 0.0 and r["circuit_breaker_hit"] is False


def test_job_outcomes_routing(spark):
    rows = [
        # job 1: fail, then pass -> complete, one retry
        (1, 1, False, False), (1, 2, True, False),
        # job 2: breaker on first attempt -> human review
        (2, 1, True, True), (2, 2, True, False),
        # job 3: three failures with max_retries 3 -> human review after attempt 3
        (3, 1, False, False), (3, 2, False, False), (3, 3, False, False), (3, 4, True, False),
        # job 4: one failure, still retrying
        (4, 1, False, False),
    ]
    df = spark.createDataFrame(rows, "job_id int, attempt int, success boolean, circuit_breaker_hit boolean")
    df = df.withColumn("rows_before", F.lit(10)).withColumn("rows_after", F.lit(9)).withColumn(
        "flagged_record_count", F.lit(0))
    out = {r["job_id"]: r for r in G.job_outcomes(df, max_retries=3).collect()}
    assert (out[1]["status"], out[1]["retry_count"], out[1]["attempts"]) == ("complete", 1, 2)
    assert (out[2]["status"], out[2]["attempts"]) == ("human_review", 1)
    assert (out[3]["status"], out[3]["retry_count"], out[3]["attempts"]) == ("human_review", 3, 3)
    assert (out[4]["status"], out[4]["retry_count"]) == ("engineering", 1)
