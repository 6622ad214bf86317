"""Profiling and exact de-duplication edge cases."""
import pytest
from pyspark.sql import functions as F

from scrubjay.operators import dedup as D
from scrubjay.operators import profile as P


def test_null_counts_as_a_value(spark):
    df = spark.createDataFrame([(1,), (None,), (1,)], "x int")
    r = P.distinct_counts(df).first()
    assert r["n_unique"] == 2


def test_profile_empty_table(spark):
    df = spark.createDataFrame([], "a int, b string")
    rows = {r["name"]: r for r in P.profile_columns(df, order_by=["a"]).collect()}
    assert rows["a"]["null_rate"] == 0.0 and rows["a"]["unique_rate"] == 0.0
    rep = P.quality_report(df, order_by=["a"]).first()
    assert rep["total_rows"] == 0 and rep["duplicate_row_rate"] == 0.0 and rep["overall_quality_score"] == 1.0


def test_profile_all_null_column_and_issues(spark):
    rows = [(i, None, "x" if i % 2 else "\u00a0x") for i in range(300)]
    df = spark.createDataFrame(rows, "id int, n string, s string")
    prof = {r["name"]: r for r in P.profile_columns(df, order_by=["id"]).collect()}
    assert prof["n"]["null_rate"] == 1.0
    assert "high_null_rate:100.0%" in prof["n"]["detected_issues"]
    # unicode white space (NBSP) counts, as Python's str.strip() does
    assert "leading_trailing_whitespace" in prof["s"]["detected_issues"]
    assert "low_cardinality" in prof["s"]["detected_issues"]
    assert prof["n"]["sample_values"] == []
    assert prof["id"]["sample_values"] == [str(i) for i in range(10)]


def test_duplicate_rate_with_map_column(spark):
    df = spark.createDataFrame([({"a": 1},), ({"a": 1},), ({"b": 2},)], "m map<string,int>")
    r = P.duplicate_rate(df).first()
    assert r["distinct_rows"] == 2


def test_quality_score_formula(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a"), (3, "b")], "a int, b string")
    rep = P.quality_report(df, order_by=["a"]).first()
    # mean null rate 0.25, dup rate 0.25 -> 1 - 0.25 - 0.125
    assert rep["overall_quality_score"] == pytest.approx(0.625)


def test_dedup_null_keys_group_together_and_survivor(spark):
    df = spark.createDataFrame([(None, 3, "c"), (None, 1, "a"), (1, 2, "b"), (1, 5, "e")], "k int, o int, v string")
    out = {(r["k"], r["o"], r["v"]) for r in D.dedup_exact(df, ["k"], order_by=["o"]).collect()}
    assert out == {(None, 1, "a"), (1, 2, "b")}
    last = {(r["k"], r["o"]) for r in D.dedup_exact(df, ["k"], order_by=["o"], keep="last").collect()}
    assert last == {(None, 3), (1, 5)}


def test_infer_key_fields(spark):
    df = spark.createDataFrame([(1, "a", 1.5), (2, "a", 2.5), (3, "b", 3.5)], "id int, g string, x double")
    prof = P.profile_columns(df, order_by=["id"])
    assert D.infer_key_fields(prof) == ["g"]


def test_dedup_plan_has_no_window(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    plan = D.dedup_exact(df, ["k"], order_by=["v"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "HashAggregate" in plan or "ObjectHashAggregate" in plan or "SortAggregate" in plan


def test_distinct_counts_take_equal_values_as_one(spark):
    df = spark.sql("SELECT * FROM VALUES (0.0D, map('a', 1, 'b', 2)), (-0.0D, map('b', 2, 'a', 1)), "
                   "(double('NaN'), map('a', 2)), (double('NaN'), NULL), (NULL, NULL) AS t(x, m)")
    assert {r["ordinal"]: r["n_unique"] for r in P.distinct_counts(df).collect()} == {0: 3, 1: 3}
