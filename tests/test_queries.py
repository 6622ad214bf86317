"""Registered queries: smoke entry, and Spark vs DuckDB oracle on the smallest tables."""
import math

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from conftest import SF_SMALL

FAST = ["a5_sample_first", "b2_null_rates", "b10_column_profile", "b8_duplicate_rate", "c2_dedup_key",
        "e1_standardize_dates", "e2_standardize_phone", "e4_standardize_money", "f3_impute_auto", "g1_coerce_types",
        "g3_infer_types", "h7_job_outcomes", "j3_keyword_search", "j7_tag_overlap", "b13_extract_tagged",
        "l5_strip_fences", "c4_fuzzy_value_pairs", "d2_jaro_winkler_pairs", "c6_fuzzy_clusters", "i2_cluster_pair_scores"]


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def test_entry_smoke(spark):
    df = entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and rows[0]["circuit_breaker_hit"] is False


def test_every_query_has_a_callable():
    q, s = queries(), oracle_sql()
    assert set(s) <= set(q) and len(q) >= 100


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, duck, name):
    sdf = queries()[name](spark, SF_SMALL)
    cols = sorted(sdf.columns)
    srows = sorted((tuple(norm(r[c]) for c in cols) for r in sdf.collect()), key=repr)
    cur = duck.execute(oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(dcols) == cols
    drows = sorted((tuple(norm(dict(zip(dcols, r))[c]) for c in cols) for r in cur.fetchall()), key=repr)
    assert srows == drows


@pytest.mark.parametrize("name", ["j1_ttl_filter", "s2_windowed_quality", "e1_standardize_dates"])
def test_results_do_not_depend_on_session_time_zone(spark, name):
    def run():
        df = queries()[name](spark, SF_SMALL)
        return sorted(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect())
    base = run()
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        other = run()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert base == other
