"""Queries that SQL can express give the rows of their SQL on a small table set."""
import pytest

from scrubjay.llm import queries, sql

SF_SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op1_near_dedup", "op5_url_rules", "op8_chat_format"])
def test_query_equals_sql(spark, duck, name):
    got = queries.queries()[name](spark, SF_SMALL)
    want = duck.execute(sql.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(c[0] for c in want.description)
    at = [[c[0] for c in want.description].index(c) for c in cols]
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=key) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=key)
