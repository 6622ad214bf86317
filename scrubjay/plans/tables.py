"""Loading the given tables and deriving the dirty views (FIXTURES §3).

Every dirty view is derived from a whole input table with deterministic
expressions; the same expressions, written for DuckDB, open each oracle query.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Fixed derivations, written once per engine. Keys: view name -> (spark_sql, duckdb_sql).
_SAME = {
    "orders_dup": "SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 10 = 0",
    "part_nulls": (
        "SELECT p_partkey, p_name, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_brand END AS p_brand, p_type, "
        "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size END AS p_size, "
        "CASE WHEN p_partkey % 40 = 0 THEN NULL ELSE p_retailprice END AS p_retailprice FROM part"),
    "customer_ws": (
        "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN concat('  ', c_name) "
        "WHEN c_custkey % 4 = 1 THEN concat(c_name, ' ') ELSE c_name END AS c_name, c_mktsegment FROM customer"),
    "customer_phone": (
        "SELECT c_custkey, CASE c_custkey % 5 "
        "WHEN 0 THEN concat('+86 ', CAST(10 + c_custkey % 90 AS STRING), ' ', lpad(CAST((c_custkey * 7919) % 100000000 AS STRING), 8, '0')) "
        "WHEN 1 THEN concat('(', CAST(10 + c_custkey % 90 AS STRING), ') ', lpad(CAST((c_custkey * 7919) % 100000000 AS STRING), 8, '0')) "
        "WHEN 2 THEN concat('0', CAST(10 + c_custkey % 90 AS STRING), '-', lpad(CAST((c_custkey * 7919) % 100000000 AS STRING), 8, '0')) "
        "WHEN 3 THEN concat(CAST(10 + c_custkey % 90 AS STRING), lpad(CAST((c_custkey * 7919) % 100000000 AS STRING), 8, '0')) "
        "ELSE 'unknown' END AS phone FROM customer"),
    "customer_zip": (
        "SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'N/A' WHEN c_custkey % 3 = 1 "
        "THEN concat('ZIP ', CAST((c_custkey * 37) % 1000000 AS STRING)) "
        "ELSE CAST((c_custkey * 37) % 1000000 AS STRING) END AS zip FROM customer"),
    "orders_text": (
        "SELECT CAST(o_orderkey AS STRING) AS o_orderkey, CASE WHEN o_orderkey % 25 = 0 THEN 'n/a' "
        "WHEN o_orderkey % 10 = 1 THEN concat(' ', CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING), ' ') "
        "ELSE CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING) END AS o_totalprice, "
        "CASE WHEN o_orderkey % 30 = 7 THEN 'maybe' WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END AS is_open, "
        "CAST(CAST(o_orderdate AS DATE) AS STRING) AS o_orderdate FROM orders"),
    "attempts": (
        "SELECT user_id AS job_id, event_id AS script_id, "
        "CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS attempt, "
        "event_type <> 'error' AS success, event_type = 'signup' AS circuit_breaker_hit, "
        "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 3 AS retry_count, 1000 AS rows_before, "
        "CAST(1000 - floor(value) AS INT) AS rows_after, CAST(event_id % 300 AS INT) AS flagged_record_count FROM events"),
    "doc_labels": (
        "SELECT d.doc_id, d.lang, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"),
    "llm_text": (
        "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN concat(role, chr(10), 'TASK: Deduplication', chr(10), '  TASK: type_coercion') "
        "WHEN turn % 3 = 1 THEN 'please run entity_resolution and Format_Standardization' "
        "ELSE concat('```python', chr(10), role, chr(10), '```') END AS text FROM conversations"),
}

_SPLIT = {
    "orders_dates": (
        "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') "
        "WHEN 1 THEN date_format(o_orderdate, 'MM/dd/yyyy') WHEN 2 THEN date_format(o_orderdate, 'dd-MMM-yyyy') "
        "WHEN 3 THEN date_format(o_orderdate, 'yyyyMMdd') ELSE 'not a date' END AS order_date FROM orders",
        "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') "
        "WHEN 1 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 2 THEN strftime(o_orderdate, '%d-%b-%Y') "
        "WHEN 3 THEN strftime(o_orderdate, '%Y%m%d') ELSE 'not a date' END AS order_date FROM orders"),
    "orders_money": (
        "SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'free' WHEN o_orderkey % 4 = 1 "
        "THEN concat('(', format_number(o_totalprice, 2), ')') ELSE concat('$', format_number(o_totalprice, 2)) END AS price FROM orders",
        "SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'free' WHEN o_orderkey % 4 = 1 "
        "THEN concat('(', format('{:,.2f}', o_totalprice), ')') ELSE concat('$', format('{:,.2f}', o_totalprice)) END AS price FROM orders"),
    "part_tags": (
        "SELECT p_partkey, p_type, p_retailprice, array(split(p_name, ' ')[0], split(p_name, ' ')[1], p_brand) AS tags FROM part",
        "SELECT p_partkey, p_type, p_retailprice, [string_split(p_name, ' ')[1], string_split(p_name, ' ')[2], p_brand] AS tags FROM part"),
    "page_titles": (
        "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, "
        "lower(trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '[^A-Za-z ]+', ''))) AS title FROM pages",
        "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, "
        "lower(trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '[^A-Za-z ]+', '', 'g'))) AS title FROM pages"),
    "page_entities": (
        "SELECT page_id, CASE WHEN page_id % 9 <> 0 THEN regexp_extract(url, '^[a-z]+://([^/]+)', 1) END AS host, "
        "nullif(lower(trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '[^A-Za-z ]+', ''))), '') AS title, "
        "regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+)/', 1) AS section FROM pages",
        "SELECT page_id, CASE WHEN page_id % 9 <> 0 THEN regexp_extract(url, '^[a-z]+://([^/]+)', 1) END AS host, "
        "nullif(lower(trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '[^A-Za-z ]+', '', 'g'))), '') AS title, "
        "regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+)/', 1) AS section FROM pages"),
}

VIEW_DEPS = {
    "orders_dup": ["orders"], "part_nulls": ["part"], "customer_ws": ["customer"],
    "customer_phone": ["customer"], "customer_zip": ["customer"], "orders_text": ["orders"],
    "attempts": ["events"], "doc_labels": ["documents", "labels"], "llm_text": ["conversations"],
    "orders_dates": ["orders"], "orders_money": ["orders"], "part_tags": ["part"], "page_titles": ["pages"], "page_entities": ["pages"],
}


def view_sql(name: str, engine: str) -> str:
    if name in _SAME:
        return _SAME[name]
    spark_sql, duck_sql = _SPLIT[name]
    return spark_sql if engine == "spark" else duck_sql


def dirty(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A dirty view as a lazy DataFrame over the whole base table(s)."""
    sql = view_sql(name, "spark")
    refs = {t: load(spark, sf_dir, t) for t in VIEW_DEPS[name]}
    # spark.sql binds the base tables as DataFrame arguments: no global temp views
    for t in refs:
        sql = re.sub(rf"\b(FROM|JOIN)\s+{t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **refs)


def duck_cte(*names: str) -> str:
    """``WITH`` clause defining dirty views for a DuckDB oracle query."""
    parts = [f"{n} AS ({view_sql(n, 'duckdb')})" for n in names]
    return "WITH " + ", ".join(parts) + " "
