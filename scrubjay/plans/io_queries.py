"""Registered queries: file formats, sinks, audit log, UTF-8 repair, task
recommendation and the cleaning entry points (A2-A4, A8, A9, A11, A12, B12, L1-L4).

Round-trip queries write into a fresh folder under the session's checkpoint
directory (a shared folder on a cluster) and read the files back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from scrubjay.functions.flags import FLAG, REASON
from scrubjay.operators import guard as G
from scrubjay.operators import metrics as M
from scrubjay.plans import clean as CL
from scrubjay.plans.catalog import register
from scrubjay.plans.linkage_queries import _ENTITY_SQL, ENTITY_FIELDS
from scrubjay.plans.quality_queries import _I13_SQL
from scrubjay.plans.tables import dirty, duck_cte, load, view_sql
from scrubjay.session import ensure_checkpoint_dir
from scrubjay.sources import io


def _scratch(spark, name: str) -> str:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/scrubjay-io/{uuid.uuid4().hex}/{name}"


@register("a2_csv_scan", duck_cte("orders_text") +
          "SELECT TRY_CAST(o_orderkey AS BIGINT) AS o_orderkey, TRY_CAST(trim(o_totalprice) AS DOUBLE) AS o_totalprice, "
          "CASE lower(is_open) WHEN 'true' THEN true WHEN 'false' THEN false END AS is_open, "
          "TRY_CAST(o_orderdate AS DATE) AS o_orderdate FROM orders_text")
def a2_csv_scan(spark, sf):
    path = _scratch(spark, "orders_text.csv")
    io.write_table(dirty(spark, sf, "orders_text"), path, fmt="csv")
    return io.read_table(spark, path, schema="o_orderkey bigint, o_totalprice double, is_open boolean, o_orderdate date")


@register("a2_csv_bad_rows",
          "SELECT CASE WHEN doc_id % 10 <> 3 THEN doc_id END AS doc_id, md5(text) AS text_md5, CASE WHEN doc_id % 15 <> 7 THEN n_chars END AS n_chars, "
          f"(doc_id % 10 = 3 OR doc_id % 15 = 7) AS {FLAG}, CASE WHEN doc_id % 10 = 3 OR doc_id % 15 = 7 THEN 'csv_parse' END AS {REASON} FROM documents")
def a2_csv_bad_rows(spark, sf):
    """Whole texts, line breaks and quotes included, between cells of which some do not parse."""
    d = load(spark, sf, "documents").select(
        F.when(F.col("doc_id") % 10 == 3, F.concat(F.lit("no. "), F.col("doc_id").cast("string"))).otherwise(F.col("doc_id").cast("string")).alias("doc_id"), "text",
        F.when(F.col("doc_id") % 15 == 7, F.lit("many")).otherwise(F.col("n_chars").cast("string")).alias("n_chars"))
    path = _scratch(spark, "documents.csv")
    io.write_csv_plain(d, path)
    back = io.read_csv_flagged(spark, path, "doc_id bigint, text string, n_chars bigint")
    return back.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "n_chars", FLAG, REASON)


@register("a3_json_scan", "SELECT * FROM part")
def a3_json_scan(spark, sf):
    part = load(spark, sf, "part")
    path = _scratch(spark, "part.jsonl")
    io.write_table(part, path, fmt="json")
    return io.read_table(spark, path, schema=part.schema)


@register("a4_format_dispatch", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def a4_format_dispatch(spark, sf):
    df = io.read_table(spark, f"{sf}/lineitem.parquet")  # format from the suffix
    return df.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@register("a8_parquet_sink", "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders")
def a8_parquet_sink(spark, sf):
    path = _scratch(spark, "orders.parquet")
    io.write_table(load(spark, sf, "orders"), path)
    back = io.read_table(spark, path)
    return back.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@register("a9_csv_sink", duck_cte("orders_dup") +
          "SELECT o_orderkey, o_custkey, o_orderstatus FROM (SELECT DISTINCT * FROM orders_dup)")
def a9_csv_sink(spark, sf):
    res = CL.clean(dirty(spark, sf, "orders_dup"), "deduplication", key_fields=["o_orderkey", "o_custkey"],
                   order_by=["o_orderdate"])
    path = _scratch(spark, "orders_clean.csv")
    io.write_table(res.clean.drop(FLAG, REASON), path, fmt="csv")
    back = io.read_table(spark, path, schema="o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
                                             "o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string")
    return back.select("o_orderkey", "o_custkey", "o_orderstatus")


@register("a11_audit_log", duck_cte("attempts") +
          "SELECT CAST(job_id AS VARCHAR) AS job_id, CASE WHEN success AND NOT circuit_breaker_hit THEN 'pass' "
          "WHEN circuit_breaker_hit THEN 'circuit_break' ELSE 'fail' END AS status, count(*) AS entries "
          "FROM attempts GROUP BY ALL")
def a11_audit_log(spark, sf):
    att = dirty(spark, sf, "attempts")
    log = G.attempt_log(att)
    entries = log.select(F.current_timestamp().alias("timestamp"), "node", "status",
                         F.concat(F.lit("attempt="), F.col("attempt").cast("string")).alias("detail"),
                         F.col("job_id").cast("string").alias("job_id"))
    path = _scratch(spark, "audit_log")
    # two appends (first and later attempts) land in the same partitioned log
    io.append_audit_log(entries.filter(F.col("detail") == "attempt=1"), path)
    io.append_audit_log(entries.filter(F.col("detail") != "attempt=1"), path)
    back = spark.read.parquet(path)
    return back.groupBy(F.col("job_id").cast("string").alias("job_id"), "status").agg(
        F.count(F.lit(1)).alias("entries"))


@register("a12_utf8_repair",
          "SELECT doc_id, doc_id % 13 = 0 AS " + FLAG + ", md5(CASE WHEN doc_id % 13 = 0 THEN text || '�' "
          "ELSE text END) AS text_md5 FROM documents")
def a12_utf8_repair(spark, sf):
    docs = load(spark, sf, "documents")
    raw = docs.select("doc_id", F.when(F.col("doc_id") % 13 == 0, F.concat(F.col("text").cast("binary"),
                                                                            F.unhex(F.lit("FF"))))
                      .otherwise(F.col("text").cast("binary")).alias("raw"))
    fixed = io.repair_utf8(raw, "raw", "text")
    return fixed.select("doc_id", FLAG, F.md5("text").alias("text_md5"))


@register("b12_recommend_tasks", duck_cte("orders_text") +
          "SELECT task FROM (SELECT 'format_standardization' AS task, "
          "bool_or(o_totalprice <> trim(o_totalprice)) AS hit FROM orders_text UNION ALL "
          "SELECT 'type_coercion', count_if(regexp_matches(trim(o_totalprice), '^[+-]?(\\d+\\.?\\d*|\\.\\d+)$')) "
          ">= 0.75 * count(*) FROM orders_text UNION ALL "
          "SELECT 'deduplication', count(*) > (SELECT count(*) FROM (SELECT DISTINCT * FROM orders_text)) FROM orders_text "
          "UNION ALL SELECT 'missing_value_imputation', count_if(o_totalprice IS NULL OR is_open IS NULL) > 0 "
          "FROM orders_text) WHERE hit")
def b12_recommend_tasks(spark, sf):
    return CL.recommend_tasks(dirty(spark, sf, "orders_text"), id_col="o_orderkey").select("task")


@register("l1_clean_dedup", duck_cte("orders_dup") +
          "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM "
          "(SELECT *, row_number() OVER (PARTITION BY o_orderkey, o_custkey, o_orderstatus, o_orderdate, o_orderpriority "
          "ORDER BY o_totalprice) AS rn FROM orders_dup) WHERE rn = 1")
def l1_clean_dedup(spark, sf):
    res = CL.clean(dirty(spark, sf, "orders_dup"), "deduplication")
    return res.clean.drop(FLAG, REASON)


@register("l1_clean_coercion_audit", duck_cte("orders_text") +
          "SELECT count(*) AS rows_before, count(*) AS rows_after, CAST(count_if(trim(o_totalprice) = 'n/a' OR "
          "is_open = 'maybe') AS BIGINT) AS flagged_record_count, false AS circuit_breaker_hit FROM orders_text")
def l1_clean_coercion_audit(spark, sf):
    res = CL.clean(dirty(spark, sf, "orders_text"), "type_coercion")
    return res.audit.select("rows_before", "rows_after", "flagged_record_count", "circuit_breaker_hit")


@register("l3_custom_transform", duck_cte("orders_dup") +
          "SELECT count(*) AS rows_before, count_if(o_orderstatus <> 'P') AS rows_after, "
          "round((count_if(o_orderstatus <> 'P') - count(*)) / count(*), 6) AS row_delta_rate FROM orders_dup")
def l3_custom_transform(spark, sf):
    res = CL.apply_custom(dirty(spark, sf, "orders_dup"), lambda d: d.filter(F.col("o_orderstatus") != "P"))
    return res.audit.select("rows_before", "rows_after", F.round("row_delta_rate", 6).alias("row_delta_rate"))


@register("l3_custom_arrow", duck_cte("orders_dup") +
          "SELECT count(*) AS rows_before, count_if(o_orderstatus <> 'P') AS rows_after, "
          "count_if(o_orderstatus <> 'P' AND o_totalprice > 400000) AS flagged_record_count, "
          "round((count_if(o_orderstatus <> 'P') - count(*)) / count(*), 6) AS row_delta_rate, "
          "(count_if(o_orderstatus <> 'P') - count(*)) / count(*) < -0.3 OR "
          "count_if(o_orderstatus <> 'P' AND o_totalprice > 400000) / count(*) > 0.2 AS circuit_breaker_hit FROM orders_dup")
def l3_custom_arrow(spark, sf):
    """Open orders go and large ones are flagged, batch by batch, under the audit."""
    def run(batches):
        import pyarrow.compute as pc
        for b in batches:
            b = b.filter(pc.not_equal(b.column("o_orderstatus"), "P"))
            large = pc.greater(pc.cast(b.column("o_totalprice"), "double"), 400000.0)
            yield b.append_column("__flagged__", large).append_column("__flag_reason__", pc.if_else(large, "custom:o_totalprice", None))

    cols = dirty(spark, sf, "orders_dup").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    res = CL.apply_custom_arrow(cols, run, "o_orderkey long, o_orderstatus string, o_totalprice double, __flagged__ boolean, __flag_reason__ string")
    return res.audit.select("rows_before", "rows_after", "flagged_record_count", F.round("row_delta_rate", 6).alias("row_delta_rate"), "circuit_breaker_hit")


@register("l4_custom_metric", duck_cte("attempts") +
          "SELECT 'mean_rows_lost' AS metric, round(avg(rows_before - rows_after), 6) AS value FROM attempts "
          "UNION ALL SELECT 'breaker_share', round(avg(CASE WHEN circuit_breaker_hit THEN 1.0 ELSE 0.0 END), 6) FROM attempts")
def l4_custom_metric(spark, sf):
    M.register_metric("mean_rows_lost", F.avg(F.col("rows_before") - F.col("rows_after")), higher_is_better=False)
    M.register_metric("breaker_share", F.avg(F.col("circuit_breaker_hit").cast("double")), higher_is_better=False)
    out = M.custom_metrics(dirty(spark, sf, "attempts"), ["mean_rows_lost", "breaker_share"])
    return out.select("metric", F.round("value", 6).alias("value"))


_ENTITY_SCORES = (
    _ENTITY_SQL + ", c AS (SELECT lab.l AS p, coalesce(p.title, '~' || CAST(p.page_id AS VARCHAR)) AS g FROM page_entities p JOIN lab ON lab.node = p.page_id), "
    "k AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM c GROUP BY p, g)) AS tp, "
    "(SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM c GROUP BY p)) AS np, "
    "(SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM c GROUP BY g)) AS ng) "
    "SELECT 'entity_resolution' AS task, round(round(2 * tp / (np + ng + 1e-9), 4) * 0.5 + round(tp / (np + 1e-9), 4) * 0.25 + "
    "round(tp / (ng + 1e-9), 4) * 0.25, 4) AS weighted_score FROM k")
_FORMAT_SCORES = (
    "SELECT 'format_standardization' AS task, round(round(coalesce(avg(CASE WHEN d IS NOT NULL THEN CASE WHEN regexp_matches(d, '^\\d{4}-\\d{2}-\\d{2}$') "
    "THEN 1.0 ELSE 0.0 END END), 0.0), 4) * 0.6 + round((round(count_if(d IS NULL) / count(*), 4) - round(count_if(order_date IS NULL) / count(*), 4)) / 2, 4) * 0.4, 4) "
    "FROM (SELECT order_date, strftime(try_strptime(trim(order_date), ['%Y-%m-%d', '%m/%d/%Y', '%d-%b-%Y', '%Y%m%d']), '%Y-%m-%d') AS d FROM "
    f"({view_sql('orders_dates', 'duckdb')}))")


@register("l2_evaluation_report", _I13_SQL +
          f", five AS (SELECT task, weighted_score FROM scores UNION ALL SELECT * FROM ({_ENTITY_SCORES}) UNION ALL {_FORMAT_SCORES}) "
          "SELECT task, weighted_score, (SELECT round(avg(weighted_score), 4) FROM five) AS overall_weighted_score, "
          "(SELECT round(avg(weighted_score), 4) >= 0.85 FROM five) AS passed FROM five")
def l2_evaluation_report(spark, sf):
    """Five declared cleaning runs and their scores; true entities of the pages are their titles."""
    runs = {}

    def run(task: str, view: str, **params):
        before = dirty(spark, sf, view)
        runs[task] = before, CL.clean(before, task, **params)

    run("deduplication", "orders_dup", key_fields=["o_orderkey", "o_custkey"], order_by=["o_orderdate"])
    run("type_coercion", "orders_text")
    run("missing_value_imputation", "part_nulls", strategy_map={"p_size": "median", "p_brand": "mode"}, columns=["p_brand", "p_size"])
    run("format_standardization", "orders_dates", columns=["order_date"])
    run("entity_resolution", "page_entities", id_col="page_id", match_fields=ENTITY_FIELDS)
    more = {"deduplication": {"attempts": dirty(spark, sf, "attempts")}, "entity_resolution": {"gold_col": "title", "id_col": "page_id"},
            "format_standardization": {"compliance_pattern": {"order_date": r"^\d{4}-\d{2}-\d{2}$"}}}
    scores, overall = CL.evaluate([CL.task_metrics(t, b, r, **more.get(t, {})) for t, (b, r) in runs.items()], min_score=0.85)
    return scores.crossJoin(overall)  # one row an evaluation
