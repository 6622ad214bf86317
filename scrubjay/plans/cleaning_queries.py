"""Registered queries: exact de-duplication, audit and guards."""

from __future__ import annotations

from pyspark.sql import functions as F

from scrubjay.operators import dedup as D
from scrubjay.operators import guard as G
from scrubjay.operators import profile as P
from scrubjay.plans.catalog import per_column_union, register
from scrubjay.plans.tables import dirty, duck_cte, load

ORDERS_COLS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"

_BREAKER_SQL = (
    "CASE WHEN d < -{lim} THEN printf('Row reduction %.1f%% exceeds circuit-breaker threshold %.1f%%', abs(d) * 100, "
    "{lim} * 100) WHEN b > 0 AND f / b > 0.2 THEN printf('Flagged-record rate %.1f%% > 20 %% - human review required', "
    "f / b * 100) ELSE '' END")


def _audit_sql(before: str, after: str, lim: float, flagged: str = "0") -> str:
    reason = _BREAKER_SQL.format(lim=lim)
    return (f"SELECT b AS rows_before, a AS rows_after, round(d, 6) AS row_delta_rate, CAST(f AS BIGINT) AS "
            f"flagged_record_count, (d < -{lim} OR (b > 0 AND f / b > 0.2)) AS circuit_breaker_hit, "
            f"{reason} AS breaker_reason FROM (SELECT b, a, (a - b) / greatest(b, 1) AS d, f FROM "
            f"(SELECT (SELECT count(*) FROM {before}) AS b, (SELECT count(*) FROM {after}) AS a, {flagged} AS f))")


def _round_audit(df):
    return df.withColumn("row_delta_rate", F.round("row_delta_rate", 6))


def flagship(spark, sf):
    """Key dedup of orders_dup -> audit -> breaker at the deduplication limit."""
    before = dirty(spark, sf, "orders_dup")
    after = D.dedup_exact(before, ["o_orderkey", "o_custkey"], order_by=["o_orderdate"])
    return _round_audit(G.circuit_breaker(G.audit(before, after), G.MAX_ROW_REDUCTION["deduplication"]))


_DEDUP_KEY_CTE = (duck_cte("orders_dup") + ", kd AS (SELECT DISTINCT * FROM orders_dup) ")


@register("h4_breaker_dedup", _DEDUP_KEY_CTE + _audit_sql("orders_dup", "kd", 0.30))
def h4_breaker_dedup(spark, sf):
    return flagship(spark, sf)


@register("h4_breaker_dedup_strict", _DEDUP_KEY_CTE + _audit_sql("orders_dup", "kd", 0.05))
def h4_breaker_dedup_strict(spark, sf):
    before = dirty(spark, sf, "orders_dup")
    after = D.dedup_exact(before, ["o_orderkey", "o_custkey"], order_by=["o_orderdate"])
    return _round_audit(G.circuit_breaker(G.audit(before, after), 0.05))


@register("h3_audit_rows", _DEDUP_KEY_CTE +
          "SELECT (SELECT count(*) FROM orders_dup) AS rows_before, (SELECT count(*) FROM kd) AS rows_after, "
          "round(((SELECT count(*) FROM kd) - (SELECT count(*) FROM orders_dup)) / (SELECT count(*) FROM orders_dup), 6) "
          "AS row_delta_rate, CAST(0 AS BIGINT) AS flagged_record_count")
def h3_audit_rows(spark, sf):
    before = dirty(spark, sf, "orders_dup")
    return _round_audit(G.audit(before, D.dedup_all(before)))


@register("c1_dedup_all", duck_cte("orders_dup") + f"SELECT DISTINCT {ORDERS_COLS} FROM orders_dup")
def c1_dedup_all(spark, sf):
    return D.dedup_all(dirty(spark, sf, "orders_dup"))


@register("c2_dedup_key", duck_cte("orders_dup") +
          f"SELECT {ORDERS_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey, o_custkey "
          "ORDER BY o_orderdate, o_orderstatus, o_totalprice, o_orderpriority) AS rn FROM orders_dup) WHERE rn = 1")
def c2_dedup_key(spark, sf):
    return D.dedup_exact(dirty(spark, sf, "orders_dup"), ["o_orderkey", "o_custkey"], order_by=["o_orderdate"])


@register("c2_dedup_documents_text",
          "SELECT doc_id, text, lang, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY text "
          "ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def c2_dedup_documents_text(spark, sf):
    return D.dedup_exact(load(spark, sf, "documents"), ["text"], order_by=["doc_id"])


@register("c3_key_inference",
          "WITH p AS (" + per_column_union(
              "documents", ["doc_id", "text", "lang", "source", "n_chars"],
              "SELECT {name} AS name, count(DISTINCT {c}) < count(*) AS cand FROM {view}") +
          ") SELECT name, CASE WHEN (SELECT count_if(cand) FROM p) > 0 THEN cand ELSE true END AS is_key FROM p")
def c3_key_inference(spark, sf):
    prof = P.profile_columns(load(spark, sf, "documents"), order_by=["doc_id"], with_patterns=False)
    return D.key_fields_table(prof).select("name", "is_key")


@register("c7_duplicate_groups",
          "SELECT md5(text) AS text_md5, count(*) AS group_size, min(doc_id) AS survivor_id, max(doc_id) AS max_id "
          "FROM documents GROUP BY text HAVING count(*) > 1")
def c7_duplicate_groups(spark, sf):
    g = D.duplicate_groups(load(spark, sf, "documents"), ["text"], "doc_id")
    return g.select(F.md5("text").alias("text_md5"), "group_size", "survivor_id", "max_id")


@register("c7_duplicate_members",
          "SELECT d.doc_id, g.survivor_id, g.group_size FROM documents d JOIN (SELECT text, count(*) AS group_size, "
          "min(doc_id) AS survivor_id FROM documents GROUP BY text HAVING count(*) > 1) g ON d.text = g.text")
def c7_duplicate_members(spark, sf):
    m = D.duplicate_members(load(spark, sf, "documents"), ["text"], "doc_id")
    return m.select("doc_id", "survivor_id", "group_size")


@register("h5_group_breaker",
          "WITH a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn "
          "FROM documents) WHERE rn = 1), bb AS (SELECT source, count(*) AS b FROM documents GROUP BY source), "
          "aa AS (SELECT source, count(*) AS a FROM a GROUP BY source) "
          "SELECT bb.source, b AS rows_before, coalesce(a, 0) AS rows_after, round((coalesce(a, 0) - b) / greatest(b, 1), 6) "
          "AS row_delta_rate, CAST(0 AS BIGINT) AS flagged_record_count, (coalesce(a, 0) - b) / greatest(b, 1) < -0.1 "
          "AS circuit_breaker_hit FROM bb LEFT JOIN aa ON bb.source = aa.source")
def h5_group_breaker(spark, sf):
    docs = load(spark, sf, "documents")
    after = D.dedup_exact(docs, ["text"], order_by=["doc_id"])
    r = G.grouped_breaker(docs, after, "source", max_row_reduction=0.10)
    return _round_audit(r).select("source", "rows_before", "rows_after", "row_delta_rate", "flagged_record_count",
                                  "circuit_breaker_hit")


_ATT = duck_cte("attempts")


@register("h7_job_outcomes", _ATT +
          ", s AS (SELECT *, (success AND NOT circuit_breaker_hit) AS passed, "
          "((success AND NOT circuit_breaker_hit) OR circuit_breaker_hit OR attempt >= 3) AS stop FROM attempts), "
          "st AS (SELECT job_id, min(attempt) AS sa FROM s WHERE stop GROUP BY job_id), "
          "n AS (SELECT job_id, count(*) AS n, max(attempt) AS la FROM s GROUP BY job_id) "
          "SELECT n.job_id, CAST(coalesce(st.sa, n.n) AS BIGINT) AS attempts, "
          "CAST(CASE WHEN st.sa IS NOT NULL AND r.passed THEN st.sa - 1 ELSE coalesce(st.sa, n.n) END AS BIGINT) AS retry_count, "
          "CASE WHEN st.sa IS NULL THEN 'engineering' WHEN r.passed THEN 'complete' ELSE 'human_review' END AS status, "
          "r.rows_before, r.rows_after, r.flagged_record_count FROM n LEFT JOIN st ON n.job_id = st.job_id "
          "JOIN s r ON r.job_id = n.job_id AND r.attempt = coalesce(st.sa, n.la)")
def h7_job_outcomes(spark, sf):
    return G.job_outcomes(dirty(spark, sf, "attempts"), max_retries=3)


@register("h8_audit_summary", _ATT +
          "SELECT 'qa_node' AS node, CASE WHEN success AND NOT circuit_breaker_hit THEN 'pass' WHEN circuit_breaker_hit "
          "THEN 'circuit_break' ELSE 'fail' END AS status, count(*) AS entries, count(DISTINCT job_id) AS jobs "
          "FROM attempts GROUP BY 1, 2")
def h8_audit_summary(spark, sf):
    return G.audit_summary(G.attempt_log(dirty(spark, sf, "attempts")))


@register("h5_job_breaker", _ATT +
          "SELECT job_id, CAST(sum(rows_before) AS BIGINT) AS rows_before, CAST(sum(flagged_record_count) AS BIGINT) AS flagged, "
          "sum(flagged_record_count) / sum(rows_before) > 0.2 AS too_flagged FROM attempts GROUP BY job_id")
def h5_job_breaker(spark, sf):
    a = dirty(spark, sf, "attempts")
    g = a.groupBy("job_id").agg(F.sum("rows_before").alias("rows_before"),
                                F.sum("flagged_record_count").alias("flagged"))
    hit, _ = G.breaker_exprs(F.col("rows_before"), F.lit(0.0), F.col("flagged"), 1.0)
    return g.select("job_id", "rows_before", "flagged", hit.alias("too_flagged"))
