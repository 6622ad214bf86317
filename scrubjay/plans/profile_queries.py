"""Registered queries: scans, sampling and profiling (A, B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from scrubjay.operators import profile as P
from scrubjay.plans.catalog import per_column_union, register
from scrubjay.plans.tables import dirty, duck_cte, load
from scrubjay.sources import io

PART_NULLS_COLS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
PART_NULLS_TYPES = {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string",
                    "p_size": "int", "p_retailprice": "double"}
LINEITEM_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


# ---------- A: scans and samples ----------

@register("a1_parquet_scan",
          "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders "
          "WHERE o_orderstatus = 'F'")
def a1_parquet_scan(spark, sf):
    df = io.read_table(spark, f"{sf}/orders.parquet")
    return df.filter(F.col("o_orderstatus") == "F")


@register("a5_sample_first",
          "SELECT * FROM orders ORDER BY o_orderkey LIMIT 500")
def a5_sample_first(spark, sf):
    return io.sample_first(load(spark, sf, "orders"), 500, ["o_orderkey"])


@register("a6_sample_json",
          "SELECT n_nationkey, to_json({'n_nationkey': n_nationkey, 'n_name': n_name, 'n_regionkey': n_regionkey}) "
          "AS row_json FROM nation ORDER BY n_nationkey LIMIT 20")
def a6_sample_json(spark, sf):
    return io.sample_json(load(spark, sf, "nation"), 20, ["n_nationkey"])


@register("a7_row_count", "SELECT count(*) AS row_count FROM lineitem")
def a7_row_count(spark, sf):
    return io.count_rows(load(spark, sf, "lineitem"))


# ---------- B: profiling ----------

@register("b1_table_shape", "SELECT count(*) AS total_rows, CAST(11 AS INTEGER) AS total_columns FROM lineitem")
def b1_table_shape(spark, sf):
    return P.table_shape(load(spark, sf, "lineitem"))


@register("b2_null_rates", duck_cte("part_nulls") + per_column_union(
    "part_nulls", PART_NULLS_COLS,
    "SELECT {name} AS name, count_if({c} IS NULL) AS null_count, "
    "round(count_if({c} IS NULL) / count(*), 4) AS null_rate FROM {view}"))
def b2_null_rates(spark, sf):
    s = P.column_stats(dirty(spark, sf, "part_nulls"))
    return s.select("name", "null_count", F.round(F.col("null_count") / F.col("total"), 4).alias("null_rate"))


@register("b3_unique_rates", per_column_union(
    "customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "SELECT {name} AS name, count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS n_unique, "
    "round((count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)) / count(*), 4) AS unique_rate "
    "FROM {view}"))
def b3_unique_rates(spark, sf):
    df = load(spark, sf, "customer")
    u = P.distinct_counts(df)
    s = P.column_stats(df)
    return s.join(u, "ordinal").select("name", "n_unique",
                                       F.round(F.col("n_unique") / F.col("total"), 4).alias("unique_rate"))


@register("b3_unique_rates_nulls", duck_cte("part_nulls") + per_column_union(
    "part_nulls", PART_NULLS_COLS,
    "SELECT {name} AS name, count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS n_unique "
    "FROM {view}"))
def b3_unique_rates_nulls(spark, sf):
    df = dirty(spark, sf, "part_nulls")
    return P.column_stats(df).join(P.distinct_counts(df), "ordinal").select("name", "n_unique")


@register("b4_sample_values", per_column_union(
    "part", ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "SELECT {name} AS name, string_agg(CAST({c} AS VARCHAR), '|' ORDER BY p_partkey) AS sample_values "
    "FROM (SELECT * FROM {view} WHERE {c} IS NOT NULL ORDER BY p_partkey LIMIT 10)"))
def b4_sample_values(spark, sf):
    df = load(spark, sf, "part")
    sv = P.sample_values(df, ["p_partkey"])
    names = P.column_stats(df).select("ordinal", "name")
    return names.join(sv, "ordinal").select("name", F.array_join("sample_values", "|").alias("sample_values"))


def _duck_profile_sql(view: str, cols: list[str], types: dict[str, str], order_key: str) -> str:
    tpl = (
        "SELECT {name} AS name, '%(dtype)s' AS dtype, round(count_if({c} IS NULL) / count(*), 4) AS null_rate, "
        "round((count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)) / count(*), 4) AS unique_rate, "
        "(SELECT string_agg(CAST(v AS VARCHAR), '|' ORDER BY k) FROM (SELECT {c} AS v, " + order_key + " AS k FROM {view} "
        "WHERE {c} IS NOT NULL ORDER BY " + order_key + " LIMIT 10)) AS sample_values, "
        "concat_ws('|', CASE WHEN count_if({c} IS NULL) / count(*) > 0.1 THEN printf('high_null_rate:%%.1f%%%%', "
        "count_if({c} IS NULL) / count(*) * 100) END, "
        "CASE WHEN (count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)) / count(*) < 0.01 "
        "AND count(*) > 100 THEN 'low_cardinality' END, "
        "%(ws)s) AS detected_issues, %(fmt)s AS format_pattern FROM {view}")
    parts = []
    for c in cols:
        is_str = types[c] == "string"
        ws = (f"CASE WHEN bool_or(\"{c}\" <> regexp_replace(\"{c}\", '^\\s+|\\s+$', '', 'g')) "
              f"THEN 'leading_trailing_whitespace' END") if is_str else "NULL"
        fmt = (f"(SELECT sig FROM (SELECT regexp_replace(regexp_replace(regexp_replace(\"{c}\", '[0-9]', '9', 'g'), "
               f"'\\p{{{{Lu}}}}', 'A', 'g'), '\\p{{{{Ll}}}}', 'a', 'g') AS sig, count(*) AS n FROM {view} WHERE \"{c}\" IS NOT NULL "
               f"GROUP BY 1 ORDER BY n DESC, sig LIMIT 1))") if is_str else "CAST(NULL AS VARCHAR)"
        parts.append(tpl % {"dtype": types[c], "ws": ws, "fmt": fmt})
    body = " UNION ALL ".join("(" + p.format(c=f'"{c}"', name=f"'{c}'", view=view) + ")"
                              for p, c in zip(parts, cols))
    return body


def _profile_out(prof):
    return prof.select("name", "dtype", "null_rate", "unique_rate",
                       F.array_join("sample_values", "|").alias("sample_values"),
                       F.array_join("detected_issues", "|").alias("detected_issues"), "format_pattern")


@register("b10_column_profile", duck_cte("part_nulls") + _duck_profile_sql(
    "part_nulls", PART_NULLS_COLS, PART_NULLS_TYPES, "p_partkey"))
def b10_column_profile(spark, sf):
    return _profile_out(P.profile_columns(dirty(spark, sf, "part_nulls"), order_by=["p_partkey"]))


@register("b7_whitespace_issue", duck_cte("customer_ws") + _duck_profile_sql(
    "customer_ws", ["c_custkey", "c_name", "c_mktsegment"],
    {"c_custkey": "bigint", "c_name": "string", "c_mktsegment": "string"}, "c_custkey"))
def b7_whitespace_issue(spark, sf):
    return _profile_out(P.profile_columns(dirty(spark, sf, "customer_ws"), order_by=["c_custkey"]))


@register("b6_low_cardinality", "SELECT name, 'low_cardinality' AS issue FROM (" + per_column_union(
    "lineitem", LINEITEM_COLS,
    "SELECT {name} AS name, (count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)) / count(*) AS ur, "
    "count(*) AS n FROM {view}") + ") WHERE ur < 0.01 AND n > 100")
def b6_low_cardinality(spark, sf):
    prof = P.profile_columns(load(spark, sf, "lineitem"), order_by=["l_orderkey", "l_linenumber"],
                             with_patterns=False)
    return (prof.select("name", F.explode("detected_issues").alias("issue"))
            .filter(F.col("issue") == "low_cardinality"))


@register("b5_high_null_issue", duck_cte("part_nulls") + "SELECT name, issue FROM (" + per_column_union(
    "part_nulls", PART_NULLS_COLS,
    "SELECT {name} AS name, printf('high_null_rate:%.1f%%', count_if({c} IS NULL) / count(*) * 100) AS issue, "
    "count_if({c} IS NULL) / count(*) AS r FROM {view}") + ") WHERE r > 0.1")
def b5_high_null_issue(spark, sf):
    prof = P.profile_columns(dirty(spark, sf, "part_nulls"), order_by=["p_partkey"], with_patterns=False)
    return (prof.select("name", F.explode("detected_issues").alias("issue"))
            .filter(F.col("issue").startswith("high_null_rate")))


@register("b8_duplicate_rate", duck_cte("orders_dup") +
          "SELECT count(*) AS total_rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM orders_dup)) AS distinct_rows, "
          "round(1 - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders_dup)) / count(*), 4) AS duplicate_row_rate "
          "FROM orders_dup")
def b8_duplicate_rate(spark, sf):
    d = P.duplicate_rate(dirty(spark, sf, "orders_dup"))
    return d.select("total_rows", "distinct_rows", F.round("duplicate_row_rate", 4).alias("duplicate_row_rate"))


@register("b8_duplicate_rate_documents",
          "SELECT count(*) AS total_rows, (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents)) "
          "AS distinct_rows FROM documents")
def b8_duplicate_rate_documents(spark, sf):
    d = P.duplicate_rate(load(spark, sf, "documents").select("text", "lang"))
    return d.select("total_rows", "distinct_rows")


_B11_SQL = (duck_cte("part_nulls") + ", cols AS (" + per_column_union(
    "part_nulls", PART_NULLS_COLS, "SELECT round(count_if({c} IS NULL) / count(*), 4) AS nr FROM {view}") + "), "
    "dup AS (SELECT count(*) AS n, (SELECT count(*) FROM (SELECT DISTINCT * FROM part_nulls)) AS d FROM part_nulls) "
    "SELECT n AS total_rows, CAST(6 AS INTEGER) AS total_columns, round(1 - d / n, 4) AS duplicate_row_rate, "
    "greatest(0.0, round(1 - (SELECT avg(nr) FROM cols) - (1 - d / n) * 0.5, 4)) AS overall_quality_score, "
    "CAST(6 AS BIGINT) AS n_profiled FROM dup")


@register("b11_quality_report", _B11_SQL)
def b11_quality_report(spark, sf):
    r = P.quality_report(dirty(spark, sf, "part_nulls"), order_by=["p_partkey"])
    return r.select("total_rows", "total_columns", "duplicate_row_rate", "overall_quality_score",
                    F.size("columns").cast("bigint").alias("n_profiled"))


@register("b9_quality_score", _B11_SQL.replace(
    "SELECT n AS total_rows, CAST(6 AS INTEGER) AS total_columns, round(1 - d / n, 4) AS duplicate_row_rate, ",
    "SELECT ").replace(", CAST(6 AS BIGINT) AS n_profiled FROM dup", " FROM dup"))
def b9_quality_score(spark, sf):
    return P.quality_report(dirty(spark, sf, "part_nulls"), order_by=["p_partkey"]).select("overall_quality_score")


@register("b14_format_pattern", duck_cte("orders_dates") +
          "SELECT 'order_date' AS name, sig AS format_pattern, round(n / tot, 6) AS pattern_share FROM ("
          "SELECT regexp_replace(regexp_replace(regexp_replace(order_date, '[0-9]', '9', 'g'), '\\p{Lu}', 'A', 'g'), "
          "'\\p{Ll}', 'a', 'g') AS sig, count(*) AS n, sum(count(*)) OVER () AS tot FROM orders_dates "
          "GROUP BY 1 ORDER BY n DESC, sig LIMIT 1)")
def b14_format_pattern(spark, sf):
    df = dirty(spark, sf, "orders_dates")
    fp = P.format_patterns(df, ["order_date"])
    return fp.select(F.lit("order_date").alias("name"), "format_pattern",
                     F.round("pattern_share", 6).alias("pattern_share"))


_DOC_COLS = ["doc_id", "text", "source", "n_chars"]


@register("b15_group_profile",
          "WITH g AS (SELECT lang, count(*) AS rows, count(DISTINCT (doc_id, text, source, n_chars)) AS d "
          "FROM documents GROUP BY lang) SELECT u.lang, u.name, g.rows, round(u.nulls / g.rows, 4) AS null_rate, "
          "round(u.nu / g.rows, 4) AS unique_rate, round(1 - g.d / g.rows, 4) AS duplicate_row_rate FROM (" +
          per_column_union("documents", _DOC_COLS,
                           "SELECT lang, {name} AS name, count_if({c} IS NULL) AS nulls, count(DISTINCT {c}) AS nu "
                           "FROM {view} GROUP BY lang") + ") u JOIN g ON u.lang = g.lang")
def b15_group_profile(spark, sf):
    return P.profile_by_group(load(spark, sf, "documents"), "lang")
