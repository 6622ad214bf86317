"""Registered queries: standardisation, imputation, coercion, flags and metrics (E, F, G, H1-H2, H6, H9, I, A10)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubjay.functions.flags import FLAG, REASON, split_flagged
from scrubjay.operators import coerce as CO
from scrubjay.operators import dedup as D
from scrubjay.operators import guard as G
from scrubjay.operators import impute as IM
from scrubjay.operators import metrics as M
from scrubjay.operators import profile as P
from scrubjay.operators import standardize as S
from scrubjay.plans.catalog import register
from scrubjay.plans.tables import dirty, duck_cte, load

DATE_FORMATS = ["%Y-%m-%d", "%m/%d/%Y", "%d-%b-%Y", "%Y%m%d"]
_DUCK_FMTS = "['%Y-%m-%d', '%m/%d/%Y', '%d-%b-%Y', '%Y%m%d']"
ORDERS_TYPES = {"o_orderkey": "int64", "o_totalprice": "float64", "is_open": "bool", "o_orderdate": "date"}


def _flag_sql(cond: str, reason: str) -> str:
    return (f"coalesce({cond}, false) AS {FLAG}, CASE WHEN coalesce({cond}, false) THEN '{reason}' END AS {REASON}")


# ---------- E ----------

@register("e1_standardize_dates", duck_cte("orders_dates") +
          f"SELECT o_orderkey, strftime(try_strptime(trim(order_date), {_DUCK_FMTS}), '%Y-%m-%d') AS order_date, " +
          _flag_sql(f"(trim(order_date) <> '' AND try_strptime(trim(order_date), {_DUCK_FMTS}) IS NULL)",
                    "format:order_date") + " FROM orders_dates")
def e1_standardize_dates(spark, sf):
    return S.standardize_dates(dirty(spark, sf, "orders_dates"), "order_date", DATE_FORMATS, "%Y-%m-%d")


_DUCK_PHONE = (
    "WITH p0 AS (SELECT c_custkey, phone, regexp_replace(phone, '[^0-9]', '', 'g') AS d FROM customer_phone), "
    "p1 AS (SELECT c_custkey, phone, CASE WHEN starts_with(d, '86') AND length(d) - 2 >= 10 THEN substr(d, 3) "
    "WHEN starts_with(d, '0') AND length(d) - 1 >= 10 THEN substr(d, 2) ELSE d END AS d FROM p0) "
    "SELECT c_custkey, CASE WHEN length(d) >= 10 THEN concat('+86-', substr(d, 1, length(d) - 8), '-', right(d, 8)) END "
    "AS phone, " + _flag_sql("(phone IS NOT NULL AND length(d) < 10)", "format:phone") + " FROM p1")


@register("e2_standardize_phone", duck_cte("customer_phone") + _DUCK_PHONE.replace("WITH p0", ", p0", 1))
def e2_standardize_phone(spark, sf):
    return S.standardize_phone(dirty(spark, sf, "customer_phone"), "phone", "zh_CN")


@register("e3_standardize_postal", duck_cte("customer_zip") +
          ", z AS (SELECT c_custkey, zip, regexp_replace(zip, '[^0-9]', '', 'g') AS d FROM customer_zip) "
          "SELECT c_custkey, CASE WHEN length(d) > 0 AND length(d) <= 6 THEN lpad(d, 6, '0') END AS zip, " +
          _flag_sql("(zip IS NOT NULL AND NOT (length(d) > 0 AND length(d) <= 6))", "format:zip") + " FROM z")
def e3_standardize_postal(spark, sf):
    return S.standardize_postal(dirty(spark, sf, "customer_zip"), "zip", "zh_CN")


_DUCK_MONEY = (
    ", m0 AS (SELECT o_orderkey, price, regexp_replace(trim(price), '[$€£¥,\\s]', '', 'g') AS s FROM orders_money), "
    "m1 AS (SELECT o_orderkey, price, CASE WHEN regexp_extract(s, '^\\((.*)\\)$', 1) <> '' "
    "THEN concat('-', regexp_extract(s, '^\\((.*)\\)$', 1)) ELSE s END AS s FROM m0) "
    "SELECT o_orderkey, CASE WHEN regexp_matches(s, '^-?\\d+(\\.\\d+)?$') THEN TRY_CAST(s AS DECIMAL(18,2)) END AS price, " +
    _flag_sql("(price IS NOT NULL AND NOT regexp_matches(s, '^-?\\d+(\\.\\d+)?$'))", "format:price") + " FROM m1")


@register("e4_standardize_money", duck_cte("orders_money") + _DUCK_MONEY)
def e4_standardize_money(spark, sf):
    return S.standardize_money(dirty(spark, sf, "orders_money"), "price")


@register("e5_infer_format_rules", duck_cte("orders_dates") +
          "SELECT 'order_date' AS name, 'date' AS rule, round(count_if(try_strptime(trim(order_date), "
          "['%Y-%m-%d', '%m/%d/%Y', '%d/%m/%Y', '%d-%b-%Y', '%Y%m%d', '%d.%m.%Y', '%Y/%m/%d', '%b %d, %Y', '%d %b %Y']) "
          "IS NOT NULL) / count(*), 6) AS share FROM orders_dates")
def e5_infer_format_rules(spark, sf):
    r = S.infer_format_rules(dirty(spark, sf, "orders_dates"), ["order_date"])
    return r.select("name", "rule", F.round("share", 6).alias("share"))


@register("e5_apply_inferred_rules", duck_cte("orders_dates") +
          "SELECT count_if(order_date <> 'not a date') AS parsed, count(*) AS total_rows FROM orders_dates")
def e5_apply_inferred_rules(spark, sf):
    df = dirty(spark, sf, "orders_dates")
    rules = [r.asDict() for r in S.infer_format_rules(df, ["order_date"]).collect()]  # one row per column
    out = S.apply_format_rules(df, rules)
    return out.agg(F.count("order_date").alias("parsed"), F.count(F.lit(1)).alias("total_rows"))


_LOCALES_SQL = ("(VALUES " + ", ".join(f"('{r[0]}', '{r[1]}', {r[2]}, {r[3]})" for r in S.LOCALE_RULES) +
                ") AS lr(locale, cc, nat, sub)")
_LANG_LOCALE = "CASE lang WHEN 'en' THEN 'en_US' WHEN 'de' THEN 'de_DE' WHEN 'fr' THEN 'fr_FR' WHEN 'es' THEN 'es_ES' END"


@register("e6_locale_phone",
          "WITH f AS (SELECT doc_id, lang, regexp_extract_all(text, '\\+1 \\(\\d{3}\\) \\d{3}-\\d{4}') AS found FROM documents), "
          "p AS (SELECT doc_id, lang, " + _LANG_LOCALE + " AS locale, unnest(found) AS phone, CAST(unnest(range(1, len(found) + 1)) AS INT) AS nth FROM f), "
          "q AS (SELECT p.*, coalesce(lr.cc, '86') AS cc, coalesce(lr.nat, 10) AS nat, coalesce(lr.sub, 8) AS sub, "
          "regexp_replace(phone, '[^0-9]', '', 'g') AS d0 FROM p LEFT JOIN " + _LOCALES_SQL + " ON p.locale = lr.locale "
          "WHERE phone <> ''), r AS (SELECT *, CASE WHEN starts_with(d0, cc) AND length(d0) - length(cc) >= nat "
          "THEN substr(d0, length(cc) + 1) WHEN starts_with(d0, '0') AND length(d0) - 1 >= nat THEN substr(d0, 2) "
          "ELSE d0 END AS d FROM q) SELECT doc_id, lang, nth, CASE WHEN length(d) >= nat THEN concat('+', cc, '-', "
          "substr(d, 1, length(d) - sub), '-', right(d, sub)) END AS phone FROM r")
def e6_locale_phone(spark, sf):
    docs = load(spark, sf, "documents")
    locale = (F.when(F.col("lang") == "en", "en_US").when(F.col("lang") == "de", "de_DE")
              .when(F.col("lang") == "fr", "fr_FR").when(F.col("lang") == "es", "es_ES"))
    every = F.regexp_extract_all("text", F.lit(r"\+1 \(\d{3}\) \d{3}-\d{4}"), F.lit(0))  # all phones of a text
    p = docs.select("doc_id", "lang", locale.alias("locale"), F.posexplode_outer(every).alias("nth", "phone")).filter("phone is not null")
    return S.standardize_phone_by_locale(p.withColumn("nth", F.col("nth") + 1), "phone", "locale").select("doc_id", "lang", "nth", "phone")


@register("l1_declared_formats", duck_cte("orders_dates") +
          f"SELECT o_orderkey, strftime(try_strptime(trim(order_date), {_DUCK_FMTS}), '%d/%m/%Y') AS order_date, " +
          _flag_sql(f"(trim(order_date) <> '' AND try_strptime(trim(order_date), {_DUCK_FMTS}) IS NULL)", "format:order_date") + " FROM orders_dates")
def l1_declared_formats(spark, sf):
    from scrubjay.plans.clean import clean
    rules = [{"field": "order_date", "target_format": "%d/%m/%Y"}]
    return clean(dirty(spark, sf, "orders_dates"), "format_standardization", field_rules=rules).output


@register("e7_format_compliance", duck_cte("orders_dates") +
          "SELECT round(avg(CASE WHEN regexp_matches(order_date, '^\\d{4}-\\d{2}-\\d{2}$') THEN 1.0 ELSE 0.0 END), 6) "
          "AS compliance_before, 1.0 AS compliance_after FROM orders_dates")
def e7_format_compliance(spark, sf):
    df = dirty(spark, sf, "orders_dates")
    pat = r"^\d{4}-\d{2}-\d{2}$"
    before = S.compliance_rate(df, "order_date", pat).select(F.round("format_compliance_rate", 6).alias("compliance_before"))
    after = S.compliance_rate(S.standardize_dates(df, "order_date", DATE_FORMATS), "order_date", pat)
    return before.crossJoin(after.select(F.round("format_compliance_rate", 6).alias("compliance_after")))


@register("e8_normalize_whitespace", duck_cte("customer_ws") +
          "SELECT c_custkey, trim(regexp_replace(c_name, '\\s+', ' ', 'g')) AS c_name, c_mktsegment FROM customer_ws")
def e8_normalize_whitespace(spark, sf):
    return S.normalize_text(dirty(spark, sf, "customer_ws"), ["c_name"], lower=False)


# ---------- F ----------

_MED_STATS = ("SELECT median(p_size) AS fill, quantile_cont(p_size, 0.25) AS p25, quantile_cont(p_size, 0.75) AS p75, "
              "min(p_size) AS lo, max(p_size) AS hi FROM part_nulls")
_MED_CONF = "CASE WHEN hi = lo THEN 1.0 ELSE least(1.0, greatest(0.0, 1 - (p75 - p25) / (hi - lo))) END"
_MODE_STATS = ("SELECT p_brand AS fill, n / sum(n) OVER () AS conf FROM (SELECT p_brand, count(*) AS n FROM part_nulls "
               "WHERE p_brand IS NOT NULL GROUP BY p_brand) QUALIFY row_number() OVER (ORDER BY n DESC, p_brand) = 1")


def _imputed_out(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*cols, FLAG, REASON, F.round("__imputed_confidence", 6).alias("imputed_confidence"))


@register("f1_impute_median", duck_cte("part_nulls") + f", s AS ({_MED_STATS}) "
          "SELECT p_partkey, coalesce(p_size, CAST(floor(s.fill) AS INTEGER)) AS p_size, " +
          _flag_sql(f"(p_size IS NULL AND {_MED_CONF} < 0.65)", "imputation:p_size") +
          f", CASE WHEN p_size IS NULL THEN round({_MED_CONF}, 6) END AS imputed_confidence FROM part_nulls, s")
def f1_impute_median(spark, sf):
    out = IM.impute(dirty(spark, sf, "part_nulls").select("p_partkey", "p_size"), {"p_size": "median"}, ["p_size"])
    return _imputed_out(out, ["p_partkey", "p_size"])


@register("f2_impute_mode", duck_cte("part_nulls") + f", s AS ({_MODE_STATS}) "
          "SELECT p_partkey, coalesce(p_brand, s.fill) AS p_brand, " +
          _flag_sql("(p_brand IS NULL AND s.conf < 0.65)", "imputation:p_brand") +
          ", CASE WHEN p_brand IS NULL THEN round(s.conf, 6) END AS imputed_confidence FROM part_nulls, s")
def f2_impute_mode(spark, sf):
    out = IM.impute(dirty(spark, sf, "part_nulls").select("p_partkey", "p_brand"), {"p_brand": "mode"}, ["p_brand"])
    return _imputed_out(out, ["p_partkey", "p_brand"])


_F3_SQL = (duck_cte("part_nulls") +
           f", sm AS ({_MED_STATS}), sb AS ({_MODE_STATS}), "
           "sp AS (SELECT median(p_retailprice) AS fill, quantile_cont(p_retailprice, 0.25) AS p25, "
           "quantile_cont(p_retailprice, 0.75) AS p75, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part_nulls), "
           "c AS (SELECT pn.*, sb.fill AS bf, sb.conf AS bc, CAST(floor(sm.fill) AS INTEGER) AS zf, "
           f"{_MED_CONF.replace('hi', 'sm.hi').replace('lo', 'sm.lo').replace('p75', 'sm.p75').replace('p25', 'sm.p25')} AS zc, "
           "sp.fill AS rf, CASE WHEN sp.hi = sp.lo THEN 1.0 ELSE least(1.0, greatest(0.0, 1 - (sp.p75 - sp.p25) / "
           "(sp.hi - sp.lo))) END AS rc FROM part_nulls pn, sm, sb, sp) "
           "SELECT p_partkey, p_name, coalesce(p_brand, bf) AS p_brand, p_type, coalesce(p_size, zf) AS p_size, "
           "coalesce(p_retailprice, rf) AS p_retailprice, "
           "((p_brand IS NULL AND bc < 0.65) OR (p_size IS NULL AND zc < 0.65) OR (p_retailprice IS NULL AND rc < 0.65)) "
           f"AS {FLAG}, nullif(concat_ws(';', CASE WHEN p_brand IS NULL AND bc < 0.65 THEN 'imputation:p_brand' END, "
           "CASE WHEN p_size IS NULL AND zc < 0.65 THEN 'imputation:p_size' END, CASE WHEN p_retailprice IS NULL AND "
           f"rc < 0.65 THEN 'imputation:p_retailprice' END), '') AS {REASON}, "
           "round((coalesce(CASE WHEN p_brand IS NULL THEN bc END, 0) + coalesce(CASE WHEN p_size IS NULL THEN zc END, 0) + "
           "coalesce(CASE WHEN p_retailprice IS NULL THEN rc END, 0)) / nullif((CASE WHEN p_brand IS NULL THEN 1 ELSE 0 END) + "
           "(CASE WHEN p_size IS NULL THEN 1 ELSE 0 END) + (CASE WHEN p_retailprice IS NULL THEN 1 ELSE 0 END), 0), 6) "
           "AS imputed_confidence FROM c")


@register("f3_impute_auto", _F3_SQL)
def f3_impute_auto(spark, sf):
    df = dirty(spark, sf, "part_nulls")
    out = IM.impute(df, None, ["p_brand", "p_size", "p_retailprice"])
    return _imputed_out(out, df.columns)


@register("f4_impute_grouped", duck_cte("part_nulls") +
          ", gm AS (SELECT p_type, p_brand AS fill, n / sum(n) OVER (PARTITION BY p_type) AS conf FROM "
          "(SELECT p_type, p_brand, count(*) AS n FROM part_nulls WHERE p_brand IS NOT NULL GROUP BY ALL) "
          "QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY n DESC, p_brand) = 1), "
          f"s AS ({_MODE_STATS}) SELECT p_partkey, p_type, coalesce(p_brand, gm.fill, s.fill) AS p_brand, "
          "CASE WHEN p_brand IS NULL THEN round(coalesce(gm.conf, s.conf), 6) END AS imputed_confidence "
          "FROM part_nulls LEFT JOIN gm USING (p_type), s")
def f4_impute_grouped(spark, sf):
    df = dirty(spark, sf, "part_nulls").select("p_partkey", "p_type", "p_brand")
    out = IM.impute(df, {"p_brand": "mode"}, ["p_brand"], group_by="p_type")
    return out.select("p_partkey", "p_type", "p_brand", F.round("__imputed_confidence", 6).alias("imputed_confidence"))


@register("f4_impute_grouped_median", duck_cte("part_nulls") +
          ", gm AS (SELECT p_type, median(p_size) AS fill FROM part_nulls GROUP BY p_type) "
          "SELECT p_partkey, p_type, coalesce(p_size, CAST(floor(gm.fill) AS INTEGER)) AS p_size "
          "FROM part_nulls LEFT JOIN gm USING (p_type)")
def f4_impute_grouped_median(spark, sf):
    df = dirty(spark, sf, "part_nulls").select("p_partkey", "p_type", "p_size")
    return IM.impute(df, {"p_size": "median"}, ["p_size"], group_by="p_type").select("p_partkey", "p_type", "p_size")


@register("f5_fill_confidence", duck_cte("part_nulls") +
          f"SELECT 'p_size' AS name, CAST(fill AS VARCHAR) AS fill, round({_MED_CONF}, 6) AS confidence FROM ({_MED_STATS}) "
          f"UNION ALL SELECT 'p_brand', fill, round(conf, 6) FROM ({_MODE_STATS})")
def f5_fill_confidence(spark, sf):
    df = dirty(spark, sf, "part_nulls")
    a = IM.fill_statistics(df, "p_size", "median").select(F.lit("p_size").alias("name"), F.col("fill").cast("string").alias("fill"),
                                                          F.round("confidence", 6).alias("confidence"))
    b = IM.fill_statistics(df, "p_brand", "mode").select(F.lit("p_brand").alias("name"), F.col("fill").alias("fill"),
                                                         F.round("confidence", 6).alias("confidence"))
    return a.unionByName(b)


@register("f6_impute_capped", duck_cte("doc_labels") +
          ", s AS (SELECT quality AS fill, n / sum(n) OVER () AS conf FROM (SELECT quality, count(*) AS n FROM doc_labels "
          "WHERE quality IS NOT NULL GROUP BY quality) QUALIFY row_number() OVER (ORDER BY n DESC, quality) = 1) "
          "SELECT doc_id, lang, coalesce(quality, s.fill) AS quality, quality IS NULL AS " + FLAG + ", "
          "CASE WHEN quality IS NULL THEN concat_ws(';', CASE WHEN s.conf < 0.65 THEN 'imputation:quality' END, "
          "'imputation_capped:quality') END AS " + REASON + " FROM doc_labels, s")
def f6_impute_capped(spark, sf):
    df = dirty(spark, sf, "doc_labels")
    out = IM.impute_capped(df, "quality", expensive="mode", group_by="lang")
    return out.select("doc_id", "lang", "quality", FLAG, REASON)


# ---------- G ----------

_DUCK_COERCE = (
    ", t AS (SELECT *, trim(o_orderkey) AS k, trim(o_totalprice) AS p, lower(trim(is_open)) AS b, trim(o_orderdate) AS d "
    "FROM orders_text), u AS (SELECT o_orderkey AS ok0, o_totalprice AS tp0, is_open AS io0, o_orderdate AS od0, "
    "CASE WHEN regexp_matches(k, '^[+-]?\\d+$') THEN TRY_CAST(k AS BIGINT) END AS o_orderkey, "
    "CASE WHEN regexp_matches(p, '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$') THEN TRY_CAST(p AS DOUBLE) END AS o_totalprice, "
    "CASE WHEN b IN ('true', 't', 'yes', 'y', '1') THEN true WHEN b IN ('false', 'f', 'no', 'n', '0') THEN false END AS is_open, "
    "CAST(try_strptime(d, '%Y-%m-%d') AS DATE) AS o_orderdate FROM t) "
    "SELECT o_orderkey, o_totalprice, is_open, o_orderdate, "
    "((ok0 IS NOT NULL AND o_orderkey IS NULL) OR (tp0 IS NOT NULL AND o_totalprice IS NULL) OR "
    "(io0 IS NOT NULL AND is_open IS NULL) OR (od0 IS NOT NULL AND o_orderdate IS NULL)) AS " + FLAG + ", "
    "nullif(concat_ws(';', CASE WHEN ok0 IS NOT NULL AND o_orderkey IS NULL THEN 'type_coercion:o_orderkey' END, "
    "CASE WHEN tp0 IS NOT NULL AND o_totalprice IS NULL THEN 'type_coercion:o_totalprice' END, "
    "CASE WHEN io0 IS NOT NULL AND is_open IS NULL THEN 'type_coercion:is_open' END, "
    "CASE WHEN od0 IS NOT NULL AND o_orderdate IS NULL THEN 'type_coercion:o_orderdate' END), '') AS " + REASON + " FROM u")


def _coerced(spark, sf):
    return CO.coerce_types(dirty(spark, sf, "orders_text"), ORDERS_TYPES)


@register("g1_coerce_types", duck_cte("orders_text") + _DUCK_COERCE)
def g1_coerce_types(spark, sf):
    return _coerced(spark, sf)


@register("g2_coercion_flags", duck_cte("orders_text") + _DUCK_COERCE.replace(
    "SELECT o_orderkey, o_totalprice, is_open, o_orderdate, (", "SELECT * FROM (SELECT o_orderkey, (", 1) +
    ") WHERE " + FLAG)
def g2_coercion_flags(spark, sf):
    _, flagged = split_flagged(_coerced(spark, sf))
    return flagged.select("o_orderkey", FLAG, REASON)


_G3_CASES = {
    "int": "regexp_matches(trim({c}), '^[+-]?\\d+$') AND TRY_CAST(trim({c}) AS BIGINT) IS NOT NULL",
    "dbl": "regexp_matches(trim({c}), '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$')",
    "bool": "lower(trim({c})) IN ('true', 't', 'yes', 'y', '1', 'false', 'f', 'no', 'n', '0')",
    "date": "try_strptime(trim({c}), '%Y-%m-%d') IS NOT NULL",
}


def _g3_sql() -> str:
    parts = []
    for c in ["o_orderkey", "o_totalprice", "is_open", "o_orderdate"]:
        sh = {k: f"count_if({v.format(c=c)}) / count_if({c} IS NOT NULL AND trim({c}) <> '')" for k, v in _G3_CASES.items()}
        parts.append(
            f"SELECT '{c}' AS name, CASE WHEN {sh['int']} >= 0.75 THEN 'bigint' WHEN {sh['dbl']} >= 0.75 THEN 'double' "
            f"WHEN {sh['bool']} >= 0.75 THEN 'boolean' WHEN {sh['date']} >= 0.75 THEN 'date' END AS inferred_type, "
            f"round(CASE WHEN {sh['int']} >= 0.75 THEN {sh['int']} WHEN {sh['dbl']} >= 0.75 THEN {sh['dbl']} "
            f"WHEN {sh['bool']} >= 0.75 THEN {sh['bool']} WHEN {sh['date']} >= 0.75 THEN {sh['date']} END, 6) AS share "
            f"FROM orders_text")
    return duck_cte("orders_text") + " UNION ALL ".join(f"({p})" for p in parts)


@register("g3_infer_types", _g3_sql())
def g3_infer_types(spark, sf):
    r = CO.infer_types(dirty(spark, sf, "orders_text"))
    return r.select("name", "inferred_type", F.round("share", 6).alias("share"))


@register("g4_type_consistency", duck_cte("orders_text") + _DUCK_COERCE.replace(
    "SELECT o_orderkey, o_totalprice, is_open, o_orderdate, (",
    "SELECT round((avg(CASE WHEN o_orderkey IS NOT NULL THEN 1.0 ELSE 0.0 END) + avg(CASE WHEN o_totalprice IS NOT NULL "
    "THEN 1.0 ELSE 0.0 END) + avg(CASE WHEN is_open IS NOT NULL THEN 1.0 ELSE 0.0 END) + avg(CASE WHEN o_orderdate IS "
    "NOT NULL THEN 1.0 ELSE 0.0 END)) / 4, 6) AS type_consistency_rate, count_if(", 1).split(" AS " + FLAG)[0] +
    " AS n_flagged FROM u")
def g4_type_consistency(spark, sf):
    df = dirty(spark, sf, "orders_text")
    rate = CO.type_consistency_rate(df, ORDERS_TYPES).select(F.round("type_consistency_rate", 6).alias("type_consistency_rate"))
    n = CO.coerce_types(df, ORDERS_TYPES).agg(F.count_if(F.col(FLAG)).alias("n_flagged"))
    return rate.crossJoin(n)


@register("g5_json_fields",
          "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, "
          "json_extract(props, '$.k') IS NULL AS " + FLAG + " FROM events")
def g5_json_fields(spark, sf):
    out = CO.json_fields(load(spark, sf, "events"), "props", "k INT")
    return out.select("event_id", "k", FLAG)


# ---------- H ----------

@register("h1_merge_flags", duck_cte("orders_text") + _DUCK_COERCE.replace(
    "SELECT o_orderkey, o_totalprice, is_open, o_orderdate, (", "SELECT o_orderkey, (", 1).replace(
    ") AS " + FLAG + ", ", " OR o_totalprice > 300000) AS " + FLAG + ", ").replace(
    "'type_coercion:o_orderdate' END), '') AS", "'type_coercion:o_orderdate' END, CASE WHEN o_totalprice > 300000 "
    "THEN 'outlier:o_totalprice' END), '') AS"))
def h1_merge_flags(spark, sf):
    from scrubjay.functions.flags import add_flag
    out = add_flag(_coerced(spark, sf), F.col("o_totalprice") > 300000, "outlier:o_totalprice")
    return out.select("o_orderkey", FLAG, REASON)


@register("h2_flagged_count", duck_cte("orders_text") + _DUCK_COERCE.replace(
    "SELECT o_orderkey, o_totalprice, is_open, o_orderdate, (", "SELECT count_if(", 1).split(" AS " + FLAG)[0] +
    " AS flagged_record_count FROM u")
def h2_flagged_count(spark, sf):
    from scrubjay.functions.flags import flagged_count
    df = _coerced(spark, sf)
    return df.agg(flagged_count(df).alias("flagged_record_count"))


@register("a10_split_flagged", duck_cte("orders_text") + _DUCK_COERCE.replace(
    "SELECT o_orderkey, o_totalprice, is_open, o_orderdate, (", "SELECT count_if(NOT (", 1).split(" AS " + FLAG)[0] +
    ") AS clean_rows FROM u")
def a10_split_flagged(spark, sf):
    clean, _ = split_flagged(_coerced(spark, sf))
    return clean.agg(F.count(F.lit(1)).alias("clean_rows"))


def _part_delta(spark, sf):
    before = dirty(spark, sf, "part_nulls")
    after = IM.impute(before, {"p_size": "median", "p_brand": "mode"}, ["p_brand", "p_size"]).drop(
        FLAG, REASON, "__imputed_confidence", "__imputed_cells")
    b = P.profile_columns(before, order_by=["p_partkey"], with_patterns=False)
    a = P.profile_columns(after, order_by=["p_partkey"], with_patterns=False)
    return IM.quality_delta(b, a), after


_H6_SQL = (duck_cte("part_nulls") + ", d AS (" + " UNION ALL ".join(
    f"(SELECT '{c}' AS name, round(count_if({c} IS NULL) / count(*), 4) AS null_rate_before, "
    f"{'0.0' if c in ('p_brand', 'p_size') else f'round(count_if({c} IS NULL) / count(*), 4)'} AS null_rate_after "
    f"FROM part_nulls)" for c in ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]) + ") ")


@register("h6_quality_delta", _H6_SQL +
          "SELECT name, null_rate_before, null_rate_after, round(null_rate_after - null_rate_before, 6) AS null_rate_delta FROM d")
def h6_quality_delta(spark, sf):
    d, _ = _part_delta(spark, sf)
    return d.withColumn("null_rate_delta", F.round("null_rate_delta", 6))


@register("h9_confidence_gate", duck_cte("part_nulls") + f", s AS ({_MODE_STATS}) "
          "SELECT count_if(p_brand IS NULL AND s.conf < 0.65) AS gated FROM part_nulls, s")
def h9_confidence_gate(spark, sf):
    df = dirty(spark, sf, "part_nulls").select("p_partkey", "p_brand")
    conf = IM.fill_statistics(df, "p_brand", "mode").first()["confidence"]  # one row
    x = df.filter(F.col("p_brand").isNull()).withColumn("__c", F.lit(conf).cast("double"))
    gated = G.confidence_gate(x, "__c", IM.DEFAULT_MIN_CONFIDENCE)
    return gated.agg(F.count_if(F.col(FLAG)).alias("gated"))


# ---------- I ----------

@register("i4_completeness", _H6_SQL +
          "SELECT round(least(1.0, greatest(0.0, 1 + avg(null_rate_after - null_rate_before))), 6) AS completeness_rate, "
          "round(1 - avg(null_rate_after), 6) AS completeness FROM d")
def i4_completeness(spark, sf):
    d, _ = _part_delta(spark, sf)
    return d.agg(F.round(M.completeness_rate(F.avg("null_rate_delta")), 6).alias("completeness_rate"),
                 F.round(1 - F.avg("null_rate_after"), 6).alias("completeness"))


@register("i5_uniqueness", duck_cte("orders_dup") +
          "SELECT round(least(1.0, (SELECT count(*) FROM (SELECT DISTINCT * FROM orders_dup)) / count(*)), 6) AS uniqueness_rate, "
          "round(least(1.0, (SELECT count(*) FROM (SELECT DISTINCT * FROM orders_dup)) / count(*)), 6) AS row_retention_rate, "
          "round((SELECT count(*) FROM (SELECT DISTINCT * FROM orders_dup)) / count(*), 6) AS true_uniqueness FROM orders_dup")
def i5_uniqueness(spark, sf):
    before = dirty(spark, sf, "orders_dup")
    am = M.audit_metrics(G.audit(before, D.dedup_all(before)))
    tu = M.true_uniqueness(before)
    return am.crossJoin(tu).select(F.round("uniqueness_rate", 6).alias("uniqueness_rate"),
                                   F.round("row_retention_rate", 6).alias("row_retention_rate"),
                                   F.round("true_uniqueness", 6).alias("true_uniqueness"))


@register("i7_first_pass_rate", duck_cte("attempts") +
          "SELECT round(avg(CASE WHEN success AND retry_count = 0 THEN 1.0 ELSE 0.0 END), 6) AS script_first_pass_rate "
          "FROM attempts")
def i7_first_pass_rate(spark, sf):
    return M.first_pass_rate(dirty(spark, sf, "attempts")).select(
        F.round("script_first_pass_rate", 6).alias("script_first_pass_rate"))


@register("i10_imputation_confidence", duck_cte("part_nulls") + f", s AS ({_MED_STATS}) "
          f"SELECT round(coalesce(avg(CASE WHEN p_size IS NULL THEN {_MED_CONF} END), 0.75), 6) AS "
          "imputation_confidence_score FROM part_nulls, s")
def i10_imputation_confidence(spark, sf):
    out = IM.impute(dirty(spark, sf, "part_nulls").select("p_partkey", "p_size"), {"p_size": "median"}, ["p_size"])
    return M.imputation_confidence_score(out).select(
        F.round("imputation_confidence_score", 6).alias("imputation_confidence_score"))


@register("i12_coercion_success", duck_cte("orders_text") + _DUCK_COERCE.replace(
    "SELECT o_orderkey, o_totalprice, is_open, o_orderdate, (", "SELECT round(greatest(0.0, 1 - count_if(", 1).split(
    " AS " + FLAG)[0] + " / greatest(count(*), 1)), 6) AS coercion_success_rate FROM u")
def i12_coercion_success(spark, sf):
    before = dirty(spark, sf, "orders_text")
    a = G.audit(before, CO.coerce_types(before, ORDERS_TYPES))
    return M.audit_metrics(a).select(F.round("coercion_success_rate", 6).alias("coercion_success_rate"))


def _task_metric_rows(spark, sf) -> DataFrame:
    """Metric values of three tasks, each computed from data: (task, metric, value)."""
    before = dirty(spark, sf, "orders_dup")
    am = M.audit_metrics(G.audit(before, D.dedup_all(before)))
    fp = M.first_pass_rate(dirty(spark, sf, "attempts"))
    def rows(df, task, pairs):
        return df.select(F.inline(F.array(*[
            F.struct(F.lit(task).alias("task"), F.lit(m).alias("metric"), v.cast("double").alias("value"))
            for m, v in pairs])))
    dedup = rows(am.crossJoin(fp), "deduplication", [
        ("uniqueness_rate", F.col("uniqueness_rate")), ("row_retention_rate", F.col("row_retention_rate")),
        ("script_first_pass_rate", F.col("script_first_pass_rate")), ("not_a_metric", F.lit(5.0))])
    ot = dirty(spark, sf, "orders_text")
    tc = CO.type_consistency_rate(ot, ORDERS_TYPES)
    cs = M.audit_metrics(G.audit(ot, CO.coerce_types(ot, ORDERS_TYPES)))
    coerce = rows(tc.crossJoin(cs), "type_coercion", [
        ("type_consistency_rate", F.col("type_consistency_rate")),
        ("coercion_success_rate", F.col("coercion_success_rate"))])
    d, _ = _part_delta(spark, sf)
    imp = IM.impute(dirty(spark, sf, "part_nulls"), {"p_size": "median", "p_brand": "mode"}, ["p_brand", "p_size"])
    ic = M.imputation_confidence_score(imp)
    comp = d.agg(M.completeness_rate(F.avg("null_rate_delta")).alias("completeness_rate"))
    mi = rows(comp.crossJoin(ic), "missing_value_imputation", [
        ("completeness_rate", F.col("completeness_rate")),
        ("imputation_confidence_score", F.col("imputation_confidence_score"))])
    return reduce(DataFrame.unionByName, [dedup, coerce, mi])


_I13_SQL = (
    duck_cte("orders_dup", "attempts", "orders_text", "part_nulls") +
    _DUCK_COERCE.split(") SELECT o_orderkey, o_totalprice")[0] + "), "
    "coerced AS (SELECT o_orderkey, o_totalprice, is_open, o_orderdate, ok0, tp0, io0, od0 FROM u), "
    "ded AS (SELECT least(1.0, (SELECT count(*) FROM (SELECT DISTINCT * FROM orders_dup)) / count(*)) AS r FROM orders_dup), "
    "fp AS (SELECT avg(CASE WHEN success AND retry_count = 0 THEN 1.0 ELSE 0.0 END) AS r FROM attempts), "
    "tc AS (SELECT (avg(CASE WHEN o_orderkey IS NOT NULL THEN 1.0 ELSE 0.0 END) + avg(CASE WHEN o_totalprice IS NOT NULL "
    "THEN 1.0 ELSE 0.0 END) + avg(CASE WHEN is_open IS NOT NULL THEN 1.0 ELSE 0.0 END) + avg(CASE WHEN o_orderdate IS "
    "NOT NULL THEN 1.0 ELSE 0.0 END)) / 4 AS r, greatest(0.0, 1 - count_if((ok0 IS NOT NULL AND o_orderkey IS NULL) OR "
    "(tp0 IS NOT NULL AND o_totalprice IS NULL) OR (io0 IS NOT NULL AND is_open IS NULL) OR (od0 IS NOT NULL AND "
    "o_orderdate IS NULL)) / count(*)) AS cs FROM coerced), "
    f"ms AS ({_MED_STATS}), mb AS ({_MODE_STATS}), "
    "nr AS (SELECT avg(d) AS d FROM (SELECT -round(count_if(p_brand IS NULL) / count(*), 4) AS d FROM part_nulls "
    "UNION ALL SELECT -round(count_if(p_size IS NULL) / count(*), 4) FROM part_nulls UNION ALL SELECT 0.0 UNION ALL "
    "SELECT 0.0 UNION ALL SELECT 0.0 UNION ALL SELECT 0.0)), "
    "ic AS (SELECT sum(c) / sum(k) AS r FROM (SELECT ((CASE WHEN p_brand IS NULL THEN mb.conf ELSE 0 END) + "
    f"(CASE WHEN p_size IS NULL THEN {_MED_CONF.replace('hi', 'ms.hi').replace('lo', 'ms.lo').replace('p75', 'ms.p75').replace('p25', 'ms.p25')} ELSE 0 END)) AS c, "
    "((CASE WHEN p_brand IS NULL THEN 1 ELSE 0 END) + (CASE WHEN p_size IS NULL THEN 1 ELSE 0 END)) AS k "
    "FROM part_nulls, ms, mb WHERE p_brand IS NULL OR p_size IS NULL)), "
    "scores AS (SELECT 'deduplication' AS task, round(round(ded.r, 4) * 0.5 + round(ded.r, 4) * 0.3 + round(fp.r, 4) * 0.2, 4) "
    "AS weighted_score FROM ded, fp UNION ALL SELECT 'type_coercion', round(round(tc.r, 4) * 0.6 + round(tc.cs, 4) * 0.4, 4) "
    "FROM tc UNION ALL SELECT 'missing_value_imputation', round(round(least(1.0, greatest(0.0, 1 + nr.d)), 4) * 0.7 + "
    "round(ic.r, 4) * 0.3, 4) FROM nr, ic) ")


@register("i13_task_scores", _I13_SQL + "SELECT task, weighted_score FROM scores")
def i13_task_scores(spark, sf):
    return M.task_scores(_task_metric_rows(spark, sf))


@register("i14_overall_score", _I13_SQL +
          "SELECT round(avg(weighted_score), 4) AS overall_weighted_score, round(avg(weighted_score), 4) >= 0.85 AS passed "
          "FROM scores")
def i14_overall_score(spark, sf):
    return M.overall_score(M.task_scores(_task_metric_rows(spark, sf)), min_score=0.85)


@register("i9_null_rate_delta", _H6_SQL + "SELECT round(avg(null_rate_after - null_rate_before), 6) AS null_rate_delta FROM d")
def i9_null_rate_delta(spark, sf):
    d, _ = _part_delta(spark, sf)
    return M.null_rate_delta(d).select(F.round("null_rate_delta", 6).alias("null_rate_delta"))


@register("i8_format_compliance_after", duck_cte("orders_dates") +
          "SELECT round(avg(CASE WHEN regexp_matches(strftime(try_strptime(trim(order_date), " + _DUCK_FMTS + "), "
          "'%Y-%m-%d'), '^\\d{4}-\\d{2}-\\d{2}$') THEN 1.0 ELSE 0.0 END), 6) AS format_compliance_rate "
          "FROM orders_dates WHERE try_strptime(trim(order_date), " + _DUCK_FMTS + ") IS NOT NULL")
def i8_format_compliance_after(spark, sf):
    out = S.standardize_dates(dirty(spark, sf, "orders_dates"), "order_date", DATE_FORMATS)
    r = S.compliance_rate(out, "order_date", r"^\d{4}-\d{2}-\d{2}$")
    return r.select(F.round("format_compliance_rate", 6).alias("format_compliance_rate"))
