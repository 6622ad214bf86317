"""Registered queries: retrieval over tables, tagged-line extraction, fence stripping."""

from __future__ import annotations

from pyspark.sql import functions as F

from scrubjay.functions.text import extract_tagged, keyword_fallback, strip_code_fence
from scrubjay.operators import search as J
from scrubjay.plans.catalog import register
from scrubjay.plans.tables import dirty, duck_cte, load

# The five task names of the reference, in its fallback-scan order.
TASK_VOCAB = ["deduplication", "entity_resolution", "format_standardization", "missing_value_imputation",
              "type_coercion"]
_MEM_TYPE = "CASE WHEN event_type IN ('click', 'view') THEN 'short' ELSE 'long' END"


def _memories(spark, sf):
    ev = load(spark, sf, "events")
    return ev.select(F.col("event_id").alias("id"), F.expr(_MEM_TYPE).alias("type"), F.col("ts").alias("created_at"),
                     F.col("value").alias("score"), F.col("event_type").alias("summary"),
                     F.array("event_type", F.concat(F.lit("user"), F.col("user_id").cast("string"))).alias("tags"))


@register("j1_ttl_filter",
          f"SELECT event_id AS id, {_MEM_TYPE} AS type FROM events WHERE NOT ({_MEM_TYPE} = 'short' AND "
          "(SELECT max(ts) FROM events) - ts > INTERVAL 24 HOURS)")
def j1_ttl_filter(spark, sf):
    m = _memories(spark, sf)
    now = m.agg(F.max("created_at").cast("string")).first()[0]  # one value, derived from the data
    kept = J.ttl_filter(m, F.lit(now).cast("timestamp_ntz"))  # text -> NTZ does not depend on time zones
    return kept.select("id", "type")


@register("j2_list_by_score",
          f"SELECT event_id AS id, value AS score FROM events WHERE {_MEM_TYPE} = 'long'")
def j2_list_by_score(spark, sf):
    return J.list_by_score(_memories(spark, sf), "score", "id", "type", "long").select("id", "score")


_Q = "the and eaux qui the"


def _duck_kw(text_expr: str, query: str) -> str:
    words = query.lower().split()
    hits = " + ".join(f"(CASE WHEN contains(lower({text_expr}), '{w}') THEN 1 ELSE 0 END)" for w in words)
    return f"({hits}) / {float(len(words))}"


@register("j3_keyword_search",
          f"SELECT doc_id, round({_duck_kw('text', _Q)}, 6) AS score FROM documents WHERE {_duck_kw('text', _Q)} > 0")
def j3_keyword_search(spark, sf):
    r = J.keyword_search(load(spark, sf, "documents"), ["text"], _Q, "doc_id")
    return r.select("doc_id", F.round("score", 6).alias("score"))


_Q2 = "memory summary user7 purchase"


@register("j3_keyword_search_tags",
          "SELECT event_id AS id, round(" + _duck_kw("concat_ws(' ', event_type, concat_ws(' ', event_type, "
                                                      "concat('user', CAST(user_id AS VARCHAR))))", _Q2) + ", 6) AS score "
          "FROM events WHERE " + _duck_kw("concat_ws(' ', event_type, concat_ws(' ', event_type, "
                                          "concat('user', CAST(user_id AS VARCHAR))))", _Q2) + " > 0")
def j3_keyword_search_tags(spark, sf):
    r = J.keyword_search(_memories(spark, sf), ["summary"], _Q2, "id", tags_col="tags")
    return r.select("id", F.round("score", 6).alias("score"))


_MANY = "concat('summary user', CAST(n_nationkey AS STRING), ' purchase ', CASE WHEN n_nationkey % 3 = 0 THEN 'er' ELSE 'click click' END)"
_ENTRY = "concat_ws(' ', event_type, concat_ws(' ', event_type, concat('user', CAST(user_id AS VARCHAR))))"


@register("j3_keyword_search_many",
          f"WITH q AS (SELECT n_nationkey AS query_id, string_split({_MANY.replace('STRING', 'VARCHAR')}, ' ') AS w FROM nation), "
          f"s AS (SELECT query_id, event_id AS id, value, len(list_filter(w, lambda x: contains({_ENTRY}, x))) / len(w) AS score FROM q, events) "
          "SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, value DESC NULLS LAST, id) AS INT) AS rank, id, "
          "round(score, 6) AS score FROM s WHERE score > 0) WHERE rank <= 10")
def j3_keyword_search_many(spark, sf):
    """One query a nation; repeated words count twice, 'er' is part of other words; equal scores by the event's value."""
    queries = load(spark, sf, "nation").select(F.col("n_nationkey").alias("query_id"), F.expr(_MANY).alias("q"))
    entries = load(spark, sf, "events").select(F.col("event_id").alias("id"), "value", F.col("event_type").alias("summary"), F.array("event_type", F.concat(F.lit("user"), F.col("user_id").cast("string"))).alias("tags"))
    r = J.keyword_search_many(entries, ["summary"], queries, "id", "query_id", "q", k=10, tags_col="tags", prior_col="value")
    return r.withColumn("score", F.round("score", 6))


@register("j7_tag_overlap_many", duck_cte("part_tags") +
          ", q AS (SELECT p_partkey AS query_id, tags AS t FROM part_tags), "
          "s AS (SELECT query_id, p_partkey, p_retailprice, len(list_intersect(list_distinct(tags), list_distinct(t))) AS overlap FROM q, part_tags WHERE query_id % 100 = 0) "
          "SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, p_retailprice DESC NULLS LAST, p_partkey) AS INT) AS rank, "
          "p_partkey, CAST(overlap AS INT) AS overlap FROM s WHERE overlap > 0) WHERE rank <= 10")
def j7_tag_overlap_many(spark, sf):
    """Every hundredth part asks with its own tags, all parts answer."""
    parts = dirty(spark, sf, "part_tags")
    queries = parts.filter(F.col("p_partkey") % 100 == 0).select(F.col("p_partkey").alias("query_id"), F.col("tags").alias("t"))
    return J.tag_overlap_many(parts, "tags", queries, "query_id", "t", "p_partkey", "p_retailprice")


@register("j4_delete_ids", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j4_delete_ids(spark, sf):
    return J.delete_ids(load(spark, sf, "documents"), load(spark, sf, "labels"), "doc_id").select("doc_id")


@register("j5_usage_counters",
          "SELECT c_custkey, CAST(coalesce(u.n, 0) AS BIGINT) AS use_count, u.last_used FROM customer c LEFT JOIN "
          "(SELECT user_id, count(*) AS n, max(ts) AS last_used FROM events GROUP BY user_id) u ON c.c_custkey = u.user_id")
def j5_usage_counters(spark, sf):
    r = J.usage_counters(load(spark, sf, "customer"), load(spark, sf, "events"), "c_custkey", "user_id", "ts")
    return r.select("c_custkey", "use_count", "last_used")


@register("j6_list_templates", "SELECT p_partkey, p_retailprice FROM part WHERE p_type = 'SMALL'")
def j6_list_templates(spark, sf):
    return J.list_by_score(load(spark, sf, "part"), "p_retailprice", "p_partkey", "p_type", "SMALL").select(
        "p_partkey", "p_retailprice")


@register("j7_tag_overlap", duck_cte("part_tags") +
          "SELECT p_partkey, CAST(len(list_intersect(tags, ['red', 'widget', 'Brand#17'])) AS INTEGER) AS overlap "
          "FROM part_tags WHERE len(list_intersect(tags, ['red', 'widget', 'Brand#17'])) > 0")
def j7_tag_overlap(spark, sf):
    r = J.tag_overlap(dirty(spark, sf, "part_tags"), "tags", ["red", "widget", "Brand#17"], "p_partkey", "p_retailprice")
    return r.select("p_partkey", "overlap")


_VOCAB_SQL = "[" + ", ".join(f"'{w}'" for w in TASK_VOCAB) + "]"


@register("b13_extract_tagged", duck_cte("llm_text") +
          ", t AS (SELECT conv_id, turn, text, list_transform(regexp_extract_all(text, '(?m)^[ \\t]*TASK:([^\\n]*)', 1), "
          "lambda x: lower(trim(x))) AS tagged FROM llm_text) SELECT conv_id, turn, array_to_string(CASE WHEN len(tagged) > 0 "
          f"THEN tagged ELSE list_filter({_VOCAB_SQL}, lambda w: contains(lower(text), w)) END, ',') AS tasks FROM t")
def b13_extract_tagged(spark, sf):
    df = dirty(spark, sf, "llm_text")
    tagged = extract_tagged(F.col("text"), "TASK")
    tasks = F.when(F.size(tagged) > 0, tagged).otherwise(keyword_fallback(F.col("text"), TASK_VOCAB))
    return df.select("conv_id", "turn", F.array_join(tasks, ",").alias("tasks"))


@register("l5_strip_fences", duck_cte("llm_text") +
          ", s AS (SELECT conv_id, turn, trim(text) AS t, string_split(trim(text), chr(10)) AS l FROM llm_text) "
          "SELECT conv_id, turn, CASE WHEN starts_with(t, '```') THEN CASE WHEN len(l) > 1 AND trim(l[len(l)]) = '```' "
          "THEN array_to_string(l[2:len(l) - 1], chr(10)) ELSE array_to_string(l[2:], chr(10)) END ELSE t END AS code "
          "FROM s")
def l5_strip_fences(spark, sf):
    df = dirty(spark, sf, "llm_text")
    return df.select("conv_id", "turn", strip_code_fence(F.col("text")).alias("code"))
