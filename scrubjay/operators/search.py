"""Retrieval over knowledge tables.

Every operator is a filter, projection, join or grouped count over a table of
entries, so ranking a billion entries is a distributed sort, not a Python
loop over a JSON file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrubjay.session import cut_lineage, spread

SHORT_TTL_HOURS = 24  # fixed value: short-term entries expire after 24 h (strict >)


def ttl_filter(df: DataFrame, now: Column, type_col: str = "type", created_col: str = "created_at",
               ttl_hours: int = SHORT_TTL_HOURS) -> DataFrame:
    """Drop ``short`` entries older than the TTL (J1); ``now`` is a parameter column."""
    expired = (F.col(type_col) == "short") & (
        (now.cast("timestamp_ntz") - F.col(created_col).cast("timestamp_ntz")) > F.expr(f"INTERVAL {ttl_hours} HOURS"))
    return df.filter(~F.coalesce(expired, F.lit(False)))


def list_by_score(df: DataFrame, score_col: str, id_col: str, type_col: str | None = None,
                  type_value: str | None = None) -> DataFrame:
    """Optional type filter, then score descending with the id as tie-break.

    The ordering is a distributed range-partitioned sort; no single task sees
    all entries.
    """
    if type_col and type_value is not None:
        df = df.filter(F.col(type_col) == type_value)
    return df.orderBy(F.col(score_col).desc_nulls_last(), F.col(id_col))


def keyword_score(text: Column, query: str) -> Column:
    """Share of query words that are substrings of lower(text).

    Words are the white-space split of lower(query), duplicates kept, so a
    repeated word counts twice; substring, not token, matching.
    """
    words = query.lower().split()
    if not words:
        return F.lit(0.0)
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = [F.when(F.contains(low, F.lit(w)), 1).otherwise(0) for w in words]
    total = hits[0]
    for h in hits[1:]:
        total = total + h
    return total / F.lit(float(len(words)))


def _searched(text_cols: list[str], tags_col: str | None) -> Column:
    """The text columns joined by blanks, then the tags."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in text_cols]
    if tags_col:
        parts.append(F.array_join(F.coalesce(F.col(tags_col), F.array().cast("array<string>")), " "))
    return F.concat_ws(" ", *parts)


def _ties(prior_col: str | None, id_col: str) -> list[Column]:
    return [*([F.col(prior_col).desc_nulls_last()] if prior_col else []), F.col(id_col)]


def keyword_search(df: DataFrame, text_cols: list[str], query: str, id_col: str,
                   tags_col: str | None = None, prior_col: str | None = None) -> DataFrame:
    """Entries with a positive keyword score, best first.

    The searched text is the text columns joined by blanks plus the tags. Equal scores keep the order
    of the listing they come from (``prior_col`` descending, J2), then the id.
    Empty query -> no rows. Output adds ``score``.
    """
    if not query.split():
        return df.limit(0).withColumn("score", F.lit(0.0))
    scored = spread(df).withColumn("score", keyword_score(_searched(text_cols, tags_col), query)).filter(F.col("score") > 0)
    return scored.orderBy(F.col("score").desc(), *_ties(prior_col, id_col))


def _top(df: DataFrame, query_col: str, order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(query_col).orderBy(*order))).filter(F.col("rank") <= k)


def _top_of_kinds(scored: DataFrame, rows: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The ``k`` best ``rows`` (``__kind, ...``) of each ``__q``, whose kinds ``scored`` (``__q, __kind, ...``) rates; ``order`` ranks rows within a query.

    Rows of a kind have equal points with every query, so only the ``k`` best of a kind can be among the answers, and only the ``k`` kinds whose
    best rows come first can hold one. Neither step drops an answer.
    """
    ties = order[1:]
    place = F.row_number().over(Window.partitionBy("__kind").orderBy(*ties))
    rows = cut_lineage(rows.withColumn("__place", place).filter(F.col("__place") <= k))
    first = _top(scored.join(rows.filter("__place = 1"), "__kind"), "__q", order, k).select(*scored.columns)
    return _top(first.join(rows, "__kind"), "__q", order, k)


def _grams(c: Column, n: int) -> Column:
    """Distinct grams of ``n`` characters; none in a shorter string."""
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))
    return F.array_distinct(F.filter(grams, lambda g: F.length(g) == n))


def words_in_vocabulary(words: DataFrame, tokens: DataFrame) -> DataFrame:
    """``word, token``: the tokens (column ``token``) that contain each word (column ``word``), both distinct and without white space.

    Tokens are indexed by their grams of one to three characters; a word looks up the rarest gram of its own length class, and
    what it finds is compared in full. Vocabularies grow far more slowly than texts.
    """
    index = tokens.select("token", F.explode(F.concat(*[_grams(F.col("token"), n) for n in (1, 2, 3)])).alias("g"))
    count = index.groupBy("g").agg(F.count(F.lit(1)).alias("f"))
    own = F.when(F.length("word") >= 3, _grams(F.col("word"), 3)).otherwise(F.array("word"))
    key = (words.select("word", F.explode(own).alias("g")).join(count, "g", "left").groupBy("word")
           .agg(F.min(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "g")).alias("best")).select("word", F.col("best.g").alias("g")))
    return key.join(index, "g").filter(F.contains("token", "word")).select("word", "token")


def keyword_search_many(df: DataFrame, text_cols: list[str], queries: DataFrame, id_col: str, query_id: str, query_text: str, k: int = 10,
                        tags_col: str | None = None, prior_col: str | None = None) -> DataFrame:
    """J3 for a table of queries: ``<query_id>, rank, <id>, score``, the ``k`` best entries of each query with a score above 0.

    The score is that of :func:`keyword_score`, ties as in :func:`keyword_search`. Entries meet queries through an inverted index: a word without white space is part
    of a text if it is part of one of its tokens, so words are looked up in the vocabulary, and its tokens lead to the entries. Entries that hold the same asked words
are one kind: queries rate kinds, not entries. Queries without a word have no rows; NULL texts have no tokens;
    ids are taken to be unique on both sides.
    """
    split = lambda c: F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")
    entry = cut_lineage(spread(df).select(F.col(id_col).alias("__id"), F.explode(F.array_distinct(split(_searched(text_cols, tags_col)))).alias("token")))
    asked = queries.select(F.col(query_id).alias("__q"), split(F.coalesce(F.col(query_text), F.lit(""))).alias("w"))
    terms = asked.select("__q", F.size("w").alias("n"), F.explode("w").alias("word")).groupBy("__q", "n", "word").agg(F.count(F.lit(1)).alias("times"))
    found = words_in_vocabulary(terms.select("word").distinct(), entry.select("token").distinct())
    hits = entry.join(found, "token").groupBy("__id").agg(F.sort_array(F.collect_set("word")).alias("__kind"))  # a word counts once an entry, however many tokens hold it
    if prior_col:
        hits = hits.join(df.select(F.col(id_col).alias("__id"), F.col(prior_col).alias("__prior")), "__id")
    hits = cut_lineage(hits)
    kinds = hits.select("__kind").distinct().select("__kind", F.explode("__kind").alias("word"))
    scored = kinds.join(terms, "word").groupBy("__q", "__kind").agg((F.sum("times") / F.first("n")).alias("score"))
    best = _top_of_kinds(scored, hits, [F.col("score").desc(), *_ties("__prior" if prior_col else None, "__id")], k)
    return best.select(F.col("__q").alias(query_id), "rank", F.col("__id").alias(id_col), "score")


def delete_ids(df: DataFrame, tombstones: DataFrame, id_col: str, tomb_col: str | None = None) -> DataFrame:
    """Remove entries whose id appears in ``tombstones`` (J4): a left-anti join."""
    t = tombstones.select(F.col(tomb_col or id_col).alias("__del")).distinct()
    return df.join(t, F.col(id_col) == F.col("__del"), "left_anti")


def usage_counters(entries: DataFrame, usage_log: DataFrame, id_col: str, log_id_col: str,
                   ts_col: str) -> DataFrame:
    """``use_count`` and ``last_used`` from a usage log.

    The log is reduced to one row per id (map-side combined) before the left
    join, so a hot entry never meets the entries table un-aggregated.
    """
    u = usage_log.groupBy(F.col(log_id_col).alias("__uid")).agg(
        F.count(F.lit(1)).alias("use_count"), F.max(ts_col).alias("last_used"))
    j = entries.join(u, F.col(id_col) == F.col("__uid"), "left").drop("__uid")
    return j.withColumn("use_count", F.coalesce(F.col("use_count"), F.lit(0)).cast("bigint"))


def tag_overlap(df: DataFrame, tags_col: str, query_tags: list[str], id_col: str, score_col: str,
                task_col: str | None = None, task: str | None = None) -> DataFrame:
    """Entries sharing tags with the query, by overlap then score.

    Overlap is the size of the set intersection; NULL tags count as empty.
    """
    if task_col and task is not None:
        df = df.filter(F.col(task_col) == task)
    q = F.array(*[F.lit(t) for t in dict.fromkeys(query_tags)])
    ov = F.size(F.array_intersect(F.coalesce(F.col(tags_col), F.array().cast("array<string>")), q))
    return (df.withColumn("overlap", ov).filter(F.col("overlap") > 0)
            .orderBy(F.col("overlap").desc(), F.col(score_col).desc(), F.col(id_col)))


def tag_overlap_many(df: DataFrame, tags_col: str, queries: DataFrame, query_id: str, query_tags: str, id_col: str, score_col: str, k: int = 10) -> DataFrame:
    """J7 for a table of queries: ``<query_id>, rank, <id>, overlap``, the ``k`` entries of each query that share most tags, then by score, then by id.

    Entries with the same tags are one kind, and so are queries: kinds meet on equal tags. NULL arrays and NULL tags share nothing; of rows that repeat an id
    and score, or a query id, each counts.
    """
    own = lambda c: F.array_distinct(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda t: t.isNotNull()))
    kind = F.array_sort(F.flatten(F.collect_list("__t"))).alias("__kind")  # a tag as often as rows hold it
    entry = df.select(F.col(id_col).alias("__id"), F.col(score_col).alias("__s"), own(F.col(tags_col)).alias("__t")).filter(F.size("__t") > 0)
    asked = queries.select(F.col(query_id).alias("__qid"), own(F.col(query_tags)).alias("__t")).filter(F.size("__t") > 0)
    entry = cut_lineage(entry.groupBy("__id", "__s").agg(kind))
    asked = cut_lineage(asked.groupBy("__qid").agg(kind.alias("__q")))
    spread_out = lambda d, c, n: d.select(c).distinct().select(c, F.explode(c).alias("tag")).groupBy(c, "tag").agg(F.count(F.lit(1)).alias(n))
    shared = spread_out(entry, "__kind", "n").join(spread_out(asked, "__q", "m"), "tag")
    scored = shared.groupBy("__q", "__kind").agg(F.sum(F.col("n") * F.col("m")).cast("int").alias("overlap"))
    best = _top_of_kinds(scored, entry, [F.col("overlap").desc(), *_ties("__s", "__id")], k)
    return best.join(asked, "__q").select(F.col("__qid").alias(query_id), "rank", F.col("__id").alias(id_col), "overlap")
