"""Registered queries: fuzzy de-duplication and entity resolution.

Oracles are brute force in DuckDB (all value pairs, then the threshold);
the Spark side never forms all pairs: it uses the prefix-filtered equi-join
in :mod:`scrubjay.operators.resolve`, which is lossless for the thresholds
used, so both must agree exactly. C5 (MinHash) is probabilistic in recall and
registered without an oracle; tests compare it with brute force on small fixtures.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from scrubjay.functions.flags import FLAG
from scrubjay.functions.text import normalize_ws
from scrubjay.operators import metrics as M
from scrubjay.operators import resolve as R
from scrubjay.operators.blocking import candidate_pairs
from scrubjay.operators.linkage import MatchField
from scrubjay.plans import clean as CL
from scrubjay.plans.catalog import register
from scrubjay.plans.tables import dirty, duck_cte, load

_NORM = "lower(trim(regexp_replace({c}, '\\s+', ' ', 'g')))"


def _duck_values(table: str, id_col: str, col: str, extra: str = "") -> str:
    return (f"SELECT {_NORM.format(c=col)} AS value, min({id_col}) AS vid{extra} FROM {table} "
            f"WHERE {col} IS NOT NULL GROUP BY ALL")


def _duck_lev(a: str, b: str) -> str:
    return f"(1 - levenshtein({a}, {b}) / greatest(length({a}), length({b})))"


# ---------- C4 / D3 / D1 ----------

@register("c4_fuzzy_value_pairs",
          f"WITH v AS ({_duck_values('customer', 'c_custkey', 'c_name')}) SELECT a.vid AS va, b.vid AS vb, "
          f"round({_duck_lev('a.value', 'b.value')}, 6) AS sim FROM v a JOIN v b ON a.vid < b.vid "
          f"WHERE {_duck_lev('a.value', 'b.value')} >= 0.9")
def c4_fuzzy_value_pairs(spark, sf):
    vals = R.value_groups(load(spark, sf, "customer"), "c_custkey", normalize_ws(F.col("c_name")))
    return R.similar_values(vals, 0.9).select("va", "vb", F.round("sim", 6).alias("sim"))


@register("d3_levenshtein_pairs", duck_cte("page_titles") +
          f", v AS ({_duck_values('page_titles', 'page_id', 'title')}) SELECT a.vid AS va, b.vid AS vb, "
          f"round({_duck_lev('a.value', 'b.value')}, 6) AS sim FROM v a JOIN v b ON a.vid < b.vid "
          f"WHERE {_duck_lev('a.value', 'b.value')} >= 0.8")
def d3_levenshtein_pairs(spark, sf):
    vals = R.value_groups(dirty(spark, sf, "page_titles"), "page_id", normalize_ws(F.col("title")))
    return R.similar_values(vals, 0.8).select("va", "vb", F.round("sim", 6).alias("sim"))


@register("d1_blocked_candidates",
          f"WITH v AS ({_duck_values('customer', 'c_custkey', 'c_name', ', c_mktsegment AS blk')}) "
          f"SELECT a.vid AS va, b.vid AS vb FROM v a JOIN v b ON a.blk = b.blk AND a.vid < b.vid "
          f"WHERE {_duck_lev('a.value', 'b.value')} >= 0.9")
def d1_blocked_candidates(spark, sf):
    c = load(spark, sf, "customer")
    vals = R.value_groups(c, "c_custkey", normalize_ws(F.col("c_name")), block=F.col("c_mktsegment"))
    return R.similar_values(vals, 0.9).select("va", "vb")


@register("d1_candidate_pairs",
          "WITH r AS (SELECT c_custkey AS id, 1 AS i, CAST(floor(c_acctbal) AS BIGINT) AS k0, NULL AS k1, left(c_name, 15) AS f FROM customer "
          "UNION ALL SELECT c_custkey, 2, NULL, c_mktsegment, left(c_name, 15) FROM customer), "
          "s AS (SELECT id, i, coalesce(CAST(k0 AS VARCHAR), k1) AS k, f, count(*) OVER (PARTITION BY i, coalesce(CAST(k0 AS VARCHAR), k1)) AS n FROM r), "
          "g AS (SELECT id, i, k, CASE WHEN n > 100 THEN f ELSE '' END AS f FROM s) "
          "SELECT x.id AS a, y.id AS b, min(x.i) AS block FROM g x JOIN g y ON x.i = y.i AND x.k = y.k AND x.f = y.f AND x.id < y.id GROUP BY ALL")
def d1_candidate_pairs(spark, sf):
    """Two keys: the balance to a unit, and the market segment, of which each holds a fifth of all customers and is refined by the name's first 15 characters."""
    keys = [F.floor("c_acctbal"), F.col("c_mktsegment")]
    return candidate_pairs(load(spark, sf, "customer"), "c_custkey", keys, refine=F.substring("c_name", 1, 15), max_block=100, tile=50)


# ---------- C6 / D11 / D12 ----------

_CC_SQL = (
    ", e AS (SELECT a.vid AS a, b.vid AS b FROM v a JOIN v b ON a.vid < b.vid WHERE {cond} "
    "UNION ALL SELECT b.vid, a.vid FROM v a JOIN v b ON a.vid < b.vid WHERE {cond}), "
    "lab AS (SELECT node, min(l) AS l FROM (WITH RECURSIVE r(node, l) AS (SELECT vid, vid FROM v UNION "
    "SELECT e.b, least(r.l, e.b) FROM r JOIN e ON r.node = e.a) SELECT node, min(l) AS l FROM r GROUP BY node) "
    "GROUP BY node) ")


@register("c6_fuzzy_clusters", duck_cte("page_titles") +
          f", v AS ({_duck_values('page_titles', 'page_id', 'title')})" +
          _CC_SQL.format(cond=f"{_duck_lev('a.value', 'b.value')} >= 0.8") +
          f", rv AS (SELECT page_id, {_NORM.format(c='title')} AS value FROM page_titles) "
          "SELECT rv.page_id AS id, lab.l AS canonical_id FROM rv JOIN v USING (value) JOIN lab ON lab.node = v.vid")
def c6_fuzzy_clusters(spark, sf):
    return R.fuzzy_clusters(dirty(spark, sf, "page_titles"), "page_id", "title", 0.8)


@register("d11_giant_component",
          f"WITH v AS ({_duck_values('customer', 'c_custkey', 'c_name')})" +
          _CC_SQL.format(cond=f"{_duck_lev('a.value', 'b.value')} >= 0.9") +
          "SELECT l AS canonical_id, count(*) AS members, min(node) AS first_member FROM lab GROUP BY l")
def d11_giant_component(spark, sf):
    cl = R.fuzzy_clusters(load(spark, sf, "customer"), "c_custkey", "c_name", 0.9)
    return cl.groupBy("canonical_id").agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("first_member"))


@register("c4_fuzzy_dedup", duck_cte("page_titles") +
          f", v AS ({_duck_values('page_titles', 'page_id', 'title')})" +
          _CC_SQL.format(cond=f"{_duck_lev('a.value', 'b.value')} >= 0.8") +
          "SELECT p.page_id, p.host FROM page_titles p WHERE p.page_id IN (SELECT l FROM lab) OR p.title IS NULL")
def c4_fuzzy_dedup(spark, sf):
    return R.fuzzy_dedup(dirty(spark, sf, "page_titles"), "page_id", "title", 0.8).select("page_id", "host")


@register("d12_cluster_pair_counts", duck_cte("page_titles") +
          f", v AS ({_duck_values('page_titles', 'page_id', 'title')})" +
          _CC_SQL.format(cond=f"{_duck_lev('a.value', 'b.value')} >= 0.8") +
          f", rv AS (SELECT page_id, {_NORM.format(c='title')} AS value FROM page_titles), "
          "c AS (SELECT lab.l AS cl FROM rv JOIN v USING (value) JOIN lab ON lab.node = v.vid) "
          "SELECT cl AS cluster, count(*) AS size, CAST(count(*) * (count(*) - 1) / 2 AS BIGINT) AS pairs "
          "FROM c GROUP BY cl HAVING count(*) > 1")
def d12_cluster_pair_counts(spark, sf):
    cl = R.fuzzy_clusters(dirty(spark, sf, "page_titles"), "page_id", "title", 0.8)
    return R.cluster_pair_counts(cl).filter(F.col("size") > 1)


# ---------- L1: whole cleaning runs ----------

ENTITY_FIELDS = [MatchField("title", 0.6, "levenshtein"), MatchField("host", 0.3, "jaro_winkler"), MatchField("section", 0.1, "exact")]


def _weighted(field: str, weight: float, sim: str) -> tuple[str, str]:
    known = f"a.{field} IS NOT NULL AND b.{field} IS NOT NULL"
    return f"CASE WHEN {known} THEN {weight} * {sim} ELSE 0.0 END", f"CASE WHEN {known} THEN {weight} ELSE 0.0 END"


_SUMS = [_weighted("title", 0.6, _duck_lev("a.title", "b.title")), _weighted("host", 0.3, "jaro_winkler_similarity(a.host, b.host)"),
         _weighted("section", 0.1, "(CASE WHEN a.section = b.section THEN 1.0 ELSE 0.0 END)")]
_ENTITY_SQL = (
    duck_cte("page_entities") +
    f", n AS (SELECT page_id, host, section, {_NORM.format(c='title')} AS title, {_NORM.format(c='host')} AS h FROM page_entities), "
    "v AS (SELECT page_id AS vid, title, h AS host, section FROM n), "
    f"s AS (SELECT a.vid AS a, b.vid AS b, round(CAST({' + '.join(x for x, _ in _SUMS)} AS DOUBLE) / nullif(CAST({' + '.join(w for _, w in _SUMS)} AS DOUBLE), 0), 9) AS score "
    "FROM v a JOIN v b ON a.vid < b.vid)"
    ", e AS (SELECT a, b FROM s WHERE score >= 0.85 UNION ALL SELECT b, a FROM s WHERE score >= 0.85), "
    "lab AS (SELECT node, min(l) AS l FROM (WITH RECURSIVE r(node, l) AS (SELECT vid, vid FROM v UNION "
    "SELECT e.b, least(r.l, e.b) FROM r JOIN e ON r.node = e.a) SELECT node, l FROM r) GROUP BY node), "
    "doubt AS (SELECT a, b FROM s JOIN lab x ON x.node = a JOIN lab y ON y.node = b WHERE score >= 0.75 AND score < 0.85 AND x.l <> y.l) ")


@register("l1_entity_resolution", _ENTITY_SQL +
          "SELECT p.page_id, p.host, p.title, p.section, lab.l AS canonical_id, "
          f"p.page_id IN (SELECT a FROM doubt UNION ALL SELECT b FROM doubt) AS {FLAG} FROM page_entities p JOIN lab ON lab.node = p.page_id")
def l1_entity_resolution(spark, sf):
    res = CL.clean(dirty(spark, sf, "page_entities"), "entity_resolution", id_col="page_id", match_fields=ENTITY_FIELDS)
    return res.output.select("page_id", "host", "title", "section", "canonical_id", FLAG)


@register("l1_fuzzy_dedup", duck_cte("page_titles") +
          f", v AS ({_duck_values('page_titles', 'page_id', 'title')})" +
          _CC_SQL.format(cond=f"{_duck_lev('a.value', 'b.value')} >= 0.8") +
          ", kept AS (SELECT * FROM page_titles WHERE page_id IN (SELECT l FROM lab) OR title IS NULL) "
          "SELECT (SELECT count(*) FROM page_titles) AS rows_before, (SELECT count(*) FROM kept) AS rows_after, "
          "((SELECT count(*) FROM page_titles) - (SELECT count(*) FROM kept)) / (SELECT count(*) FROM page_titles) > 0.3 AS circuit_breaker_hit")
def l1_fuzzy_dedup(spark, sf):
    res = CL.clean(dirty(spark, sf, "page_titles"), "deduplication", mode="fuzzy", id_col="page_id", fuzzy_field="title", fuzzy_threshold=0.8)
    return res.audit.select("rows_before", "rows_after", "circuit_breaker_hit")


# ---------- D2 / D6 / D10 ----------

def _name_values(spark, sf):
    return R.value_groups(load(spark, sf, "part"), "p_partkey", F.col("p_name"))


_PN = "SELECT p_name AS value, min(p_partkey) AS vid FROM part GROUP BY p_name"


@register("d2_jaro_winkler_pairs",
          f"WITH v AS ({_PN}) SELECT a.vid AS va, b.vid AS vb, round(jaro_winkler_similarity(a.value, b.value), 6) "
          "AS sim FROM v a JOIN v b ON a.vid < b.vid WHERE jaro_winkler_similarity(a.value, b.value) >= 0.85")
def d2_jaro_winkler_pairs(spark, sf):
    return R.similar_values(_name_values(spark, sf), 0.85, "jaro_winkler").select(
        "va", "vb", F.round("sim", 6).alias("sim"))


@register("d10_review_band",
          f"WITH v AS ({_PN}) SELECT CASE WHEN s >= 0.85 THEN 'match' ELSE 'review' END AS decision, count(*) AS pairs "
          "FROM (SELECT jaro_winkler_similarity(a.value, b.value) AS s FROM v a JOIN v b ON a.vid < b.vid) "
          "WHERE s >= 0.75 GROUP BY 1")
def d10_review_band(spark, sf):
    pairs = R.similar_values(_name_values(spark, sf), 0.75, "jaro_winkler")
    c = R.classify_pairs(pairs, "sim")
    return c.groupBy("decision").agg(F.count(F.lit(1)).alias("pairs"))


_D6_SQL = (
    f"WITH v AS (SELECT p_name AS value, min(p_partkey) AS vid FROM part GROUP BY p_name), "
    "pp AS (SELECT a.vid AS va, b.vid AS vb, a.value AS l_p_name, b.value AS r_p_name FROM v a JOIN v b ON a.vid < b.vid "
    "WHERE jaro_winkler_similarity(a.value, b.value) >= 0.75), "
    "x AS (SELECT pp.*, l.p_brand AS l_p_brand, r.p_brand AS r_p_brand FROM pp JOIN part l ON l.p_partkey = va "
    "JOIN part r ON r.p_partkey = vb), "
    "s AS (SELECT va, vb, (0.6 * jaro_winkler_similarity(l_p_name, r_p_name) + 0.3 * " + _duck_lev("l_p_name", "r_p_name") +
    " + 0.1 * (CASE WHEN l_p_brand = r_p_brand THEN 1.0 ELSE 0.0 END)) / 1.0 AS score FROM x) ")


def _d6(spark, sf):
    part = load(spark, sf, "part")
    pairs = R.similar_values(_name_values(spark, sf), 0.75, "jaro_winkler").select("va", "vb")
    l = part.select(F.col("p_partkey").alias("va"), F.col("p_name").alias("l_p_name"), F.col("p_brand").alias("l_p_brand"))
    r = part.select(F.col("p_partkey").alias("vb"), F.col("p_name").alias("r_p_name"), F.col("p_brand").alias("r_p_brand"))
    x = pairs.join(l, "va").join(r, "vb").withColumn("l_name2", F.col("l_p_name")).withColumn("r_name2", F.col("r_p_name"))
    return R.score_pairs(x, [("p_name", "jaro_winkler", 0.6), ("name2", "levenshtein", 0.3), ("p_brand", "exact", 0.1)])


@register("d6_weighted_scores", _D6_SQL + "SELECT va, vb, round(score, 6) AS score FROM s")
def d6_weighted_scores(spark, sf):
    return _d6(spark, sf).select("va", "vb", F.round("score", 6).alias("score"))


@register("d4_exact_comparator", _D6_SQL.split(", s AS")[0] +
          " SELECT va, vb, CASE WHEN l_p_brand = r_p_brand THEN 1.0 ELSE 0.0 END AS sim_p_brand FROM x")
def d4_exact_comparator(spark, sf):
    return _d6(spark, sf).select("va", "vb", "sim_p_brand")


@register("d10_decisions", _D6_SQL +
          "SELECT va, vb, CASE WHEN score >= 0.85 THEN 'match' WHEN score >= 0.75 THEN 'review' ELSE 'non_match' END "
          f"AS decision, score >= 0.75 AND score < 0.85 AS {FLAG} FROM s")
def d10_decisions(spark, sf):
    return R.classify_pairs(_d6(spark, sf)).select("va", "vb", "decision", FLAG)


# ---------- D5 ----------

@register("d5_cosine",
          "SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), "
          "CAST(b.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) "
          "* sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 6) AS cosine "
          "FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def d5_cosine(spark, sf):
    e = load(spark, sf, "embeddings")
    a = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("ea"))
    b = e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("eb"))
    from scrubjay.functions.similarity import cosine_sim
    return a.join(b, "a").select("a", "b", F.round(cosine_sim(F.col("ea"), F.col("eb")), 6).alias("cosine"))


# ---------- I1-I3 ----------

@register("i1_pair_scores",
          f"WITH v AS ({_PN}), p AS (SELECT a.vid AS a, b.vid AS b FROM v a JOIN v b ON a.vid < b.vid WHERE "
          "jaro_winkler_similarity(a.value, b.value) >= 0.85), g AS (SELECT a.vid AS a, b.vid AS b FROM v a JOIN v b ON "
          f"a.vid < b.vid WHERE {_duck_lev('a.value', 'b.value')} >= 0.7), t AS (SELECT count(*) AS tp FROM p JOIN g USING (a, b)) "
          "SELECT tp, (SELECT count(*) FROM p) AS n_pred, (SELECT count(*) FROM g) AS n_gold, "
          "round(2 * tp / ((SELECT count(*) FROM p) + (SELECT count(*) FROM g) + 1e-9), 6) AS pair_f1, "
          "round(tp / ((SELECT count(*) FROM p) + 1e-9), 6) AS precision, round(tp / ((SELECT count(*) FROM g) + 1e-9), 6) "
          "AS recall FROM t")
def i1_pair_scores(spark, sf):
    vals = _name_values(spark, sf)
    pred = R.similar_values(vals, 0.85, "jaro_winkler").select(F.col("va").alias("a"), F.col("vb").alias("b"))
    gold = R.similar_values(vals, 0.7).select(F.col("va").alias("a"), F.col("vb").alias("b"))
    s = M.pair_scores(pred, gold)
    return s.select("tp", "n_pred", "n_gold", *[F.round(c, 6).alias(c) for c in ("pair_f1", "precision", "recall")])


@register("i2_cluster_pair_scores",
          "WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL), "
          "t AS (SELECT CAST(sum(n * (n - 1) / 2) AS BIGINT) AS tp FROM c), "
          "p AS (SELECT CAST(sum(n * (n - 1) / 2) AS BIGINT) AS n_pred FROM (SELECT count(*) AS n FROM part GROUP BY p_brand)), "
          "g AS (SELECT CAST(sum(n * (n - 1) / 2) AS BIGINT) AS n_gold FROM (SELECT count(*) AS n FROM part GROUP BY p_type)) "
          "SELECT tp, n_pred, n_gold, round(2 * tp / (n_pred + n_gold + 1e-9), 6) AS pair_f1, "
          "round(tp / (n_pred + 1e-9), 6) AS precision, round(tp / (n_gold + 1e-9), 6) AS recall FROM t, p, g")
def i2_cluster_pair_scores(spark, sf):
    s = M.cluster_pair_scores(load(spark, sf, "part"), "p_partkey", "p_brand", "p_type")
    return s.select("tp", "n_pred", "n_gold", *[F.round(c, 6).alias(c) for c in ("pair_f1", "precision", "recall")])


# ---------- probabilistic (rows-only) ----------

@register("c5_near_duplicate_documents")
def c5_near_duplicate_documents(spark, sf):
    return R.near_duplicate_documents(load(spark, sf, "documents"), "doc_id", "text", 0.9)


_UNIT = ("u AS (SELECT *, sqrt(list_dot_product(v, v)) AS len FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)), "
         "s AS (SELECT a.vec_id AS id, b.vec_id AS nid, b.label AS donor, list_dot_product(a.v, b.v) / (a.len * b.len) AS c "
         "FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE {cond}), "
         "r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(c, 9) DESC, nid) AS k FROM s) ")
_TOP = "SELECT id, nid AS neighbour_id, CAST(k AS INT) AS rank, round(c, 6) AS cosine FROM r WHERE k <= 20"


@register("d8_vector_topk", "WITH " + _UNIT.format(cond="true") + _TOP)
def d8_vector_topk(spark, sf):
    return R.vector_neighbours(load(spark, sf, "embeddings"), "vec_id", "embedding", k=20)


@register("d8_vector_search", "WITH " + _UNIT.format(cond="a.vec_id % 100 = 0") + _TOP)
def d8_vector_search(spark, sf):
    """Every hundredth id asks, all rows answer."""
    e = load(spark, sf, "embeddings")
    return R.vector_neighbours(e, "vec_id", "embedding", k=20, queries=e.filter(F.col("vec_id") % 100 == 0))


@register("f7_donor_fill", "WITH " + _UNIT.format(cond="a.vec_id % 7 = 0 AND b.vec_id % 7 <> 0") +
          "SELECT e.vec_id, CASE WHEN e.vec_id % 7 = 0 THEN r.donor ELSE e.label END AS label, "
          f"round(r.c, 6) AS imputed_confidence, coalesce(round(r.c, 6) < 0.65, e.vec_id % 7 = 0) AS {FLAG} "
          "FROM embeddings e LEFT JOIN r ON r.id = e.vec_id AND r.k = 1")
def f7_donor_fill(spark, sf):
    e = load(spark, sf, "embeddings")
    dirty_e = e.withColumn("label", F.when(F.col("vec_id") % 7 == 0, F.lit(None)).otherwise(F.col("label")))
    out = R.donor_fill(dirty_e, "vec_id", "embedding", "label")
    return out.select("vec_id", "label", F.round("__imputed_confidence", 6).alias("imputed_confidence"), FLAG)


@register("d7_fellegi_sunter")
def d7_fellegi_sunter(spark, sf):
    c = load(spark, sf, "customer")
    vals = R.value_groups(c, "c_custkey", normalize_ws(F.col("c_name")))
    pairs = R.similar_values(vals, 0.9).select("va", "vb")
    l = c.select(F.col("c_custkey").alias("va"), F.col("c_name").alias("l_name"), F.col("c_mktsegment").alias("l_seg"),
                 F.col("c_nationkey").cast("string").alias("l_nation"))
    r = c.select(F.col("c_custkey").alias("vb"), F.col("c_name").alias("r_name"), F.col("c_mktsegment").alias("r_seg"),
                 F.col("c_nationkey").cast("string").alias("r_nation"))
    sims = ["sim_name", "sim_seg", "sim_nation"]

    def levels(p):
        x = p.join(l, "va").join(r, "vb")
        sc = R.score_pairs(x, [("name", "levenshtein", 0.6), ("seg", "exact", 0.3), ("nation", "exact", 0.1)])
        return R.comparison_levels(sc, sims)

    out, _ = R.fellegi_sunter(levels(pairs), sims, random_levels=levels(R.random_pairs(c, "c_custkey")))
    return out.select("va", "vb", F.round("match_weight", 6).alias("match_weight"),
                      F.round("match_probability", 6).alias("match_probability"))


@register("d9_hybrid_candidates")
def d9_hybrid_candidates(spark, sf):
    docs = load(spark, sf, "documents")
    emb = load(spark, sf, "embeddings")
    near = R.near_duplicate_documents(docs, "doc_id", "text", 0.9)
    text_pairs = near.filter(F.col("id") != F.col("canonical_id")).select(
        F.col("canonical_id").alias("va"), F.col("id").alias("vb"))
    vec = R.vector_neighbours(emb, "vec_id", "embedding", k=5).select(
        F.least("id", "neighbour_id").alias("va"), F.greatest("id", "neighbour_id").alias("vb"))
    pairs = text_pairs.unionByName(vec).distinct()
    dl = docs.select(F.col("doc_id").alias("va"), F.col("lang").alias("l_lang"), F.col("source").alias("l_source"))
    dr = docs.select(F.col("doc_id").alias("vb"), F.col("lang").alias("r_lang"), F.col("source").alias("r_source"))
    el = emb.select(F.col("vec_id").alias("va"), F.col("embedding").alias("l_vec"))
    er = emb.select(F.col("vec_id").alias("vb"), F.col("embedding").alias("r_vec"))
    x = pairs.join(dl, "va", "left").join(dr, "vb", "left").join(el, "va", "left").join(er, "vb", "left")
    sc = R.score_pairs(x, [("vec", "cosine", 0.6), ("lang", "exact", 0.3), ("source", "exact", 0.1)])
    return R.classify_pairs(sc).select("va", "vb", F.round("score", 6).alias("score"), "decision", FLAG)
