"""Fuzzy matching, clustering and entity resolution.

Design rules, all aimed at tables far larger than one machine:

* **Distinct values first.** Records are reduced to distinct ``(block,
  value)`` groups, each represented by its smallest record id. A value shared
  by a third of all rows is one node, not n^2/2 pairs.
* **Candidates come from equi-joins only.** Threshold joins use prefix
  filtering: every value keeps only its rarest tokens (q-grams for edit
  similarity, characters for Jaro-Winkler), as many as the threshold
  requires for the filter to be lossless, and candidate pairs are pairs that
  share a prefix token. Frequent tokens sort last, so they rarely reach a
  prefix. No cross join, no all-pairs block.
* **Clusters, not pairs.** Duplicate clusters are connected components of
  the verified value graph (large-star / small-star), with a reliable
  checkpoint per round; records join back to their value's component.
  Pair metrics over clusters are computed from cluster sizes, never by
  listing pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubjay.functions.flags import add_flags
from scrubjay.functions.similarity import cosine_sim, exact_sim, jaro_winkler, levenshtein_sim
from scrubjay.functions.text import normalize_ws
from scrubjay.operators.neighbours import nearest_neighbours
from scrubjay.operators.string_joins import edit_candidates, jaro_winkler_candidates
from scrubjay.session import cut_counted, cut_lineage, few_tasks, ship_package, spread

# ---------------------------------------------------------------- values

def value_groups(df: DataFrame, id_col: str, value: Column, block: Column | None = None) -> DataFrame:
    """Distinct non-NULL values (per block): ``blk, value, vid, n`` with vid = min record id.

    A NULL block key never blocks: such records form no value group.
    """
    b = block.cast("string") if block is not None else F.lit("")
    x = (df.select(F.col(id_col).alias("__id"), b.alias("blk"), value.alias("value"))
         .filter(F.col("value").isNotNull() & F.col("blk").isNotNull()))
    return x.groupBy("blk", "value").agg(F.min("__id").alias("vid"), F.count(F.lit(1)).alias("n"))


def record_values(df: DataFrame, id_col: str, value: Column, block: Column | None = None) -> DataFrame:
    """``id, vid`` for every record with a non-NULL value (join back to its value group)."""
    b = block.cast("string") if block is not None else F.lit("")
    rec = (df.select(F.col(id_col).alias("id"), b.alias("blk"), value.alias("value"))
           .filter(F.col("value").isNotNull() & F.col("blk").isNotNull()))
    vg = value_groups(df, id_col, value, block).select("blk", "value", "vid")
    return rec.join(vg, ["blk", "value"]).select("id", "vid")


def similar_values(values: DataFrame, threshold: float, method: str = "levenshtein", q: int = 3) -> DataFrame:
    """Verified value pairs ``va, vb, value_a, value_b, sim`` with sim >= threshold.

    Jaro-Winkler runs as a pandas UDF over the distinct candidate pairs only.
    """
    ship_package(values.sparkSession)  # Jaro-Winkler is a pandas UDF
    values = cut_lineage(values)  # read by the token, candidate and verification stages
    if method == "levenshtein":
        cand = edit_candidates(values, threshold, q)
    elif method == "jaro_winkler":
        cand = jaro_winkler_candidates(values, threshold)
    else:
        raise ValueError(method)
    v = values.select("vid", "value")
    j = (cand.join(v.select(F.col("vid").alias("va"), F.col("value").alias("value_a")), "va")
         .join(v.select(F.col("vid").alias("vb"), F.col("value").alias("value_b")), "vb"))
    sim = (levenshtein_sim(F.col("value_a"), F.col("value_b")) if method == "levenshtein"
           else jaro_winkler(F.col("value_a"), F.col("value_b")))
    return j.select("va", "vb", "value_a", "value_b", sim.alias("sim")).filter(F.col("sim") >= threshold)


# ---------------------------------------------------------------- connected components

def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 200) -> DataFrame:
    """``node, component`` (component = smallest node id) for every node on an edge.

    Alternating large-star / small-star rounds (Kiveris et al., 2014): each
    round is two grouped minima and two joins; every round is cut by a
    reliable checkpoint to the shared checkpoint folder, so lost executors
    re-read the last round instead of replaying the lineage. The edges are
    counted each round and take no more tasks than their number needs.

    The fixpoint is a set of stars rooted at component minima: every child has
    exactly one parent and no parent is itself a child. Both halves are tested
    (a child with two parents still joins two components). The algorithm needs
    O(log^2 n) rounds; reaching ``max_rounds`` raises instead of returning an
    unfinished labelling. NULL ends and self-loops carry no link and are ignored.
    """
    e = (edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v"))
         .filter(F.col("u") != F.col("v"))
         .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    e, n = cut_counted(e)
    for _ in range(max_rounds):
        if _is_star_forest(e):
            return _star_labels(e)
        # large star: every node links its larger neighbours to its neighbourhood minimum
        both = few_tasks(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))), 2 * n)
        m = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        e = (few_tasks(both.join(m, "u"), 2 * n).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
             .filter(F.col("u") != F.col("v")).distinct())
        e = few_tasks(e, 2 * n)
        # small star: every node links itself and its smaller neighbours to their minimum
        m2 = few_tasks(e.groupBy("u").agg(F.min("v").alias("m")), 2 * n)
        e = few_tasks(e.join(m2, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                      .unionByName(m2.select(F.col("u"), F.col("m").alias("v"))), 2 * n)
        e = (e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
             .filter(F.col("u") != F.col("v")).distinct())
        e, n = cut_counted(few_tasks(e, 2 * n))
    raise RuntimeError(f"connected_components: no fixpoint after {max_rounds} rounds")


def _is_star_forest(e: DataFrame) -> bool:
    """True when each child ``u`` has one parent ``v`` and no parent is a child
    (``e`` holds distinct edges with u > v)."""
    degree = e.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        e.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    per = degree.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return per.filter((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).limit(1).count() == 0


def _star_labels(e: DataFrame) -> DataFrame:
    return (e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))


# ---------------------------------------------------------------- C4 / C6

def fuzzy_clusters(df: DataFrame, id_col: str, column: str, threshold: float = 0.90,
                   method: str = "levenshtein", block: Column | None = None, normalize: bool = True) -> DataFrame:
    """Canonical id per record from fuzzy value matches.

    Values are normalised (E8) unless ``normalize=False``; records with
    identical values share a node; the component id is the smallest record id
    of the component. Records with a NULL value are their own cluster.
    Output: ``id, canonical_id``.
    """
    value = normalize_ws(F.col(column)) if normalize else F.col(column)
    vals = value_groups(df, id_col, value, block)
    pairs = similar_values(vals, threshold, method)
    comp = connected_components(pairs, "va", "vb")
    rv = record_values(df, id_col, value, block)
    out = (rv.join(comp, rv["vid"] == comp["node"], "left")
           .select("id", F.coalesce(F.col("component"), F.col("vid")).alias("canonical_id")))
    missing = df.select(F.col(id_col).alias("id")).join(out.select("id"), "id", "left_anti")
    return out.unionByName(missing.select("id", F.col("id").alias("canonical_id")))


def fuzzy_dedup(df: DataFrame, id_col: str, column: str, threshold: float = 0.90,
                method: str = "levenshtein") -> DataFrame:
    """Keep one survivor (smallest id) per fuzzy cluster (C4 + C6)."""
    cl = fuzzy_clusters(df, id_col, column, threshold, method)
    keep = cl.filter(F.col("id") == F.col("canonical_id")).select(F.col("id").alias("__k"))
    return df.join(keep, F.col(id_col) == F.col("__k"), "left_semi")


# ---------------------------------------------------------------- C5 MinHash LSH

def shingle_hashes(df: DataFrame, id_col: str, text_col: str, k: int = 3, normalized: bool = False) -> DataFrame:
    """``id, hs ARRAY<BIGINT>``: distinct xxhash64 of the word k-shingles of each text
    (the whole text when shorter). Per-row array work: no explode, no shuffle."""
    text = F.col(text_col) if normalized else normalize_ws(F.col(text_col))
    # materialise the word array once: a lambda that referenced the split
    # expression would re-split the whole text for every shingle
    w = df.select(F.col(id_col).alias("id"), F.split(text, " ").alias("w"))
    n = F.size("w")
    starts = F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1)))
    # words go into the hash one after the other, past the end none: no string is built for a shingle
    hs = F.transform(starts, lambda i: F.xxhash64(*[F.get(F.col("w"), i - 1 + j) for j in range(k)]))
    return w.select("id", F.array_distinct(hs).alias("hs"))


_SHINGLES = 512
_MIX1, _MIX2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _splitmix(x):
    z = x + _GOLD
    z = (z ^ (z >> np.uint64(30))) * _MIX1
    z = (z ^ (z >> np.uint64(27))) * _MIX2
    return z ^ (z >> np.uint64(31))


def minhash_signatures(hashes: DataFrame, num_hashes: int = 128, seed: int = 1) -> DataFrame:
    """``id, sig ARRAY<BIGINT>``: for each of ``num_hashes`` seeded mixes of the
    shingle hashes, the minimum over the document (Broder 1997).

    The shingle hashes are 64 random bits already, so a mix is one odd multiple and a shift by a
    constant. A pandas UDF applies all mixes to ``_SHINGLES`` shingles at a time; rows stay where they are.
    """
    from pyspark.sql.functions import pandas_udf
    from pyspark.sql.types import ArrayType, LongType

    ship_package(hashes.sparkSession)
    seeds = _splitmix(np.arange(2 * num_hashes, dtype=np.uint64) + np.uint64(seed * 1_000_003))
    times, plus = seeds[:num_hashes, None] | np.uint64(1), seeds[num_hashes:, None]

    @pandas_udf(ArrayType(LongType()))
    def sig(col: pd.Series) -> pd.Series:
        out, room = [], np.empty((num_hashes, _SHINGLES), np.uint64)
        with np.errstate(over="ignore"):
            for hs in col:
                h = np.asarray(hs, dtype=np.int64).view(np.uint64)
                if h.size == 0:
                    out.append(None)
                    continue
                m = np.full(num_hashes, np.iinfo(np.uint64).max, np.uint64)
                for lo in range(0, h.size, _SHINGLES):
                    part = h[lo:lo + _SHINGLES]
                    x = np.multiply(times, part, out=room[:, :part.size])
                    x += plus
                    np.minimum(m, x.min(axis=1), out=m)
                out.append(m.view(np.int64))
        return pd.Series(out)

    # else the filter would be moved below a repartition and the signatures made there as well
    return hashes.select("id", sig.asNondeterministic()(F.col("hs")).alias("sig")).filter(F.col("sig").isNotNull())


def band_keys(sigs: DataFrame, bands: int = 16, rows: int = 8) -> DataFrame:
    """``sigs`` with ``keys ARRAY<BIGINT>``, one hash of each band of the signature, in place of ``sig``."""
    keys = F.array(*[F.xxhash64(F.lit(b), F.slice("sig", b * rows + 1, rows)) for b in range(bands)])
    return sigs.withColumn("keys", keys).drop("sig")


def band_buckets(keyed: DataFrame) -> DataFrame:
    """``id, band, key, sz, rep``: the band buckets (of ``id, keys``) with two members or more, their size and smallest member."""
    bk = keyed.select("id", F.posexplode("keys").alias("band", "key"))
    size = bk.groupBy("band", "key").agg(F.count(F.lit(1)).alias("sz"), F.min("id").alias("rep")).filter("sz > 1")
    return bk.join(size, ["band", "key"])


def lsh_candidates(buckets: DataFrame) -> DataFrame:
    """Candidate pairs ``a < b`` that link each member of a bucket to the smallest one.

    Their number stays below that of the bucket entries, whatever the size of a bucket. What these stars miss is found by ``pairs_across``.
    """
    return buckets.filter(F.col("id") != F.col("rep")).select(F.col("rep").alias("a"), F.col("id").alias("b")).distinct()


def pairs_across(buckets: DataFrame, sizes: DataFrame, comp: DataFrame, threshold: float, tile: int = 64) -> DataFrame:
    """Candidate pairs ``a < b`` of ``buckets`` whose components differ.

    ``comp`` (node, component) holds the links found so far, ``sizes`` (id, n) the set sizes; buckets within one component
    are left out. The members of a bucket are dealt into tiles of about ``tile``, and each pair of tiles is a join key of its own,
    so no task holds more than two tiles of a key. Members of a bucket's most frequent component meet the others, not one another.
    A pair leaves the join, from its first shared bucket, unless the set sizes rule it out.
    """
    bk = buckets.join(comp, buckets["id"] == comp["node"], "left").select("id", "band", "key", F.coalesce("component", "id").alias("comp"))
    shares = bk.groupBy("band", "key", "comp").agg(F.count(F.lit(1)).alias("m")).groupBy("band", "key").agg(
        F.max(F.struct("m", "comp")).alias("main"), F.sum("m").alias("sz"), F.count(F.lit(1)).alias("comps")).filter("comps > 1")
    bk = bk.join(shares, ["band", "key"]).join(sizes, "id")
    mine = bk.groupBy("id").agg(F.sort_array(F.collect_set(F.struct("band", "key"))).alias("all"))  # at most one a band
    # tiles 0 .. others - 1 hold the others, the main component's follow
    others, mains = (F.ceil(x / tile).cast("int") for x in (F.col("sz") - F.col("main.m"), F.col("main.m")))
    bk = bk.join(mine, "id").withColumn("others", others).withColumn("mains", mains).withColumn("is_main", F.col("comp") == F.col("main.comp"))
    dealt = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    bk = bk.withColumn("tile", F.when(F.col("is_main"), F.col("others") + dealt(F.col("mains"))).otherwise(dealt(F.col("others"))))
    to = F.sequence(F.lit(0), F.when(F.col("is_main"), F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1)
    tiles = bk.withColumn("other", F.explode(to))
    side = lambda x: tiles.select("band", "key", F.least("tile", "other").alias("ti"), F.greatest("tile", "other").alias("tj"), "tile",
                                  F.struct("id", "comp", "n", "all").alias(x), F.col("tile").alias(f"t{x}")).drop("tile")
    j = side("x").filter("tx = ti").join(side("y").filter("ty = tj"), ["band", "key", "ti", "tj"])
    first = F.array_intersect("x.all", "y.all")[0]
    apart = (F.col("x.comp") != F.col("y.comp")) & (F.least("x.n", "y.n") / F.greatest("x.n", "y.n") >= threshold)
    once = (F.col("ti") < F.col("tj")) | (F.col("x.id") < F.col("y.id"))
    j = j.filter(apart & once & (first["band"] == F.col("band")))
    return j.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))


def jaccard_verify(pairs: DataFrame, hashes: DataFrame, threshold: float) -> DataFrame:
    """Exact Jaccard of the shingle sets of candidate pairs: ``a, b, jaccard`` >= threshold.

    Each pair fetches its two hash arrays by equi-join and intersects them
    (hash-based, linear in the set sizes).
    """
    ha = hashes.select(F.col("id").alias("a"), F.col("hs").alias("ha"))
    hb = hashes.select(F.col("id").alias("b"), F.col("hs").alias("hb"))
    j = pairs.join(ha, "a").join(hb, "b")
    inter = F.size(F.array_intersect("ha", "hb"))
    jac = inter / (F.size("ha") + F.size("hb") - inter)
    return j.select("a", "b", jac.alias("jaccard")).filter(F.col("jaccard") >= threshold)


BROADCAST_IDS = 1_000_000  # the texts of so many named ids are found without a shuffle of all texts


def _verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """``jaccard_verify`` of ``pairs`` over ``texts`` (id, t): only the texts that a pair names are hashed."""
    pairs = cut_lineage(pairs)
    named = cut_lineage(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct())
    named = F.broadcast(named) if named.count() <= BROADCAST_IDS else named
    return jaccard_verify(pairs, shingle_hashes(texts.join(named, "id", "left_semi"), "id", "t", normalized=True), threshold)


def near_duplicate_documents(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.90,
                             num_hashes: int = 128, bands: int = 16) -> DataFrame:
    """Canonical id per document from MinHash-LSH near-duplicate detection.

    One scan leaves 32 bytes of SHA-256, the set size and a hash of each band of
    a text; neither texts nor shingle sets are stored or shuffled but those that
    a candidate pair names. Identical texts are grouped by the SHA-256 and
    represented by their smallest id; near duplicates are found between the
    representatives by LSH and verified by exact Jaccard, so precision is exact
    and only recall is probabilistic (P[candidate | J=0.9] ~ 0.9999 with
    16 x 8 bands). Output ``id, canonical_id``.
    """
    src = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t0")), "id")
    normed = src.select("id", normalize_ws(F.col("t0")).alias("t")).filter(F.col("t").isNotNull())
    hs = shingle_hashes(normed.select(F.struct("id", F.unhex(F.sha2("t", 256)).alias("k")).alias("row"), "t"), "row", "t", normalized=True)
    sigs = minhash_signatures(hs.select(F.struct("id.id", "id.k", F.size("hs").alias("n")).alias("id"), "hs"), num_hashes)
    told = cut_lineage(band_keys(sigs, bands, num_hashes // bands).select("id.*", "keys"))
    rep = told.groupBy("k").agg(F.min("id").alias("vid"))
    rv = told.select("id", "k").join(rep, "k").select("id", "vid")
    reps = told.select("id", "n", "keys").join(rep.select(F.col("vid").alias("id")), "id", "left_semi")
    buckets = cut_lineage(band_buckets(reps))
    texts = normed.select("id", "t")
    ver = cut_lineage(_verify(lsh_candidates(buckets), texts, threshold))
    sizes = told.select("id", "n").join(buckets.select("id").distinct(), "id", "left_semi").distinct()
    ver = ver.unionByName(_verify(pairs_across(buckets, sizes, connected_components(ver, "a", "b"), threshold), texts, threshold))
    comp = connected_components(ver, "a", "b")
    out = (rv.join(comp, rv["vid"] == comp["node"], "left")
           .select("id", F.coalesce(F.col("component"), F.col("vid")).alias("canonical_id")))
    missing = df.select(F.col(id_col).alias("id")).join(out.select("id"), "id", "left_anti")
    return out.unionByName(missing.select("id", F.col("id").alias("canonical_id")))


# ---------------------------------------------------------------- D6 / D7 / D10 / D12

def score_pairs(pairs: DataFrame, fields: list[tuple[str, str, float]], left: str = "l_", right: str = "r_") -> DataFrame:
    """Weighted pair score sum(w * sim) / sum(w) over fields where both sides are non-NULL.

    ``fields``: (column, comparator, weight); comparators ``levenshtein``,
    ``jaro_winkler``, ``exact``, ``cosine``. Pair rows carry ``l_<col>`` and
    ``r_<col>``. Adds ``sim_<col>`` and ``score`` (0 when no field compares).
    """
    ship_package(pairs.sparkSession)
    comp = {"levenshtein": levenshtein_sim, "jaro_winkler": jaro_winkler, "exact": exact_sim, "cosine": cosine_sim}
    num, den = F.lit(0.0), F.lit(0.0)
    out = pairs
    for col, kind, w in fields:
        a, b = F.col(left + col), F.col(right + col)
        sim = comp[kind](a, b)
        out = out.withColumn(f"sim_{col}", sim)
        present = a.isNotNull() & b.isNotNull()
        num = num + F.when(present, F.col(f"sim_{col}") * w).otherwise(0.0)
        den = den + F.when(present, F.lit(w)).otherwise(0.0)
    return out.withColumn("score", F.when(den > 0, num / den).otherwise(F.lit(0.0)))


MATCH_THRESHOLD = 0.85
REVIEW_THRESHOLD = 0.75


def classify_pairs(scored: DataFrame, score_col: str = "score", match: float = MATCH_THRESHOLD,
                   review: float = REVIEW_THRESHOLD) -> DataFrame:
    """``match`` >= 0.85, ``review`` in [0.75, 0.85), else ``non_match``; review rows flagged."""
    s = F.col(score_col)
    decision = F.when(s >= match, "match").when(s >= review, "review").otherwise("non_match")
    return scored.withColumn("decision", decision).withColumn("__flagged__", decision == "review").withColumn(
        "__flag_reason__", F.when(decision == "review", F.lit("entity_review:score")))


def cluster_pair_counts(clusters: DataFrame, cluster_col: str = "canonical_id") -> DataFrame:
    """Pairs implied by clusters, without listing them (D12): ``cluster, size, pairs``."""
    return (clusters.groupBy(cluster_col).agg(F.count(F.lit(1)).alias("size"))
            .select(F.col(cluster_col).alias("cluster"), "size",
                    (F.col("size") * (F.col("size") - 1) / 2).cast("bigint").alias("pairs")))


# Comparator levels for Fellegi-Sunter: exact / >= 0.92 / >= 0.80 / else.
FS_LEVELS = (0.92, 0.80)
FS_PRIOR = 0.01
FS_M0 = (0.9, 0.05, 0.03, 0.02)


def comparison_levels(scored: DataFrame, sim_cols: list[str]) -> DataFrame:
    """Level 0 exact (sim = 1), 1 >= 0.92, 2 >= 0.80, 3 otherwise, NULL = no evidence."""
    out = scored
    for c in sim_cols:
        s = F.col(c)
        out = out.withColumn(f"lvl_{c}", F.when(s.isNull(), F.lit(None).cast("int")).when(s >= 1.0, 0)
                             .when(s >= FS_LEVELS[0], 1).when(s >= FS_LEVELS[1], 2).otherwise(3))
    return out


def random_pairs(df: DataFrame, id_col: str, rounds: int = 4) -> DataFrame:
    """``va < vb``: pairs of distinct ids drawn by hash, about ``rounds / 2`` per id.

    In each round the ids are dealt into as many buckets as there are ids and meet inside their bucket, so the pairs grow with the
    rows, a bucket holds a few ids, and a retried task draws the same pairs. No column but the id has a say.
    """
    ids = df.select(F.col(id_col).alias("id")).filter(F.col("id").isNotNull()).distinct()
    n = max(ids.count(), 1)
    dealt = ids.select("id", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round")).withColumn(
        "bucket", F.pmod(F.xxhash64("round", "id"), F.lit(n)))
    a, b = dealt.withColumnRenamed("id", "va"), dealt.withColumnRenamed("id", "vb")
    return a.join(b, ["round", "bucket"]).filter("va < vb").select("va", "vb").distinct()


def fellegi_sunter(leveled: DataFrame, sim_cols: list[str], max_rounds: int = 25, tol: float = 1e-4,
                   prior: float = FS_PRIOR, random_levels: DataFrame | None = None) -> tuple[DataFrame, dict]:
    """EM for m/u probabilities on the level-vector count table, then match probability.

    The pairs are reduced by one aggregation to counts per level vector. That
    table has at most 5^k rows (k comparators, 4 levels + missing) whatever
    the number of pairs, so it is read once and EM iterates on it in numpy.
    The fitted log2(m/u) weights go back into the plan as literals; the
    per-pair weight and probability are column expressions.

    ``random_levels`` holds the levels of pairs drawn without regard to likeness (``random_pairs``): u is their level shares, each level
    counted half a pair more, and stays fixed. Candidate pairs are alike by selection, so u fitted on them alone (the default) is too high.
    Returns (pairs with ``match_weight`` and ``match_probability``, parameters).
    """
    lv = [f"lvl_{c}" for c in sim_cols]
    k = len(lv)
    rows = leveled.groupBy(*lv).agg(F.count(F.lit(1)).alias("cnt")).collect()  # <= 5^k rows
    lev = np.array([[(-1 if r[c] is None else r[c]) for c in lv] for r in rows], dtype=np.int64).reshape(-1, k)
    cnt = np.array([r["cnt"] for r in rows], dtype=np.float64)
    m = np.tile(np.array(FS_M0, dtype=np.float64), (k, 1))
    u = np.full((k, 4), 1e-6)
    for i in range(k):  # u starts from level shares over all pairs (random pairs are mostly non-matches)
        for x in range(4):
            u[i, x] = max(cnt[lev[:, i] == x].sum() / max(cnt[lev[:, i] >= 0].sum(), 1.0), 1e-6)
    if random_levels is not None:
        drawn = random_levels.groupBy(*lv).agg(F.count(F.lit(1)).alias("cnt")).collect()  # <= 5^k rows
        for i, c in enumerate(lv):
            seen = [sum(r["cnt"] for r in drawn if r[c] == x) + 0.5 for x in range(4)]
            u[i] = np.array(seen) / sum(seen)
    lam = prior
    for _ in range(max_rounds):
        lm = np.full(len(cnt), math.log(lam))
        lu = np.full(len(cnt), math.log(1 - lam))
        for i in range(k):
            seen = lev[:, i] >= 0
            lm[seen] += np.log(m[i, lev[seen, i]])
            lu[seen] += np.log(u[i, lev[seen, i]])
        g = 1.0 / (1.0 + np.exp(lu - lm))
        new_lam = min(max((cnt * g).sum() / max(cnt.sum(), 1.0), 1e-6), 1 - 1e-6)
        new_m, new_u = np.empty_like(m), u.copy()
        for i in range(k):
            seen = lev[:, i] >= 0
            wm, wu = (cnt * g)[seen], (cnt * (1 - g))[seen]
            for x in range(4):
                hit = lev[seen, i] == x
                new_m[i, x] = max(wm[hit].sum() / max(wm.sum(), 1e-12), 1e-6)
                if random_levels is None:
                    new_u[i, x] = max(wu[hit].sum() / max(wu.sum(), 1e-12), 1e-6)
        change = max(abs(new_lam - lam), float(np.abs(new_m - m).max()), float(np.abs(new_u - u).max()))
        lam, m, u = new_lam, new_m, new_u
        if change < tol:
            break
    w = F.lit(0.0)
    for i, c in enumerate(lv):
        ratios = F.array(*[F.lit(float(math.log2(m[i, x] / u[i, x]))) for x in range(4)])
        w = w + F.coalesce(F.element_at(ratios, F.col(c) + 1), F.lit(0.0))
    out = leveled.withColumn("match_weight", w)
    two = F.pow(F.lit(2.0), F.col("match_weight"))
    out = out.withColumn("match_probability", F.lit(prior) * two / (1 - prior + prior * two))
    return out, {"lambda": lam, "m": m.tolist(), "u": u.tolist()}


# ---------------------------------------------------------------- D8 / F7 vectors

def vector_neighbours(df: DataFrame, id_col: str, vec_col: str, k: int = 20, candidates_df: DataFrame | None = None,
                      queries: DataFrame | None = None) -> DataFrame:
    """Exact top-k cosine neighbours per vector (D8): ``id, neighbour_id, rank, cosine``.

    Neighbours of the rows of ``df`` among ``candidates_df`` (default: ``df`` itself); ``queries`` narrows who asks. See
    :mod:`scrubjay.operators.neighbours` for the method and the defined cases.
    """
    asked = queries if queries is not None else (df if candidates_df is not None else None)
    return nearest_neighbours(df if candidates_df is None else candidates_df, id_col, vec_col, k, queries=asked)


def donor_fill(df: DataFrame, id_col: str, vec_col: str, target: str, min_confidence: float = 0.65) -> DataFrame:
    """Fill NULL ``target`` from the nearest vector with a known value.

    Confidence = cosine to the donor; below ``min_confidence`` the row is flagged ``imputation:<target>``. Rows without
    a donor (no direction, or no known value anywhere) stay NULL and are flagged ``imputation_failed:<target>``.
    """
    need = df.filter(F.col(target).isNull())
    donors = df.filter(F.col(target).isNotNull())
    nn = vector_neighbours(need, id_col, vec_col, k=1, candidates_df=donors)
    dv = donors.select(F.col(id_col).alias("neighbour_id"), F.col(target).alias("__donor"))
    fill = nn.join(dv, "neighbour_id").select(F.col("id").alias("__fid"), "__donor", F.col("cosine").alias("__conf"))
    out = df.join(fill, F.col(id_col) == F.col("__fid"), "left")
    missing = F.col(target).isNull()
    out = add_flags(out, [(missing & (F.col("__conf") < min_confidence), f"imputation:{target}"),
                          (missing & F.col("__donor").isNull(), f"imputation_failed:{target}")])
    out = (out.withColumn("__imputed_confidence", F.when(F.col(target).isNull(), F.col("__conf")))
           .withColumn(target, F.coalesce(F.col(target), F.col("__donor"))))
    return out.drop("__fid", "__donor", "__conf")
