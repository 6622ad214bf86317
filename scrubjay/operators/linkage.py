"""Weighted linkage of records over several fields: candidates, scores, review band, canonical ids (L1 on D1-D11).

A pair scores ``sum(w * sim) / sum(w)`` over the fields both records have (D6). Candidates are found field by field, and no pair that
reaches the review limit ``t`` is lost:

* Lead. With ``W`` the weight of the fields looked at and ``w`` that of the heaviest one, a pair that has the heaviest field and reaches
  ``t`` agrees on it to at least ``1 - (1 - t) W / w``. So one similarity join of that field finds all of them; pairs where a side lacks
  it are looked for in the same way over the lighter fields.
* Average. Where that bound is too low to find anything by, the pair agrees on some field to at least ``t``: each field is joined at ``t``.

Rows that agree on all fields are one node. A value that very many nodes hold is dealt into tiles, and tiles meet by equi-joins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubjay.functions.flags import add_flags
from scrubjay.functions.text import normalize_ws
from scrubjay.operators import resolve as R
from scrubjay.operators.blocking import candidate_pairs
from scrubjay.session import cut_lineage

LEAST_LEAD = 0.5
TILE = 256
ALGORITHMS = ("weighted", "probabilistic", "vector", "hybrid")


@dataclass(frozen=True)
class MatchField:
    """One declared field; comparators ``levenshtein``, ``jaro_winkler`` and ``exact``."""

    name: str
    weight: float
    comparator: str = "levenshtein"


def match_fields(declared: list) -> list[MatchField]:
    """Fields from ``MatchField`` or ``{name, weight, comparator}``; refuses empty lists, weights that are not positive, unknown comparators."""
    fields = [f if isinstance(f, MatchField) else MatchField(**f) for f in declared or []]
    if not fields or any(f.weight <= 0 or f.comparator not in ("levenshtein", "jaro_winkler", "exact") for f in fields):
        raise ValueError("match_fields needs fields with a positive weight and a comparator of levenshtein, jaro_winkler, exact")
    return fields


def cover(fields: list[MatchField], t: float) -> list[tuple[MatchField, float, tuple[str, ...]]]:
    """Joins that together find every pair scoring ``t`` or more: (field, least similarity, heavier fields that a side lacks)."""
    rest, lacking, joins = sorted(fields, key=lambda f: -f.weight), (), []
    while rest:
        bound = 1 - (1 - t) * sum(f.weight for f in rest) / rest[0].weight
        if bound < LEAST_LEAD and len(rest) > 1:
            return joins + [(f, t, lacking) for f in rest]
        joins.append((rest[0], bound, lacking))
        lacking, rest = lacking + (rest[0].name,), rest[1:]
    return joins


def _nodes(df: DataFrame, id_col: str, fields: list[MatchField], normalize: bool) -> tuple[DataFrame, DataFrame]:
    """(``id, vid`` per record, ``vid`` and the fields per distinct tuple); vid is the tuple's smallest id."""
    value = lambda f: normalize_ws(F.col(f.name).cast("string")) if normalize and f.comparator != "exact" else F.col(f.name).cast("string")
    rec = (df.select(F.col(id_col).alias("id"), F.struct(*[value(f).alias(f.name) for f in fields]).alias("k")).filter(F.col("id").isNotNull())
           .groupBy("id").agg(F.min("k").alias("k")))
    rec = cut_lineage(rec)
    nodes = rec.groupBy("k").agg(F.min("id").alias("vid"))
    members = rec.join(nodes.withColumnRenamed("k", "k0"), F.col("k").eqNullSafe(F.col("k0"))).select("id", "vid")
    return cut_lineage(members), cut_lineage(nodes.select("vid", "k.*"))


def _field_candidates(nodes: DataFrame, f: MatchField, least: float, lacking: tuple[str, ...]) -> DataFrame:
    """``va < vb`` whose values of ``f`` are at least ``least`` alike and of which one side lacks each of ``lacking``."""
    lacks = F.array(*[F.col(c).isNull() for c in lacking]).cast("array<boolean>")
    have = nodes.filter(F.col(f.name).isNotNull()).select("vid", F.col(f.name).alias("value"), lacks.alias("no"))
    # nodes of one value that lack the same fields are a group: what no pair of two groups can lack is dropped before nodes meet
    groups = have.groupBy("value", "no").agg(F.min("vid").alias("gid"), F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"), F.count(F.lit(1)).alias("n"))
    groups = cut_lineage(groups)
    vals = groups.groupBy("value").agg(F.min("gid").alias("vid"), F.sum("n").alias("n"))
    links = vals.select(F.col("vid").alias("va"), F.col("vid").alias("vb"))  # equal values are 1 alike
    if f.comparator != "exact":
        links = links.unionByName(R.similar_values(vals.select(F.lit("").alias("blk"), "value", "vid", "n"), least, f.comparator).select("va", "vb"))
    held = have.join(groups, ["value", "no"]).select("gid", F.pmod(F.xxhash64("vid"), F.col("tiles")).cast("int").alias("tile"), "vid")
    size = groups.join(vals.select("value", "vid"), "value")
    a, b = (size.select(F.col("vid").alias(f"v{s}"), F.col("gid").alias(f"g{s}"), F.col("tiles").alias(f"n{s}"), F.col("no").alias(f"no{s}"), F.col("n").alias(f"c{s}")) for s in "ab")
    once = (F.col("va") != F.col("vb")) | (F.col("ga") < F.col("gb")) | ((F.col("ga") == F.col("gb")) & (F.col("ca") > 1))
    links = links.join(a, "va").join(b, "vb").filter(once & F.forall(F.zip_with("noa", "nob", lambda x, y: x | y), lambda z: z))
    links = links.withColumn("ta", F.explode(F.sequence(F.lit(0), F.col("na") - 1))).withColumn("tb", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    links = links.filter((F.col("ga") != F.col("gb")) | (F.col("ta") <= F.col("tb"))).select("ga", "gb", "ta", "tb")
    a, b = (held.select(F.col("gid").alias(f"g{s}"), F.col("tile").alias(f"t{s}"), F.col("vid").alias(f"v{s}")) for s in "ab")
    met = links.join(a, ["ga", "ta"]).join(b, ["gb", "tb"]).filter(F.col("va") != F.col("vb"))
    once = (F.col("ga") != F.col("gb")) | (F.col("ta") < F.col("tb")) | (F.col("va") < F.col("vb"))
    return met.filter(once).select(F.least("va", "vb").alias("va"), F.greatest("va", "vb").alias("vb"))


def _vector_candidates(df: DataFrame, members: DataFrame, id_col: str, vector_col: str, k: int) -> DataFrame:
    near = R.vector_neighbours(df, id_col, vector_col, k=k).select("id", "neighbour_id")
    a, b = members.select("id", F.col("vid").alias("x")), members.select(F.col("id").alias("neighbour_id"), F.col("vid").alias("y"))
    pairs = near.join(a, "id").join(b, "neighbour_id").filter("x <> y")
    return pairs.select(F.least("x", "y").alias("va"), F.greatest("x", "y").alias("vb"))


def link_records(df: DataFrame, id_col: str, fields: list, match: float = R.MATCH_THRESHOLD, review: float = R.REVIEW_THRESHOLD,
                 algorithm: str = "weighted", block_exprs: list[Column] | None = None, refine: Column | None = None,
                 vector_col: str | None = None, vector_top_k: int = 20, normalize: bool = True) -> tuple[DataFrame, DataFrame]:
    """(``id, vid`` per record, scored pairs ``va, vb, sim_<field>, score, decision`` of nodes from ``review`` up).

    ``algorithm``: ``weighted`` takes all candidates of ``cover``; ``vector`` takes the ``vector_top_k`` exact neighbours of each record by
    ``vector_col``; ``hybrid`` takes both; all three score by the weights. ``probabilistic`` scores the candidates of ``cover`` by the
    match probability (D7, u from random pairs). ``block_exprs`` replaces the candidates of ``cover`` by pairs that share a block key.

    Defined cases: NULL ids take no part; of rows that repeat an id the smallest tuple of fields counts; a record without any field links
    with nothing; an empty table gives none. Scores are rounded to nine digits before they are compared with the limits.
    """
    if algorithm not in ALGORITHMS:
        raise ValueError(f"algorithm must be one of {ALGORITHMS}")
    if algorithm in ("vector", "hybrid") and not vector_col:
        raise ValueError(f"algorithm={algorithm!r} needs vector_col")
    fields = match_fields(fields)
    members, nodes = _nodes(df, id_col, fields, normalize)
    found = []
    if algorithm != "vector":
        if block_exprs:
            pairs = candidate_pairs(df, id_col, block_exprs, refine=refine)
            a, b = members.select(F.col("id").alias("a"), F.col("vid").alias("x")), members.select(F.col("id").alias("b"), F.col("vid").alias("y"))
            pairs = pairs.join(a, "a").join(b, "b").filter("x <> y")
            found.append(pairs.select(F.least("x", "y").alias("va"), F.greatest("x", "y").alias("vb")))
        else:
            lacks = nodes.agg(*[F.coalesce(F.bool_or(F.col(f.name).isNull()), F.lit(False)).alias(f.name) for f in fields]).first()  # one row
            found += [_field_candidates(nodes, f, least, lacking) for f, least, lacking in cover(fields, review) if all(lacks[c] for c in lacking)]
    if algorithm in ("vector", "hybrid"):
        found.append(_vector_candidates(df, members, id_col, vector_col, vector_top_k))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    spec = [(f.name, f.comparator, f.weight) for f in fields]

    def compared(p: DataFrame) -> DataFrame:
        l, r = (nodes.select(F.col("vid").alias(f"v{s}"), *[F.col(f.name).alias(f"{side}_{f.name}") for f in fields]) for s, side in (("a", "l"), ("b", "r")))
        return R.score_pairs(p.join(l, "va").join(r, "vb"), spec)

    scored = compared(pairs.distinct())
    if algorithm == "probabilistic":
        sims = [f"sim_{f.name}" for f in fields]

        def levels(s: DataFrame) -> DataFrame:  # a field that a side lacks says nothing
            known = [F.when(F.col(f"l_{f.name}").isNotNull() & F.col(f"r_{f.name}").isNotNull(), F.col(f"sim_{f.name}")).alias(f"sim_{f.name}") for f in fields]
            return R.comparison_levels(s.select("va", "vb", *known), sims)

        out, _ = R.fellegi_sunter(levels(cut_lineage(scored)), sims, random_levels=levels(compared(R.random_pairs(nodes, "vid"))))
        scored = out.withColumn("score", F.col("match_probability"))
    scored = scored.withColumn("score", F.round("score", 9)).filter(F.col("score") >= review)
    keep = ["va", "vb", *[f"sim_{f.name}" for f in fields], "score", "decision"]
    return members, cut_lineage(R.classify_pairs(scored, "score", match, review).select(*keep))


def resolve_entities(df: DataFrame, id_col: str, fields: list, **options) -> DataFrame:
    """``df`` with ``canonical_id`` (smallest id of the entity) and flags (L1).

    Matches link; linked records are one entity. A record with a pair in the review band to another entity is flagged ``entity_review:score``.
    Records without an id keep a NULL ``canonical_id``. ``options``: see :func:`link_records`.
    """
    members, pairs = link_records(df, id_col, fields, **options)
    comp = R.connected_components(pairs.filter("decision = 'match'").select("va", "vb"), "va", "vb")
    label = members.join(comp, members["vid"] == comp["node"], "left").select("id", "vid", F.coalesce("component", "vid").alias("canonical_id"))
    label = cut_lineage(label)
    of = label.select("vid", F.col("canonical_id").alias("c")).distinct()
    doubt = pairs.filter("decision = 'review'").select("va", "vb")
    doubt = (doubt.join(of.select(F.col("vid").alias("va"), F.col("c").alias("ca")), "va")
             .join(of.select(F.col("vid").alias("vb"), F.col("c").alias("cb")), "vb").filter("ca <> cb"))
    doubt = doubt.select(F.explode(F.array("va", "vb")).alias("vid")).distinct().withColumn("__review", F.lit(True))
    label = label.join(doubt, "vid", "left").select(F.col("id").alias("__rid"), "canonical_id", "__review")
    out = df.join(label, F.col(id_col) == F.col("__rid"), "left")
    return add_flags(out, [(F.coalesce("__review", F.lit(False)), "entity_review:score")]).drop("__rid", "__review")
