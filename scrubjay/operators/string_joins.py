"""Candidate pairs for string similarity joins, without loss and without all pairs (D1 for D2 and D3).

Both joins work on distinct values (``vid, blk, value``) and only ever join on equal keys; what a key brings together is filtered inside the join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrubjay.operators.edit_tiles import tile_candidates
from scrubjay.session import cut_lineage

EPS = 1e-9
MOST_GRAMS = 0.4
PAD_START, PAD_END = "\u0002", "\u0003"


# ---------------------------------------------------------------- edit similarity

def _edit_q(threshold: float, q: int = 3) -> int:
    """Largest q <= requested for which padded q-gram prefix filtering is lossless.

    With padding a string of length L has L + q - 1 grams and one edit
    touches at most q of them, so a pair whose longer side has length M
    shares at least M + q - 1 - q * floor((1 - t) M) grams; that must be >= 1.
    """
    while q > 1:
        if q * (1 - threshold) < 1:
            bound = 4 * q + 4
            if all(L + q - 1 - q * math.floor((1 - threshold) * L + EPS) >= 1 for L in range(1, bound + 1)):
                return q
        q -= 1
    return 1


def edit_candidates(values: DataFrame, threshold: float, q: int = 3) -> DataFrame:
    """``va, vb`` (va < vb): all pairs that can meet ``1 - lev / maxlen >= threshold``, few others.

    A pair whose longer side has length b may differ by tau = floor((1 - t) b) edits. With tau = 0 distinct values cannot match. With
    tau = 1 the keys are deletion variants, which bring together matching pairs only, so ids on a common stem cost
    no more than their matches. With more, positional q-grams (:func:`_gram_pairs`) where a prefix is at most ``MOST_GRAMS`` of the grams; a prefix
    of most grams is no filter, so below that threshold tiles of values meet (:mod:`scrubjay.operators.edit_tiles`).
    """
    if not 0.5 < threshold <= 1.0:
        raise ValueError("edit-similarity join needs 0.5 < threshold <= 1")
    v = values.select("vid", "blk", "value", F.length("value").alias("len"))
    q = _edit_q(threshold, q)
    if q * (1 - threshold) <= MOST_GRAMS:
        return _one_edit_pairs(v, threshold).unionByName(_gram_pairs(v, threshold, q))
    return tile_candidates(v, threshold)


def _budget(length: Column, threshold: float) -> Column:
    return F.floor((1 - threshold) * length + EPS)


def _one_edit_pairs(v: DataFrame, threshold: float) -> DataFrame:
    """Pairs one edit apart whose longer side has a budget of one.

    Equal lengths: both lack the same position once the differing character is gone, and for that position only, so a pair leaves the join once.
    Lengths b - 1 and b: the shorter is a deletion variant of the longer; equal variants of one value count once.
    """
    def without(i: Column) -> Column:
        return F.concat(F.substring(F.col("value"), F.lit(1), i - 1), F.substring(F.col("value"), i + 1, F.col("len")))

    places = F.sequence(F.lit(1), F.col("len"))
    one = v.filter((F.col("len") > 0) & (_budget(F.col("len"), threshold) == 1))
    same = one.select("vid", "blk", "len", F.explode(F.transform(places, lambda i: F.xxhash64(without(i), i))).alias("key"))
    a, b = (same.select(F.col("vid").alias(x), "blk", "len", "key") for x in ("va", "vb"))
    equal = a.join(b, ["blk", "len", "key"]).filter("va < vb").select("va", "vb")
    long = one.select(F.col("vid").alias("x"), "blk", "len", F.explode(F.array_distinct(F.transform(places, lambda i: F.xxhash64(without(i))))).alias("key"))
    short = v.filter(_budget(F.col("len") + 1, threshold) == 1).select(F.col("vid").alias("y"), "blk", (F.col("len") + 1).alias("len"), F.xxhash64("value").alias("key"))
    apart = long.join(short, ["blk", "len", "key"]).select(F.least("x", "y").alias("va"), F.greatest("x", "y").alias("vb"))
    return equal.unionByName(apart)


def _gram_pairs(v: DataFrame, threshold: float, q: int) -> DataFrame:
    """Pairs with a budget of two edits or more, from positional q-gram prefixes.

    tau edits touch at most q * tau grams of the longer side and q * tau - (b - a) of the shorter, and shift what they leave by at most tau. So of that many
    plus one rarest grams (all that tie with the last one included) the two sides share one, at places at most tau apart. Each value
    emits one prefix per partner length that occurs in the data, tagged with the (shorter, longer) length pair.
    """
    lengths = v.select(F.col("len").alias("partner")).distinct()
    v = v.filter(_budget(F.floor(F.col("len") / threshold + EPS), threshold) >= 2)
    window = F.sequence(F.ceil(F.col("len") * threshold - EPS).cast("int"), F.floor(F.col("len") / threshold + EPS).cast("int"))
    longer = F.greatest("len", "partner")
    cls = (v.select("vid", "len", F.explode(window).alias("partner")).join(lengths, "partner")
           .select("vid", F.least("len", "partner").alias("lo"), longer.alias("hi"), _budget(longer, threshold).cast("int").alias("tau"),
                   (F.col("len") - longer + q * _budget(longer, threshold) + 1).alias("plen")).filter("tau >= 2"))
    pad = F.concat(F.lit(PAD_START * (q - 1)), F.col("value"), F.lit(PAD_END * (q - 1)))
    x = v.select("vid", "blk", "len", pad.alias("__p"))
    starts = F.sequence(F.lit(1), F.greatest(F.length("__p") - q + 1, F.lit(1)))
    t = x.select("vid", "blk", "len", F.posexplode(F.transform(starts, lambda i: F.substring(F.col("__p"), i, F.lit(q)))).alias("pos", "g"))
    freq = t.groupBy("blk", "g").agg(F.count(F.lit(1)).alias("f"))
    ranked = t.join(freq, ["blk", "g"]).withColumn("rank", F.rank().over(Window.partitionBy("vid").orderBy("f", "g")))
    pre = cut_lineage(ranked.join(cls, "vid").filter(F.col("rank") <= F.col("plen")).select("vid", "blk", "len", "pos", "g", "lo", "hi", "tau"))
    a, b = (pre.select(F.col("vid").alias(n), "blk", F.col("len").alias(f"l{n}"), F.col("pos").alias(f"p{n}"), "g", "lo", "hi", "tau") for n in ("va", "vb"))
    j = a.join(b, ["blk", "g", "lo", "hi", "tau"]).filter(
        (F.col("va") < F.col("vb")) & (F.col("lva") + F.col("lvb") == F.col("lo") + F.col("hi")) & (F.abs(F.col("pva") - F.col("pvb")) <= F.col("tau")))
    return j.select("va", "vb").distinct()


# ---------------------------------------------------------------- Jaro-Winkler

JW_PREFIX = 4  # Winkler adds 0.1 * (1 - jaro) per character of the common prefix, up to four
SHARED = 3  # characters of a key


def _tags(value: Column) -> Column:
    """Characters of a value with their occurrence number: equal multisets give equal sets."""
    chars = F.split(value, "")
    n = F.sequence(F.lit(1), F.size(chars))
    return F.when(F.length(value) == 0, F.array().cast("array<string>")).otherwise(F.transform(n, lambda i: F.concat(
        F.element_at(chars, i), F.size(F.filter(F.slice(chars, 1, i), lambda c: c == F.element_at(chars, i))).cast("string"))))


def jaro_winkler_candidates(values: DataFrame, threshold: float) -> DataFrame:
    """``va, vb`` (va < vb): all pairs that can meet Jaro-Winkler >= threshold.

    A pair with a common prefix of exactly l characters needs Jaro >= J = (t - l/10) / (1 - l/10), hence at least
    alpha = (3J - 1) |a| |b| / (|a| + |b|) shared characters. So pairs are sought by l: the prefix is part of the key, and the weak bounds of long prefixes hold only
    among values that share them. Of two values that share alpha characters, the rarest |s| - alpha + e of each share e: the keys are all sets of e = ``SHARED``
    of these (fewer where alpha is smaller), tagged with the pair of lengths.
    What meets is then held against the bound itself, on all shared characters.
    """
    v = values.select("vid", "blk", "value", F.length("value").alias("len")).filter("len > 0").withColumn("tags", _tags(F.col("value")))
    lengths = v.select(F.col("len").alias("partner")).distinct()
    freq = v.select("blk", F.explode("tags").alias("tag")).groupBy("blk", "tag").agg(F.count(F.lit(1)).alias("f"))
    rare = (v.select("vid", "blk", F.explode("tags").alias("tag")).join(freq, ["blk", "tag"])
            .groupBy("vid").agg(F.sort_array(F.collect_list(F.struct("f", "tag"))).alias("r")).select("vid", F.col("r.tag").alias("rare")))
    v = cut_lineage(v.join(rare, "vid"))

    # one row per prefix length l: its Jaro bound, and the ratio min / max of the lengths (all characters of the shorter side matched: >= 3J - 2)
    bounds = [max((threshold - l / 10) / (1 - l / 10), 0.0) for l in range(JW_PREFIX + 1)]
    cls = v.withColumn("l", F.explode(F.sequence(F.lit(0), F.least(F.lit(JW_PREFIX), "len")))).withColumn("prefix", F.substring("value", F.lit(1), F.col("l")))
    cls = cls.withColumn("j", F.element_at(F.array(*[F.lit(x) for x in bounds]), F.col("l") + 1)).withColumn("ratio", F.greatest(3 * F.col("j") - 2, F.lit(0.0)))
    near = F.col("ratio") > 0  # else the threshold leaves lengths free: they are no part of the key
    window = F.when(near, F.sequence(F.ceil(F.col("len") * F.col("ratio") - EPS).cast("int"), F.floor(F.col("len") / F.greatest("ratio", F.lit(EPS)) + EPS).cast("int")))
    cls = cls.withColumn("partner", F.explode(F.coalesce(window, F.array("len")))).join(lengths, "partner")
    n, m = F.col("len").cast("double"), F.col("partner").cast("double")
    alpha = F.when(near, F.greatest(F.lit(1), F.ceil((3 * F.col("j") - 1) * n * m / (n + m) - EPS).cast("int"))).otherwise(1)
    cls = cls.withColumn("alpha", alpha).filter(F.col("alpha") <= F.least("len", "partner")).withColumn("e", F.least(F.lit(SHARED), "alpha"))
    few = F.slice("rare", F.lit(1), F.col("len") - F.col("alpha") + F.col("e"))
    cls = cls.select("vid", "blk", "value", "tags", "len", "l", "prefix", "e", F.array_sort(few).alias("s"),  # sorted: a set has one spelling
                     F.when(near, F.least("len", "partner")).otherwise(0).alias("lo"), F.when(near, F.greatest("len", "partner")).otherwise(0).alias("hi"))
    keyed = cls.select("vid", "blk", "value", "tags", "len", "l", "prefix", "lo", "hi", F.explode(_subsets()).alias("key"))
    a, b = (keyed.select("blk", "l", "prefix", "lo", "hi", "key", F.col("vid").alias(f"v{x}"), F.col("value").alias(f"s{x}"), F.col("tags").alias(f"t{x}"), F.col("len").alias(f"l{x}")) for x in "ab")
    fits = (F.col("hi") == 0) | (F.col("la") + F.col("lb") == F.col("lo") + F.col("hi"))
    nxt = F.col("l") + 1
    exact = (F.col("l") == JW_PREFIX) | (F.least("la", "lb") == F.col("l")) | (F.substring("sa", nxt, F.lit(1)) != F.substring("sb", nxt, F.lit(1)))
    shared = F.size(F.array_intersect("ta", "tb"))
    most = (shared / F.col("la") + shared / F.col("lb") + 1) / 3  # Jaro if all shared characters match in order
    enough = F.when(most <= 0.7, most).otherwise(most + F.col("l") * 0.1 * (1 - most)) >= threshold - EPS
    hit = a.join(b, ["blk", "l", "prefix", "lo", "hi", "key"]).filter((F.col("va") < F.col("vb")) & fits & exact & enough)
    return hit.select("va", "vb").distinct()


def _subsets() -> Column:
    """Hashes of all sets of ``e`` (1 to 3) of the characters ``s``."""
    nth = lambda i: F.element_at(F.col("s"), i)
    upto = lambda i: F.when(i <= F.size("s"), F.sequence(i, F.size("s"))).otherwise(F.array().cast("array<int>"))
    ones = F.transform(upto(F.lit(1)), lambda x: F.xxhash64(nth(x)))
    twos = F.flatten(F.transform(upto(F.lit(1)), lambda x: F.transform(upto(x + 1), lambda y: F.xxhash64(nth(x), nth(y)))))
    threes = F.flatten(F.transform(upto(F.lit(1)), lambda x: F.flatten(F.transform(upto(x + 1), lambda y: F.transform(upto(y + 1), lambda z: F.xxhash64(nth(x), nth(y), nth(z)))))))
    return F.when(F.col("e") == 1, ones).when(F.col("e") == 2, twos).otherwise(threes)
