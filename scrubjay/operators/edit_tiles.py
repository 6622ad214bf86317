"""Edit-similarity candidates for low thresholds: tiles of values meet, and a bit-vector LCS rules out nearly all pairs.

Where a pair may differ by so many edits that most of its q-grams can be gone, no key brings together few others than matches: prefix
filtering then lists most pairs, and each gram of each value once per partner length. Here values are dealt into tiles of about ``TILE`` by length band, and each pair of
tiles whose bands can hold a match is one row and one unit of work. Rows and shuffled bytes stay small, a task holds two tiles, and next to nothing but matches leaves it.

A pair within ``tau`` edits has a common subsequence of ``longer - tau`` characters. Its length comes from the bit-vector recurrence
of Hyyro (64 cells a word, all patterns of a tile at once), so the filter loses no pair; the caller measures what is left.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubjay.functions.similarity import code_points
from scrubjay.session import cut_lineage, ship_package

TILE = 4096
MAX_TASKS = 4096
WORD = 64
CELLS = 1 << 22  # words of a table of characters
OUT = 1 << 16
EPS = 1e-9
_U = np.uint64


def _masks(codes: np.ndarray, size: np.ndarray, chars: np.ndarray, words: int) -> np.ndarray:
    """Bit k of ``[c, w, i]``: pattern i has character c at 64 w + k. The last row is for characters that no pattern has."""
    out = np.zeros((len(chars) + 1, words, len(size)), np.uint64)
    at = np.searchsorted(chars, codes)
    for k in range(codes.shape[1]):
        live = np.flatnonzero(size > k)
        out[at[live, k], k // WORD, live] |= _U(1) << _U(k % WORD)
    return out


def common_subsequences(codes: np.ndarray, size: np.ndarray, texts: np.ndarray, text_size: np.ndarray) -> Iterator[np.ndarray]:
    """Length of the longest common subsequence of every pattern with one text after the other."""
    chars, words, n = np.unique(codes), max(1, -(-int(size.max(initial=0)) // WORD)), len(size)
    masks = _masks(codes, size, chars, words)
    rows = [[masks[c, w] for w in range(words)] for c in range(len(chars) + 1)]
    inside = np.zeros((words, n), np.uint64)
    for w in range(words):
        bits = np.clip(size - w * WORD, 0, WORD)
        inside[w] = np.where(bits == WORD, ~_U(0), (_U(1) << (bits % WORD).astype(np.uint64)) - _U(1))
    place = np.minimum(np.searchsorted(chars, texts), len(chars) - 1)
    place[chars[place] != texts] = len(chars)
    v, u, kept = np.empty((words, n), np.uint64), np.empty(n, np.uint64), np.empty(n, np.uint64)
    for j, length in enumerate(text_size.tolist()):
        v.fill(~_U(0))
        for c in place[j, :length].tolist():
            carry = None
            for w, m in enumerate(rows[c]):  # v = (v + (v & m)) | (v & ~m), over all words
                x = v[w]
                np.bitwise_and(x, m, u)
                np.subtract(x, u, kept)
                np.add(x, u, x)
                if w + 1 < words:
                    over = x < u
                if carry is not None:
                    x += carry
                    if w + 1 < words:
                        over |= x < carry
                if w + 1 < words:
                    carry = over.astype(np.uint64)
                np.bitwise_or(x, kept, x)
        yield np.bitwise_count(~v & inside).sum(axis=0, dtype=np.int64)


def near_pairs(a: list[str], b: list[str], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of all values that can meet ``1 - lev / longer >= threshold``."""
    (ca, la), (cb, lb) = code_points(a), code_points(b)
    words = max(1, -(-ca.shape[1] // WORD))
    step = max(64, min(len(a), CELLS // (words * (len(np.unique(ca)) + 1))))
    rows, cols = [], []
    for lo in range(0, len(a), step):
        size = la[lo:lo + step]
        for j, (text, common) in enumerate(zip(lb.tolist(), common_subsequences(ca[lo:lo + step], size, cb, lb))):
            longer = np.maximum(size, text)
            hit = np.flatnonzero(longer - common <= np.floor((1 - threshold) * longer + EPS))
            rows.append(lo + hit)
            cols.append(np.full(len(hit), j))
    return (np.concatenate(rows), np.concatenate(cols)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def tile_candidates(values: DataFrame, threshold: float, tile: int = TILE) -> DataFrame:
    """``va, vb`` (va < vb): all pairs of ``values`` (``vid, blk, value, len``) that can meet the threshold, few others."""
    ship_package(values.sparkSession)
    # the lengths of a match lie in one band or in neighbouring ones
    band = F.floor(F.log("len") / -math.log(threshold) + EPS).cast("int") if threshold < 1 else F.col("len")
    v = values.filter("len > 0").select("vid", "blk", "value", band.alias("band"))
    sizes = v.groupBy("blk", "band").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("parts"))
    dealt = v.join(sizes, ["blk", "band"]).select("blk", F.struct("band", F.pmod(F.xxhash64("vid"), F.col("parts")).cast("int").alias("part")).alias("t"), "vid", "value")
    packs = cut_lineage(dealt.groupBy("blk", "t").agg(F.collect_list(F.struct("vid", "value")).alias("held")))
    mine = packs.select("blk", "t")
    near = mine.select("blk", F.col("t").alias("o"), F.explode(F.array(F.col("t.band"), F.col("t.band") - 1)).alias("band"))
    meetings = cut_lineage(mine.withColumn("band", F.col("t.band")).join(near, ["blk", "band"]).filter("t.band < o.band OR t.part <= o.part")
                           .select("blk", F.col("t").alias("t0"), F.col("o").alias("t1")))
    n = max(1, min(meetings.count(), MAX_TASKS))
    x, y = (meetings.join(packs.select("blk", F.col("t").alias(f"t{s}"), F.col("held").alias(f"h{s}")), ["blk", f"t{s}"]).repartition(n, "blk", "t0", "t1") for s in (0, 1))
    met = x.join(y, ["blk", "t0", "t1"]).select((F.col("t0") == F.col("t1")).alias("own"), "h0", "h1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, *sides in zip(*batch.columns):
                (ids0, texts0), (ids1, texts1) = (s.values.flatten() for s in sides)
                i, j = near_pairs(texts0.to_pylist(), texts1.to_pylist(), threshold)
                for lo in range(0, len(i), OUT):
                    a, b = ids0.take(pa.array(i[lo:lo + OUT])), ids1.take(pa.array(j[lo:lo + OUT]))
                    yield pa.RecordBatch.from_arrays([pa.repeat(own, len(a)), a, b], names=["own", "a", "b"])

    kind = values.schema["vid"].dataType.simpleString()
    found = met.mapInArrow(run, f"own boolean, a {kind}, b {kind}").filter("NOT own OR a < b")
    return found.select(F.least("a", "b").alias("va"), F.greatest("a", "b").alias("vb"))
