"""Exact nearest neighbours by cosine (D8, F7, D9): pivot cells with triangle-inequality pruning.

Angles between unit vectors are a metric, so for a pivot p, a query q and a vector x: angle(q, x) >= |angle(q, p) - angle(x, p)|.

1. Equal vectors collapse to one (smallest id), whatever their number; only vectors with a direction take part.
2. ``PIVOTS`` pivots are fitted on a bounded sample (spherical k-means). Each vector belongs to its nearest pivot and lies in a
   ring, a bin of its angle to it. Neighbouring rings of a cell are merged, and full ones are split by id, into blocks of ``BLOCK`` vectors, or of a
   pivot's share of all vectors up to ``BLOCK_VALUES`` numbers.
   The table of rings is bounded by pivots and bins, so it can travel with the tasks; blocks grow with the rows.
3. A query first searches the sample and its own block. The k-th best cosine seen there bounds its answer; then it visits only
   the blocks whose ring may hold something at least as good. Packs of queries meet packed blocks, one matrix product for each
   meeting, and only what beats the bound comes back. For its own block a query is sent once; for all others nothing is sent: packs and blocks lie in
   the checkpoint folder, and a task reads some packs and at most about ``SHELF_VALUES`` numbers of blocks, so disk grows with the rows, also where the meetings
   grow with their square.

Every pruned block is provably too far away, so the result is exact: recall is 1 at any size. What depends on the data is the work: clustered vectors
visit few blocks, vectors without any structure (independent directions in many dimensions) visit them all, in blocks, as an exhaustive search would.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrubjay.session import cut_lineage, ship_package

PIVOTS = 32
BINS = 201  # rings of 1/64 radian
BLOCK = 4096
BLOCK_VALUES = 1 << 20  # numbers in a block at most, if it is to hold more than BLOCK vectors
SHELF_VALUES = 1 << 23  # numbers in the blocks that a task reads beside packs
PRODUCT = 1 << 22  # cosines at a time
PACK = 1024  # queries that travel together
SAMPLE_VALUES = 1 << 19  # numbers in the sample: 8192 vectors of 64 dimensions
SLACK = 1e-7
_TINY = 1e-9


def unit_rows(values: pa.Array, dim: int) -> np.ndarray:
    m = np.asarray(values.flatten(), np.float64).reshape(-1, dim)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def fit_pivots(sample: np.ndarray, pivots: int = PIVOTS, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Spherical k-means on the sample; starts from vectors far from each other."""
    rng = np.random.default_rng(seed)
    centre = sample[[rng.integers(len(sample))]]
    while len(centre) < min(pivots, len(sample)):
        far = 1 - (sample @ centre.T).max(axis=1)
        far = np.maximum(far, 0)
        if far.sum() <= _TINY:
            break
        centre = np.vstack([centre, sample[rng.choice(len(sample), p=far / far.sum())]])
    for _ in range(rounds):
        own = np.argmax(sample @ centre.T, axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, own, sample)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centre = np.where(size > _TINY, total / np.maximum(size, _TINY), centre)
    return centre


@dataclass
class Rings:
    """Blocks of each cell: ``ring[cell, bin]`` is the number of a ring, which spans bins ``lo`` to ``hi`` and has ``parts`` blocks."""

    pivots: np.ndarray
    ring: np.ndarray
    cell: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    parts: np.ndarray

    @staticmethod
    def build(pivots: np.ndarray, counts: np.ndarray, block: int) -> Rings:
        ring = np.full(counts.shape, -1, np.int64)
        rows: list[list[int]] = []
        for c in range(len(counts)):
            held = 0
            for b in np.flatnonzero(counts[c]):
                n = int(counts[c, b])
                if rows and rows[-1][0] == c and held + n <= block:
                    held += n
                    rows[-1][2] = int(b)
                else:
                    held = n
                    rows.append([c, int(b), int(b), -(-n // block)])
                ring[c, b] = len(rows) - 1
        t = np.array(rows, np.int64).reshape(-1, 4)
        return Rings(pivots, ring, t[:, 0], t[:, 1], t[:, 2], t[:, 3])

    def angles(self, unit: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(unit @ self.pivots.T, -1, 1))

    def home(self, unit: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ring and part of vectors; those in an empty bin (queries only) take the nearest ring of the cell, or the first of all."""
        a = self.angles(unit)
        cell = np.argmin(a, axis=1)
        own = self.ring[cell, _bins(a[np.arange(len(cell)), cell])]
        for i in np.flatnonzero(own < 0):
            mine = np.flatnonzero(self.cell == cell[i])
            at = a[i, cell[i]] * 64
            own[i] = mine[np.argmin(np.abs((self.lo[mine] + self.hi[mine]) / 2 - at))] if len(mine) else 0
        return own, _part(ids, self.parts[own])

    def needed(self, unit: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Whether ring (column) may hold a vector with a cosine of ``bound`` or more to a query (row)."""
        a = self.angles(unit)[:, self.cell]
        r = np.arccos(np.clip(bound - SLACK, -1, 1))[:, None]
        return (a - r <= (self.hi + 1) / 64 + SLACK) & (a + r >= self.lo / 64 - SLACK)


def _bins(angle: np.ndarray) -> np.ndarray:
    return np.minimum((angle * 64).astype(np.int64), BINS)


def _part(ids: np.ndarray, parts: np.ndarray) -> np.ndarray:
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % parts.astype(np.uint64)).astype(np.int64)


def block_size(n: int, dim: int, pivots: int) -> int:
    """Vectors in a block: ``BLOCK``, or as many as a pivot has on average while they fit ``BLOCK_VALUES``."""
    return max(BLOCK, min(-(-n // pivots), BLOCK_VALUES // dim))


def _usable(vec: Column) -> Column:
    """Vectors with a direction: no NULL or NaN inside, not empty, not all zero."""
    plain = ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & plain & F.exists(vec, lambda x: x != 0)


def _distinct(df: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame]:
    """Distinct vectors (``vid, vec``) and all rows (``id, vid``)."""
    x = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).filter(F.col("id").isNotNull() & _usable(F.col("vec")))
    reps = x.groupBy("vec").agg(F.min("id").alias("vid"), F.count(F.lit(1)).alias("n"))
    alone = reps.filter("n = 1").select(F.col("vid").alias("id"), "vid")
    more = x.join(reps.filter("n > 1"), "vec").select("id", "vid")
    return reps.select("vid", "vec"), alone.unionByName(more)


def _blocks(reps: DataFrame, rings: Rings, dim: int) -> DataFrame:
    """``block, vids, unit``: the packed vectors of each block."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ring, part = rings.home(unit_rows(b.column(1), dim), np.asarray(b.column(0)))
                yield pa.RecordBatch.from_arrays([pa.array(ring << 32 | part), b.column(0), b.column(1)], names=["block", "vid", "vec"])

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("vid")
        unit = unit_rows(t.column("vec").combine_chunks(), dim)
        return pa.table({"block": t.column("block")[:1], "vids": pa.array([np.asarray(t.column("vid")).tobytes()], pa.binary()), "unit": pa.array([unit.tobytes()], pa.binary())})

    placed = reps.mapInArrow(place, "block long, vid long, vec array<double>")
    return placed.groupBy("block").applyInArrow(pack, "block long, vids binary, unit binary")


def _route(queries: DataFrame, rings: Rings, dim: int) -> DataFrame:
    """``block, qids, bounds, queries``: packs of queries (``vid, vec, bound``) for their own block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, PACK):
                b = whole.slice(lo, PACK)
                ids, unit, bound = np.asarray(b.column(0)), unit_rows(b.column(1), dim), np.asarray(b.column(2))
                ring, part = rings.home(unit, ids)
                wanted = [(r, p, np.flatnonzero((ring == r) & (part == p))) for r, p in sorted(set(zip(ring.tolist(), part.tolist())))]
                block, *raw = zip(*[(r << 32 | p, ids[at].tobytes(), bound[at].tobytes(), unit[at].tobytes()) for r, p, at in wanted])
                yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), *[pa.array(x, pa.binary()) for x in raw]], names=["block", "qids", "bounds", "queries"])

    return queries.mapInArrow(run, "block long, qids binary, bounds binary, queries binary")


def _packs(queries: DataFrame, rings: Rings, dim: int) -> DataFrame:
    """``need, qids, bounds, queries``: packs of queries (``vid, vec, bound``) and the blocks that any of them needs beside its own.

    Queries of one block lie side by side, for they need much the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids, unit, bound = np.asarray(b.column(0)), unit_rows(b.column(1), dim), np.asarray(b.column(2))
            ring, part = rings.home(unit, ids)
            order = np.lexsort((part, ring))
            for at in (order[lo:lo + PACK] for lo in range(0, len(order), PACK)):
                need = rings.needed(unit[at], bound[at])
                wanted = [r << 32 | p for r in np.flatnonzero(need.any(axis=0)).tolist() for p in range(rings.parts[r])
                          if (need[:, r] & ~((ring[at] == r) & (part[at] == p))).any()]
                raw = [pa.array([x[at].tobytes()], pa.binary()) for x in (ids, bound, unit)]
                yield pa.RecordBatch.from_arrays([pa.array([wanted], pa.list_(pa.int64())), *raw], names=["need", "qids", "bounds", "queries"])

    return queries.mapInArrow(run, "need array<long>, qids binary, bounds binary, queries binary")


def _first(row: np.ndarray, v: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best of each row, by row."""
    order = np.lexsort((v, -np.round(score, 9), row))
    row, v, score = row[order], v[order], score[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], v[keep], score[keep]


def _beat(left: np.ndarray, right: np.ndarray, low: np.ndarray, v: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of ``left`` with up to ``k`` best of ``right`` (ids ``v``) each, at or above the rows' bounds; some rows at a time."""
    step = max(1, PRODUCT // len(v))
    for lo in range(0, len(left), step):
        s = left[lo:lo + step] @ right.T
        row, col = np.nonzero(s >= (low[lo:lo + step] - 2 * _TINY)[:, None])
        row, near, score = _first(row, v[col], s[row, col], k)
        yield lo + row, near, score


def _meet(blocks: DataFrame, packs: DataFrame, dim: int, k: int) -> DataFrame:
    """``q, v, cosine``: up to ``k`` best vectors of its own block for each query of a pack, at or above its bound."""
    both = packs.join(blocks, "block").select("qids", "bounds", "queries", "vids", "unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for qids, bounds, queries, vids, unit in zip(*(c for c in b.columns)):
                q, low, v = (np.frombuffer(x.as_buffer(), t) for x, t in ((qids, np.int64), (bounds, np.float64), (vids, np.int64)))
                left, right = (np.frombuffer(x.as_buffer(), np.float64).reshape(-1, dim) for x in (queries, unit))
                for row, near, score in _beat(left, right, low, v, k):
                    yield pa.RecordBatch.from_arrays([pa.array(q[row]), pa.array(near), pa.array(score)], names=["q", "v", "cosine"])

    return both.mapInArrow(run, "q long, v long, cosine double")


class _Search:
    """A pack that meets blocks one after the other: the best vectors so far, and the bounds they give."""

    def __init__(self, qids: pa.Scalar, bounds: pa.Scalar, queries: pa.Scalar, rings: Rings, dim: int, k: int):
        self.q, self.k = np.frombuffer(qids.as_buffer(), np.int64), k
        self.low, self.unit = np.frombuffer(bounds.as_buffer(), np.float64).copy(), np.frombuffer(queries.as_buffer(), np.float64).reshape(-1, dim)
        self.need = rings.needed(self.unit, self.low)
        ring, part = rings.home(self.unit, self.q)
        self.home = ring << 32 | part
        self.found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def meet(self, block: int, v: np.ndarray, right: np.ndarray) -> None:
        at = np.flatnonzero(self.need[:, block >> 32] & (self.home != block))
        for row, near, score in _beat(self.unit[at], right, self.low[at], v, self.k):
            row, near, score = _first(*(np.concatenate(x) for x in zip(self.found, (at[row], near, score))), self.k)
            self.found = row, near, score
            last = np.flatnonzero(np.arange(len(row)) - np.searchsorted(row, row) == self.k - 1)
            self.low[row[last]] = np.maximum(self.low[row[last]], score[last])

    def rows(self) -> pa.RecordBatch:
        row, near, score = self.found
        return pa.RecordBatch.from_arrays([pa.array(self.q[row]), pa.array(near), pa.array(score)], names=["q", "v", "cosine"])


def _search(blocks: DataFrame, packs: DataFrame, rings: Rings, dim: int, k: int) -> DataFrame:
    """``q, v, cosine``: up to ``k`` best vectors of the other blocks that a query needs, once for each partition of ``blocks``.

    Packs and blocks have a row for thousands of vectors each; both are read from checkpoints, pair by pair of partitions, and nothing is shuffled.
    """
    both = packs.join(blocks, F.array_contains("need", F.col("block"))).select("qids", "bounds", "queries", "block", "vids", "unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now = None, b""
        for b in batches:
            for qids, bounds, queries, block, vids, unit in zip(*(c for c in b.columns)):
                if at is None or now != qids.as_buffer()[:8].to_pybytes():
                    if at is not None:
                        yield at.rows()
                    at, now = _Search(qids, bounds, queries, rings, dim, k), qids.as_buffer()[:8].to_pybytes()
                at.meet(block.as_py(), np.frombuffer(vids.as_buffer(), np.int64), np.frombuffer(unit.as_buffer(), np.float64).reshape(-1, dim))
        if at is not None:
            yield at.rows()

    return both.mapInArrow(run, "q long, v long, cosine double")


def _best(found: DataFrame, k: int, key: str = "q", other: str = "v") -> DataFrame:
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.round("cosine", 9).desc(), F.col(other)))
    return found.withColumn("place", place).filter(F.col("place") <= k)


def nearest_neighbours(df: DataFrame, id_col: str, vec_col: str, k: int = 20, queries: DataFrame | None = None, pivots: int = PIVOTS,
                       block: int | None = None, sample_values: int = SAMPLE_VALUES) -> DataFrame:
    """``id, neighbour_id, rank, cosine``: the exact top ``k`` rows of ``df`` by cosine for each row of ``queries`` (default: of ``df`` itself), by (cosine to nine digits, id).

    A row is no neighbour of its own id. NULL ids and vectors without a direction (NULL, empty, zero, NaN or infinite) neither ask nor
    answer; vectors of different lengths raise; a table with fewer than ``k`` others gives what there is.
    """
    spark = df.sparkSession
    ship_package(spark)
    reps, rows = _distinct(df, id_col, vec_col)
    reps, rows = cut_lineage(reps), cut_lineage(rows)
    asked, askers = (reps, rows) if queries is None else map(cut_lineage, _distinct(queries, id_col, vec_col))
    sizes = [r for d in (reps, asked) for r in d.agg(F.min(F.size("vec")), F.max(F.size("vec"))).first() if r is not None]
    if len(set(sizes)) > 1:
        raise ValueError(f"vectors of different lengths, {min(sizes)} to {max(sizes)}")
    dim, top = (sizes[0] if sizes else 1), k + 1  # one more: a row may meet itself
    drawn = reps.select("vid", F.xxhash64("vid").alias("h")).orderBy("h", "vid").limit(max(256, sample_values // dim))  # ids only: each task sends as many
    taken = sorted(reps.join(F.broadcast(drawn), "vid").select("h", "vid", "vec").collect())
    if not taken:
        return spark.createDataFrame([], "id long, neighbour_id long, rank int, cosine double")
    sample = unit_rows(pa.array([r["vec"] for r in taken], pa.list_(pa.float64())), dim)
    centre = fit_pivots(sample, pivots)

    def first_look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The ``top``-th best cosine in the sample bounds the answer."""
        for whole in batches:
            for lo in range(0, whole.num_rows, PACK):
                b = whole.slice(lo, PACK)
                s = unit_rows(b.column(1), dim) @ sample.T
                bound = np.partition(s, -top, axis=1)[:, -top] if len(sample) >= top else np.full(b.num_rows, -1.0)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bound)], names=["vid", "vec", "bound"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                a = np.arccos(np.clip(unit_rows(b.column(1), dim) @ centre.T, -1, 1))
                cell = np.argmin(a, axis=1)
                at, n = np.unique(cell * (BINS + 1) + _bins(a[np.arange(len(cell)), cell]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(at // (BINS + 1)), pa.array(at % (BINS + 1)), pa.array(n)], names=["cell", "bin", "n"])

    counts = np.zeros((len(centre), BINS + 1), np.int64)
    for r in reps.mapInArrow(count, "cell long, bin long, n long").groupBy("cell", "bin").agg(F.sum("n").alias("n")).collect():  # pivots x bins at most
        counts[r["cell"], r["bin"]] = r["n"]
    rings = Rings.build(centre, counts, block or block_size(int(counts.sum()), dim, len(centre)))
    blocks = cut_lineage(_blocks(reps, rings, dim))
    looked = cut_lineage(asked.mapInArrow(first_look, "vid long, vec array<double>, bound double"))
    near = cut_lineage(_best(_meet(blocks, _route(looked, rings, dim), dim, top), top))
    better = near.filter(F.col("place") == top).select(F.col("q").alias("vid"), F.col("cosine").alias("seen"))
    looked = looked.join(better, "vid", "left").select("vid", "vec", F.greatest("bound", F.coalesce("seen", F.lit(-1.0))).alias("bound"))
    packs = cut_lineage(_packs(looked, rings, dim))
    tasks = 2 * spark.sparkContext.defaultParallelism
    shelves = max(-(-int(counts.sum()) * dim // SHELF_VALUES), -(-tasks // packs.rdd.getNumPartitions()))
    far = _search(blocks.coalesce(shelves), packs, rings, dim, top)
    best = _best(near.select("q", "v", "cosine").unionByName(far), top).select("q", "v", "cosine")

    # a distinct vector stands for its rows, of which the smallest ids can be among the answers
    place = F.row_number().over(Window.partitionBy("vid").orderBy("id"))
    few = rows.withColumn("p", place).filter(F.col("p") <= top).select(F.col("vid").alias("v"), F.col("id").alias("n"))
    told = _best(best.join(few, "v"), top, other="n").groupBy("q").agg(F.array_sort(F.collect_list(F.struct("place", "n", "cosine"))).alias("top"))
    per = askers.join(told, askers["vid"] == told["q"])
    mine = F.slice(F.filter("top", lambda x: x["n"] != F.col("id")), 1, k)
    return per.select("id", F.posexplode(mine).alias("at", "x")).select(
        "id", F.col("x.n").alias("neighbour_id"), (F.col("at") + 1).alias("rank"), F.round("x.cosine", 6).alias("cosine"))
