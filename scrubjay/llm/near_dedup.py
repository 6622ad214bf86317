"""Near-duplicate documents: one-permutation MinHash with optimal densification,
banded buckets and star-shaped candidate edges, confirmed on the full sets.

1. One scan hashes the word shingles of each text (64 bit) and deals them by
   hash into ``bands * rows`` bins; a bin's value is its smallest hash (Li et al.
   2012). An empty bin borrows from the first non-empty bin of a fixed random
   probe sequence (Shrivastava 2017), so equal probes meet equal bins in similar
   sets and short texts keep their full recall.
2. Documents with equal sets (128-bit fingerprint of the whole set) form a class; the
   smallest id stands for it. A class may hold any share of the rows: it is found by
   a grouped minimum with map-side combine.
3. Each band of each representative is a bucket key. A bucket links its members
   to its smallest member only (a star): pairs grow with the members, never with
   their square.
4. A star misses a pair of which neither is the centre. So buckets that still hold more
   than one component get further stars from other centres, of which each pair of components
   tries its most alike pair; when a round joins fewer than one in ``POOR_ROUND`` of its pairs, or after ``STAR_ROUNDS``, the rest gets an
   exact look in tiles (``links_in_tiles``): the members of a bucket outside its largest component meet one another and that
   component, tile against tile in a task. Tiles grow with the bucket, so a member has about ``TILES`` copies whatever the
   bucket's size, up to ``TILES * MOST_TILES * TILE`` members; only the comparisons inside a task go by the square. Pairs across components that pass a coarse (252 bits) and a fine
   (252 times 4 bits) sketch test stay in the task, in lists by member, each pair in its first shared bucket; then the full sets of these members
   meet in the same tiles, and only confirmed links leave. No join emits candidate pairs, whatever the bucket.
5. Every pair is confirmed on the two full shingle sets by
   ``100 * intersection >= percent * union``; components are resolved by star rounds.

With 42 bands of 6 rows a pair with similarity 0.8 is missed with probability
(1 - 0.8^6)^42 = 3e-6. The sketch tests ask for at least ``SKETCH_MIN`` of 252 equal low
bits and ``FINE_MIN`` of 252 equal 4-bit values, five standard deviations below the mean at similarity 0.8.
In sets of five shingles two may fall into one bin; of simulated pairs at 4/5 0.02 % fail the fine test for it and none the coarse one.

Defined cases: null, empty and blank texts have an empty set, n_shingles 0 and
no link; a text with fewer words than the shingle has its whole sequence as
its one shingle; rows with a null id link with nothing, have a null component
and are kept; rows that repeat an id are one node, each returned; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubjay.llm.textbytes import Chunk, chunks, mix, owners, span_hashes, window_hashes, word_bounds
from scrubjay.operators.resolve import connected_components
from scrubjay.session import cut_counted, cut_lineage, few_tasks, ship_package

BANDS, ROWS = 42, 6
STAR_ROUNDS = 4
SKETCH_MIN = 202
FINE_MIN, FINE_WORDS = 173, 16
#: A round of stars that joins fewer than one in this many of the pairs it tries is the last.
POOR_ROUND = 50
#: Members of a tile, and shingles (8 bytes each) whose sets one task holds at a time (more if two sets alone exceed it).
TILE, UNIT_SHINGLES = 512, 2_000_000
#: Tiles of a bucket with more than ``TILES * TILE`` members; they are up to ``MOST_TILES`` times larger (370 bytes a member), then more.
TILES, MOST_TILES = 8, 64
#: Ids that are broadcast at most (8 bytes each); beyond, the texts are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Pairs with both their sets that one task takes at least.
PAIRS_A_TASK = 1024
_U = np.uint64
_EMPTY = np.iinfo(np.uint64).max


@cache
def _probe_table(bins: int, depth: int = 1024) -> np.ndarray:
    """probe[j, a]: the bin that empty bin j asks at attempt a. The last resort is a
    walk over all bins, so a non-empty set always fills every bin; its bins fill alike, so few sets may come to it:
    of four values or more, less than one bin in 10^7 does."""
    r = np.random.default_rng(911)
    return np.concatenate([r.integers(0, bins, (bins, depth)),
                           (np.arange(bins)[:, None] + np.arange(1, bins)[None, :]) % bins], axis=1)


def shingle_sets(c: Chunk, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the documents of a chunk, sorted by document and
    hash: ``(hashes, first)`` with document i owning hashes[first[i]:first[i+1]]."""
    ws, we, first = word_bounds(c)
    h = span_hashes(c.buf, ws, we, lower=True)
    doc, n_words = owners(first), np.diff(first)
    if len(h) >= width:
        inside = np.flatnonzero(doc[:len(h) - width + 1] == doc[width - 1:])
        sh, sdoc = window_hashes(h, width)[inside], doc[inside]
    else:
        sh, sdoc = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((n_words > 0) & (n_words < width))
    if len(short):  # the whole sequence; salted by its length, so it never equals a full shingle
        whole = np.array([_fold(h[first[i]:first[i + 1]]) for i in short], np.uint64)
        sh, sdoc = np.concatenate([sh, whole]), np.concatenate([sdoc, short])
    order = np.argsort(sh)
    order = order[np.argsort(sdoc[order].astype(np.uint16), kind="stable")]
    sh, sdoc = sh[order], sdoc[order]
    new = np.ones(len(sh), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (sdoc[1:] != sdoc[:-1])
    sh, sdoc = sh[new], sdoc[new]
    return sh, np.searchsorted(sdoc, np.arange(c.n + 1))


def _fold(words: np.ndarray) -> int:
    out = _U(len(words))
    for w in words:
        out = mix(np.array([out], np.uint64) * _U(0x9E3779B97F4A7C15) + w)[0]
    return int(mix(np.array([out + _U(1)], np.uint64))[0])


def signatures(sh: np.ndarray, first: np.ndarray, bins: int) -> np.ndarray:
    """Densified one-permutation signatures, one row of ``bins`` values per non-empty set."""
    n = len(first) - 1
    sig = np.full((n, bins), _EMPTY, np.uint64)
    h = mix(sh)
    cell = owners(first) * bins + ((h >> _U(32)) * _U(bins) >> _U(32)).astype(np.int64)
    np.minimum.at(sig.reshape(-1), cell, mix(h))
    probe = _probe_table(bins)
    rows = np.flatnonzero(np.diff(first) > 0)
    sig = sig[rows]
    i, j = np.nonzero(sig == _EMPTY)
    source = sig.copy()
    for a in range(probe.shape[1]):
        if not len(i):
            break
        got = source[i, probe[j, a]]
        sig[i, j] = mix(got + _U(a + 1))  # the attempt is part of the value
        left = got == _EMPTY
        i, j = i[left], j[left]
    return sig


_SIG_SCHEMA = "id long, n_shingles long, fp1 long, fp2 long, bands array<long>, s0 long, s1 long, s2 long, s3 long, fine array<long>"


def signature_rows(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """``_SIG_SCHEMA`` per document (``id, text`` in). The sketch is null and bands are empty for empty sets."""
    bins = bands * rows
    if bins > 256:
        raise ValueError("bands * rows must not exceed 256, the size of the sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b.column(1)):
                sh, first = shingle_sets(c, width)
                some = np.flatnonzero(np.diff(first) > 0)
                sig = signatures(sh, first, bins)
                keys = np.zeros((len(some), bands), np.uint64)
                for r in range(rows):
                    keys = mix(keys * _U(3) + sig[:, r::rows][:, :bands])
                keys = mix(keys + np.arange(bands, dtype=np.uint64)[None, :] * _U(0xD1342543DE82EF95))
                bits = np.zeros((len(some), 256), np.uint8)
                bits[:, :bins] = (mix(sig) & _U(1)).astype(np.uint8)
                words = np.packbits(bits, axis=1).view(np.uint64)
                nibbles = np.zeros((len(some), 256), np.uint8)
                nibbles[:, :bins] = (mix(sig) >> _U(1) & _U(15)).astype(np.uint8)
                fine = (nibbles[:, ::2] << 4 | nibbles[:, 1::2]).view(np.uint64)
                f1, f2 = (np.zeros(len(some), np.uint64) for _ in range(2))
                if len(some):
                    starts = first[:-1][some]
                    f1, f2 = np.add.reduceat(mix(sh), starts), np.bitwise_xor.reduceat(mix(sh ^ _U(0xA5A5A5A5A5A5A5A5)), starts)

                def put(values: np.ndarray) -> pa.Array:
                    out = np.zeros(c.n, np.int64)
                    out[some] = values.view(np.int64)
                    mask = np.ones(c.n, bool)
                    mask[some] = False
                    return pa.array(out, mask=mask)

                def lists(values: np.ndarray) -> pa.Array:
                    filled = np.zeros(c.n + 1, np.int64)
                    filled[some + 1] = values.shape[1]
                    return pa.ListArray.from_arrays(pa.array(np.cumsum(filled).astype(np.int32)), pa.array(values.reshape(-1).view(np.int64)))

                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(c.lo, c.n), pa.array(np.diff(first).astype(np.int64)), put(f1), put(f2), lists(keys),
                     *[put(np.ascontiguousarray(words[:, k])) for k in range(4)], lists(fine)],
                    names=["id", "n_shingles", "fp1", "fp2", "bands", "s0", "s1", "s2", "s3", "fine"])

    return docs.mapInArrow(run, _SIG_SCHEMA)


def _set_rows(docs: DataFrame, width: int) -> DataFrame:
    """``id, hs``: the sorted distinct shingle hashes of each text, as little-endian bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b.column(1)):
                sh, first = shingle_sets(c, width)
                raw = [sh[s:e].tobytes() for s, e in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(c.lo, c.n), pa.array(raw, pa.binary())], names=["id", "hs"])

    return docs.mapInArrow(run, "id long, hs binary")


def _named_sets(ids: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """``id, hs`` of the documents in ``ids`` (distinct): their texts are hashed again."""
    named, n = cut_counted(ids)
    if n <= BROADCAST_IDS:  # the texts need not be shuffled
        named = F.broadcast(named)
    return _set_rows(texts.join(named, "id", "left_semi").select("id", "text"), width)


def _confirm(pairs: DataFrame, n: int, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the ``n`` pairs whose full shingle sets meet ``100 * intersection >= percent * union``.

    Only the texts named by a pair are hashed again; each pair then fetches its two sets.
    """
    named = few_tasks(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))), 2 * n).distinct()
    sets = _named_sets(few_tasks(named, 2 * n), texts, width)
    j = few_tasks(pairs.join(sets.select(F.col("id").alias("a"), F.col("hs").alias("ha")), "a"), n, PAIRS_A_TASK)
    j = few_tasks(j.join(sets.select(F.col("id").alias("b"), F.col("hs").alias("hb")), "b").select("a", "b", "ha", "hb"), n, PAIRS_A_TASK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            ha, hb = batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                x, y = np.frombuffer(ha[i].as_buffer(), np.uint64), np.frombuffer(hb[i].as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]))
                same = int((both[1:] == both[:-1]).sum())
                keep[i] = 100 * same >= percent * (len(x) + len(y) - same)
            at = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])

    return j.mapInArrow(run, "a long, b long")


def _differ(a: str, b: str):
    """Number of sketch bits in which two representatives differ."""
    return sum((F.bit_count(F.col(f"{a}.s{k}").bitwiseXOR(F.col(f"{b}.s{k}"))) for k in range(4)), F.lit(0))


def _sketch(a: str, b: str, percent: int):
    """Size bound (exact) and sketch agreement of two representatives."""
    small, large = F.least(f"{a}.n_shingles", f"{b}.n_shingles"), F.greatest(f"{a}.n_shingles", f"{b}.n_shingles")
    return (100 * small >= percent * large) & (_differ(a, b) <= 252 - SKETCH_MIN)


def _units(placed: DataFrame) -> DataFrame:
    """``key, id, comp, unit, side`` for the members (``key, id, comp``) of buckets that hold several components.

    A bucket of up to ``TILE`` members is one unit (side 2: all meet all). In a larger one the members of the most frequent component and the
    others are dealt into tiles; the others' tiles meet one another and each tile of that component (side 0 meets side 1). Tiles of a large bucket are larger, not more.
    """
    sizes = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(
        F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("main"), F.count(F.lit(1)).alias("comps")).filter("comps > 1 and n > 2")
    is_main = F.col("comp") == F.col("main.comp")
    size = F.least(F.lit(MOST_TILES * TILE), F.greatest(F.lit(TILE), F.ceil(F.col("n") / F.lit(TILES))))
    others, mains = (F.ceil(x / size).cast("int") for x in (F.col("n") - F.col("main.n"), F.col("main.n")))
    m = (placed.join(sizes, "key").withColumn("others", others).withColumn("mains", mains)
         .withColumn("t", F.pmod(F.xxhash64("id", F.lit("tile")), F.when(is_main, F.col("mains")).otherwise(F.col("others"))).cast("int")))

    def place(kind: int, i, j, side):
        return F.struct(F.xxhash64("key", F.lit(kind), i, j).alias("unit"), side.cast("int").alias("side"))

    each_other, each_main = F.sequence(F.lit(0), F.col("others") - 1), F.sequence(F.lit(0), F.col("mains") - 1)
    places = (F.when(F.col("n") <= TILE, F.array(place(0, F.lit(0), F.lit(0), F.lit(2))))
              .when(is_main, F.transform(each_other, lambda o: place(1, o, F.col("t"), F.lit(1))))
              .otherwise(F.concat(
                  F.transform(each_other, lambda o: place(0, F.least(o, F.col("t")), F.greatest(o, F.col("t")), F.when(
                      o == F.col("t"), 2).when(F.col("t") < o, 0).otherwise(1))),
                  F.transform(each_main, lambda j: place(1, F.col("t"), j, F.lit(0))))))
    return m.select("key", "id", "comp", F.explode_outer(places).alias("p")).select("key", "id", "comp", "p.*")


def _by_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of equal first column, which follow one another, as one table each."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        u = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(u[1:] != u[:-1]) + 1).tolist(), len(u)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if held and held[0].column(0)[0].as_py() != u[lo]:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _unit_pairs(t: pa.Table, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the pairs of a unit that the sketches cannot tell from a link, each in its first shared bucket.

    ``TILE`` rows meet ``TILE`` rows at a time; what they give is gathered up to ``TILE ** 2`` pairs or more.
    """
    n = t.num_rows
    side, comp, size = (t[c].to_numpy() for c in ("side", "comp", "n_shingles"))
    sketch, fine, bands = _matrix(t["sketch"], n).view(np.uint64), _matrix(t["fine"], n).view(np.uint64), _matrix(t["bands"], n)
    key, low = t["key"].to_numpy() >> 32, _U(0x1111111111111111)
    lefts, rights = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    held, n_held = [], 0
    for left in (lefts[k:k + TILE] for k in range(0, len(lefts), TILE)):
        for right in (rights[k:k + TILE] for k in range(0, len(rights), TILE)):
            x, y = left[:, None], right[None, :]
            open_ = (comp[x] != comp[y]) & ((side[x] != side[y]) | (x < y))
            open_ &= 100 * np.minimum(size[x], size[y]) >= percent * np.maximum(size[x], size[y])
            i, j = np.nonzero(open_)
            i, j = left[i], right[j]
            for lo in range(0, len(i), 1 << 15):
                a, b = i[lo:lo + (1 << 15)], j[lo:lo + (1 << 15)]
                ok = np.bitwise_count(sketch[a] ^ sketch[b]).sum(axis=1) <= 252 - SKETCH_MIN
                a, b = a[ok], b[ok]
                z = fine[a] ^ fine[b]
                z |= z >> _U(1)
                z |= z >> _U(2)
                ok = np.bitwise_count(z & low).sum(axis=1) <= 252 - FINE_MIN
                a, b = a[ok], b[ok]
                same = bands[a] == bands[b]
                ok = bands[a, same.argmax(axis=1)] == key[a]
                held.append((a[ok], b[ok]))
                n_held += len(held[-1][0])
            if n_held >= TILE ** 2:
                yield tuple(np.concatenate(c) for c in zip(*held))
                held, n_held = [], 0
    if n_held:
        yield tuple(np.concatenate(c) for c in zip(*held))


def links_in_tiles(placed: DataFrame, reps: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Confirmed links ``a, b`` between the components of a bucket, at least one for each two components that have any there.

    ``placed`` (key, id, comp) are the members of the buckets, ``reps`` their sketches. Bands are compared by their upper 32 bits.
    """
    sketches = reps.select("id", "n_shingles", F.array("s0", "s1", "s2", "s3").alias("sketch"), "fine",
                           F.transform("bands", lambda k: F.shiftright(k, 32).cast("int")).alias("bands"))
    rows = _units(placed).join(sketches, "id")
    rows = rows.select("unit", "side", "key", "id", "comp", "n_shingles", "sketch", "fine", "bands").repartition("unit").sortWithinPartitions("unit", "id", "side")

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_unit(batches):
            ids, comp, size, unit = (t[c].to_numpy() for c in ("id", "comp", "n_shingles", "unit"))
            part = 0
            for i, j in _unit_pairs(t, percent):
                weight, seen, cuts = 0, set(), [0]
                if size[np.unique(np.concatenate([i, j]))].sum() > UNIT_SHINGLES:
                    for k, pair in enumerate(zip(i.tolist(), j.tolist())):
                        new = [r for r in pair if r not in seen]
                        if seen and weight + sum(size[r] for r in new) > UNIT_SHINGLES:
                            cuts.append(k)
                            weight, seen, new = 0, set(), list(pair)
                        seen.update(new)
                        weight += int(sum(size[r] for r in new))
                for lo, hi in zip(cuts, [*cuts[1:], len(i)]):
                    partners: dict[int, list[int]] = {r: [] for r in np.unique(np.concatenate([i[lo:hi], j[lo:hi]])).tolist()}
                    for r, q in zip(i[lo:hi].tolist(), j[lo:hi].tolist()):
                        partners[r].append(int(ids[q]))
                    at = np.array(list(partners), np.int64)
                    label = mix(unit[:1].view(np.uint64) + _U(part)).view(np.int64)[0]
                    part += 1
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), label)), pa.array(ids[at]), pa.array(comp[at]),
                                                      pa.array(list(partners.values()), pa.list_(pa.int64()))], names=["unit", "id", "comp", "partners"])

    found, n = cut_counted(rows.mapInArrow(candidates, "unit long, id long, comp long, partners array<long>"))
    if not n:
        return found.select(F.col("id").alias("a"), F.col("id").alias("b"))
    sets = _named_sets(few_tasks(found.select("id").distinct(), n), texts, width)
    full = found.join(sets, "id").select("unit", "id", "comp", "partners", "hs").repartition("unit").sortWithinPartitions("unit", "id")

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_unit(batches):
            ids, comp = t["id"].to_pylist(), t["comp"].to_pylist()
            held: dict[int, list[np.ndarray]] = {}  # a repeated id may have several sets
            sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in t["hs"]]
            for doc, hs in zip(ids, sets):
                held.setdefault(doc, []).append(hs)
            comp_of, linked, links = dict(zip(ids, comp)), set(), []
            for doc, c, hs, others in zip(ids, comp, sets, t["partners"].to_pylist()):
                ends = [(o, s) for o in others for s in held[o] if (min(c, comp_of[o]), max(c, comp_of[o])) not in linked]
                if not ends or not len(hs):
                    continue
                sizes = np.array([len(s) for _, s in ends])
                joined = np.concatenate([s for _, s in ends])
                at = np.minimum(np.searchsorted(hs, joined), len(hs) - 1)
                same = np.add.reduceat((hs[at] == joined).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
                for k in np.flatnonzero(100 * same >= percent * (len(hs) + sizes - same)):
                    other = ends[k][0]
                    two = (min(c, comp_of[other]), max(c, comp_of[other]))
                    if two not in linked:
                        linked.add(two)
                        links.append((min(doc, other), max(doc, other)))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in links], pa.int64()), pa.array([p[1] for p in links], pa.int64())], names=["a", "b"])

    return full.mapInArrow(confirmed, "a long, b long")


def _merge(nodes: DataFrame, n: int, found: DataFrame) -> DataFrame:
    """``id, comp`` of the ``n`` nodes after the links ``found`` (a, b): components are joined as nodes of a graph of their own."""
    ends = (found.join(nodes.select(F.col("id").alias("a"), F.col("comp").alias("ca")), "a")
            .join(nodes.select(F.col("id").alias("b"), F.col("comp").alias("cb")), "b"))
    label = connected_components(ends, "ca", "cb")
    merged = nodes.join(label, nodes["comp"] == label["node"], "left").select("id", F.coalesce("component", "comp").alias("comp"))
    return few_tasks(cut_lineage(few_tasks(merged, n)), n)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80,
                    width: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``<id>, n_shingles, component_id, kept`` per document; see the module text."""
    if percent < 80:
        raise ValueError("bands, rows and sketch are set for percent >= 80")
    spark = docs.sparkSession
    ship_package(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sig = cut_lineage(signature_rows(texts, width, bands, rows))
    real = sig.filter("n_shingles > 0 and id is not null")
    reps = cut_lineage(real.groupBy("fp1", "fp2", "n_shingles").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("members"),
        *[F.first(k).alias(k) for k in ("s0", "s1", "s2", "s3", "bands", "fine")]))
    entries = reps.select("id", F.explode("bands").alias("key"))

    # round 1: stars; what follows reads the members of shared buckets alone, and each table in no more tasks than it needs
    centres = entries.groupBy("key").agg(F.min("id").alias("centre"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "centre", (F.col("n") > 2).alias("many"))
    crowded, n = cut_counted(entries.join(centres, "key"))
    nodes, n_nodes = cut_counted(few_tasks(crowded.select("id").distinct(), n))
    sketch = cut_lineage(reps.select("id", "n_shingles", "s0", "s1", "s2", "s3").join(nodes, "id", "left_semi"))
    sketch = few_tasks(sketch, n_nodes)

    def alike(star: DataFrame) -> DataFrame:
        return few_tasks(few_tasks(star.join(sketch.select(F.col("id").alias("a"), F.struct("*").alias("x")), "a"), n)
                         .join(sketch.select(F.col("id").alias("b"), F.struct("*").alias("y")), "b"), n).filter(_sketch("x", "y", percent))

    star = few_tasks(crowded.filter("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct(), n)
    links, _ = cut_counted(_confirm(*cut_counted(alike(star).select("a", "b")), texts, width, percent))
    nodes = nodes.join(connected_components(links, "a", "b").withColumnRenamed("node", "id"), "id", "left").select(
        "id", F.coalesce("component", "id").alias("comp"))
    nodes = few_tasks(cut_lineage(few_tasks(nodes, n_nodes)), n_nodes)

    # more stars: only between components, from another centre in each bucket; two members alone have met
    crowded, last = crowded.filter("many"), None
    for r in range(STAR_ROUNDS + 1):
        # read twice below, so the join is not left to run twice
        placed = few_tasks(cut_lineage(few_tasks(crowded.select("key", "id").join(nodes, "id"), n)), n)
        mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(
            F.struct(F.xxhash64("key", "id", F.lit(r)).alias("draw"), "id", "comp")).alias("c")).filter("lo <> hi").select("key", "c")
        crowded, n = cut_counted(few_tasks(placed.join(mixed, "key").select("key", "id", "comp", "c"), n))
        if not n or r == STAR_ROUNDS:
            break
        star = few_tasks(crowded.filter("comp <> c.comp").select(
            F.col("c.id").alias("a"), F.col("id").alias("b"), F.col("c.comp").alias("ca"), F.col("comp").alias("cb")).distinct(), n)
        # two components need one link: try their most alike pair
        best = alike(star).groupBy(F.least("ca", "cb").alias("c1"), F.greatest("ca", "cb").alias("c2")).agg(
            F.min(F.struct(_differ("x", "y").alias("d"), "a", "b")).alias("p"))
        pairs, n_pairs = cut_counted(few_tasks(best.select("p.a", "p.b"), n))
        if not n_pairs:
            break
        found, n_found = cut_counted(_confirm(pairs, n_pairs, texts, width, percent))
        if not n_found:
            break
        if n_found * POOR_ROUND < n_pairs:  # the tiles look at all of these buckets anyway
            last = found
            break
        nodes = _merge(nodes, n_nodes, found)

    # what is left: members of different components that still share a bucket
    if n:
        found = links_in_tiles(crowded.select("key", "id", "comp"), reps, texts, width, percent)
        found, n_found = cut_counted((found.unionByName(last) if last is not None else found).distinct())
        if n_found:
            nodes = _merge(nodes, n_nodes, found)

    # class members take the component of their representative; a class of one that
    # no link reached is its own component and needs no join partner
    named = reps.join(nodes, "id", "left").select("fp1", "fp2", "n_shingles", "members", "id", F.coalesce("comp", "id").alias("comp"))
    told = named.filter("members > 1 or comp <> id")
    out = sig.join(told.select("fp1", "fp2", "n_shingles", "comp"), ["fp1", "fp2", "n_shingles"], "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("comp", "id").alias("component_id"),
                      (F.col("id").isNull() | (F.coalesce("comp", "id") == F.col("id"))).alias("kept"))


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The documents of ``docs`` whose id stands for its component, all columns kept.

    Every row of a kept id stays, and so do rows with a null id.
    """
    found = near_duplicates(docs, id_col, text_col, **params)
    gone, n = cut_counted(found.filter(~F.col("kept")).select(F.col(id_col).alias("__gone")).distinct())
    if n <= BROADCAST_IDS:  # the texts need not be shuffled
        gone = F.broadcast(gone)
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
