"""Exact substring de-duplication of word windows by fixed-block anchors.

A window is ``window`` consecutive words of one document. It is a repeat if its words also stand at an earlier place: in a
document before it by (id, text), or further left in its own. Repeats that overlap or touch
join to maximal exact repeats, and every word of them is removed; the first place stays.

1. Documents are range-partitioned by id and written to the shared folder as packs of a few MB, numbered in that order. So
   "earlier" is the order of packs, and inside a pack the order of words; nothing that follows carries positions.
2. Anchors: each document is cut into non-overlapping blocks of half a window; these are the index. Every rolling window
   of the same width probes it. Any repeat holds one whole block of its first place, so a probe that meets no block
   of another pack can be in no repeat across packs. A pack sends each hash once (31 bits and the mark of a block, dealt into
   buckets by the rest), so a passage that a third of all documents hold reaches its bucket once a pack, and the bucket answers with one bit a hash.
3. Extension: each hit is extended to the windows that cover it, told apart by 128-bit hashes of all their words.
   Again a pack sends each hash once, and the answer is whether an earlier pack has it. Repeats inside a pack are found there.
   Runs of confirmed windows are the maximal exact repeats.

A bucket holds about ``BUCKET`` hashes, so their number grows with the words and none with the copies of a passage; a task holds one bucket, or one pack with its
answers. No step lists pairs, and none drops a candidate.

Defined cases: null and empty texts have no words and an empty kept text; texts shorter than the window lose nothing; rows that repeat an id are
documents of their own, ordered by text, so of equal rows one keeps its words; rows with a null id come before all others; an
empty table gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubjay.llm.textbytes import CHUNK_ROWS, IS_SPACE, chunks, mix, owners, span_hashes, window_hashes, word_bounds
from scrubjay.session import ensure_checkpoint_dir, ship_package

PACK_BYTES = 4 << 20
BUCKET = 4_000_000
_U = np.uint64
_OUT = "id long, n_words long, n_removed long, repeats array<struct<start:long,end:long>>, kept string"


def _pack(docs: DataFrame, pack_bytes: int) -> DataFrame:
    """``n_words, data``: consecutive documents of a partition as compressed Arrow streams."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for b in batches:
            for c in chunks(b.column(1), pack_bytes):
                part, sink = b.slice(c.lo, c.n), pa.BufferOutputStream()
                part = pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.large_string())], names=["id", "text"])
                with pa.ipc.new_stream(sink, part.schema, options=options) as w:
                    w.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([len(word_bounds(c)[0])], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["n_words", "data"])

    return docs.mapInArrow(run, "n_words long, data binary")


class PackWindows:
    """The windows of a pack. Anchors: ``key`` (bucket, 31 bits) at each place ``at`` where a whole window begins or a block ends it,
    ``entries`` the distinct keys, ascending, with ``block`` for those that are a block somewhere."""

    def __init__(self, data, window: int, buckets: int):
        (b,) = pa.ipc.open_stream(pa.py_buffer(data) if isinstance(data, bytes) else data.as_buffer())
        self.ids = b.column(0)
        (self.chunk,) = chunks(b.column(1), 1 << 62) if b.num_rows <= CHUNK_ROWS else ()
        self.window, self.half = window, window // 2
        self.starts, self.ends, self.first = word_bounds(self.chunk)
        self.h = span_hashes(self.chunk.buf, self.starts, self.ends, lower=False)
        self.doc = owners(self.first)
        x, self.at = self._within(self.half, np.diff(self.first) >= window)
        v = mix(x[self.at])
        self.bucket_of = ((v >> _U(32)) * _U(buckets)) >> _U(32)
        key = self.bucket_of << _U(31) | v & _U(0x7FFFFFFF)
        self.entries, self.place = np.unique(key, return_inverse=True)
        self.block = np.zeros(len(self.entries), bool)
        self.block[self.place[(self.at - self.first[self.doc[self.at]]) % self.half == 0]] = True

    def _within(self, width: int, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``width`` words and the starts of those inside one of ``docs``."""
        if len(self.h) < width:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        inside = (self.doc[:len(self.h) - width + 1] == self.doc[width - 1:]) & docs[self.doc[:len(self.h) - width + 1]]
        return window_hashes(self.h, width), np.flatnonzero(inside)

    def candidates(self, hot: np.ndarray) -> np.ndarray:
        """Starts of the windows that cover an anchor of ``hot`` (a mark for each entry)."""
        total = np.zeros(len(self.h) + 2, np.int64)
        mark = np.zeros(len(self.h) + 1, np.int64)
        mark[self.at] = hot[self.place]
        np.cumsum(mark, out=total[1:])
        at = self.windows()[2]
        return at[total[at + self.window - self.half + 1] > total[at]]

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Two hashes of each run of ``window`` words, and the starts of the whole windows."""
        if not hasattr(self, "_windows"):
            a, at = self._within(self.window, np.ones(self.chunk.n, bool))
            second = window_hashes(mix(self.h ^ _U(0x5851F42D4C957F2D)), self.window) if len(at) else a
            self._windows = a, second, at
        return self._windows


_PAIR = np.dtype([("a", "<u8"), ("b", "<u8")])


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (a, b, place), the first of each different pair in it, and the number of its pair for each place."""
    order = np.argsort(a, kind="stable")
    x, y = a[order], b[order]
    if len(x) and ((x[1:] == x[:-1]) & (y[1:] != y[:-1])).any():  # equal first hashes of different windows
        order = np.lexsort((b, a))
        x, y = a[order], b[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    number = np.empty(len(x), np.int64)
    number[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), number


def _sent(w: PackWindows, at: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct windows among ``at``: their pairs and buckets, ordered by both, and the number of each place's pair."""
    a, b, _ = w.windows()
    a, b = a[at], b[at]
    order, new, number = _distinct(a, b)
    pairs = np.zeros(len(new), _PAIR)
    pairs["a"], pairs["b"] = a[order][new], b[order][new]
    return pairs, ((pairs["a"] >> _U(32)) * _U(buckets)) >> _U(32), number


def _by_bucket(pack: int, of: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket (``of`` ascends) with the bytes of its values."""
    present, lo = np.unique(of, return_index=True)
    raw = [x.tobytes() for x in np.split(values, lo[1:])] if len(present) else []
    return pa.RecordBatch.from_arrays([pa.array(present.astype(np.int64)), pa.array([pack] * len(raw), pa.int64()), pa.array(raw, pa.binary())], names=["bucket", "pack", "sent"])


def _answers(sent: DataFrame, judge, kind: int) -> DataFrame:
    """``pack, kind, bucket, bits``: ``judge(rows, packs)`` marks the entries of a bucket, whose rows are in the order of their packs."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("pack")
        packs, raw = t.column("pack").to_pylist(), [x.as_buffer() for x in t.column("sent")]
        marks = judge(raw, packs)
        rows = [(p, t.column("bucket")[0].as_py(), np.packbits(m).tobytes()) for p, m in zip(packs, marks) if m.any()]
        p, k, bits = zip(*rows) if rows else ((), (), ())
        return pa.table({"pack": pa.array(p, pa.int64()), "kind": pa.array([kind] * len(p), pa.int32()), "bucket": pa.array(k, pa.int64()), "bits": pa.array(bits, pa.binary())})

    return sent.groupBy("bucket").applyInArrow(run, "pack long, kind int, bucket long, bits binary")


def _split(mark: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    return np.split(mark, np.cumsum(sizes)[:-1])


def _judge_anchors(raw: list, packs: list) -> list[np.ndarray]:
    """Entries that two packs hold, and one of them as a block."""
    sizes = [len(x) // 4 for x in raw]
    x = np.concatenate([np.frombuffer(r, np.uint32) for r in raw])
    _, number, count = np.unique(x >> 1, return_inverse=True, return_counts=True)
    block = np.zeros(len(count), bool)
    block[number[(x & 1) == 1]] = True
    return _split((block & (count > 1))[number], sizes)


def _judge_windows(raw: list, packs: list) -> list[np.ndarray]:
    """Entries that an earlier pack holds."""
    sizes = [len(x) // _PAIR.itemsize for x in raw]
    x = np.concatenate([np.frombuffer(r, _PAIR) for r in raw])
    order, new, _ = _distinct(x["a"], x["b"])
    mark = np.ones(len(x), bool)
    mark[order[new]] = False
    return _split(mark, sizes)


def _marks(answers: pa.Table, kind: int, of: np.ndarray) -> np.ndarray:
    """A mark for each entry, whose buckets ``of`` ascend, from the bits that came back."""
    out = np.zeros(len(of), bool)
    for k, bucket, bits in zip(*(answers.column(c).to_pylist() for c in ("kind", "bucket", "bits"))):
        if k == kind:
            lo, hi = np.searchsorted(of, [bucket, bucket + 1])
            out[lo:hi] = np.unpackbits(np.frombuffer(bits, np.uint8), count=hi - lo)
    return out


def _cleaned(w: PackWindows, repeat: np.ndarray) -> pa.Table:
    """The documents of a pack without the words of the windows that start at ``repeat``."""
    c, n = w.chunk, len(w.h)
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, repeat, 1)
    np.add.at(delta, repeat + w.window, -1)
    gone = np.cumsum(delta[:n]) > 0
    total = np.concatenate([[0], np.cumsum(gone)])
    removed = total[w.first[1:]] - total[w.first[:-1]]
    # runs of removed words inside a document
    edge = np.ones(n, bool)
    edge[1:] = (gone[1:] != gone[:-1]) | (w.doc[1:] != w.doc[:-1])
    run = np.flatnonzero(edge)
    stop = np.append(run[1:], n)
    run, stop = run[gone[run]], stop[gone[run]]
    owner = w.doc[run]
    spans = pa.StructArray.from_arrays([pa.array(run - w.first[owner]), pa.array(stop - w.first[owner])], names=["start", "end"])
    spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(c.n + 1)).astype(np.int32)), spans)
    # bytes of kept words, and one space between two of them
    kept = np.flatnonzero(~gone)
    step = np.zeros(len(c.buf) + 1, np.int8)
    step[w.starts[kept]] += 1
    step[w.ends[kept]] -= 1
    take = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
    more = np.zeros(len(kept), bool)
    more[:-1] = w.doc[kept[1:]] == w.doc[kept[:-1]]
    take[w.ends[kept[more]]] = True
    length = np.concatenate([[0], np.cumsum(take)])[c.offs]
    text = np.where(IS_SPACE[c.buf], np.uint8(32), c.buf)[take]
    text = pa.LargeStringArray.from_buffers(c.n, pa.py_buffer(length.astype(np.int64).tobytes()), pa.py_buffer(text.tobytes())).cast(pa.string())
    return pa.table({"id": w.ids, "n_words": pa.array(np.diff(w.first).astype(np.int64)), "n_removed": pa.array(removed.astype(np.int64)), "repeats": spans, "kept": text})


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, pack_bytes: int = PACK_BYTES,
                   bucket: int = BUCKET) -> DataFrame:
    """``<id>, n_words, n_removed, repeats (word spans), kept`` per document; ``kept`` is the words that stay, joined by one space."""
    if window < 2:
        raise ValueError("a window takes two words or more")
    spark = docs.sparkSession
    ship_package(spark)
    folder = f"{ensure_checkpoint_dir(spark)}/repeats-{uuid.uuid4().hex}"

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.withColumn("tie", F.xxhash64("text")).repartitionByRange("id", "tie").sortWithinPartitions("id", "tie", "text")
    packs = stored(_pack(texts.select("id", "text"), pack_bytes).withColumn("pack", F.monotonically_increasing_id()), "packs")
    words = packs.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-words // bucket))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for pack, data in zip(b.column(0).to_pylist(), b.column(1)):
                w = PackWindows(data, window, buckets)
                low = (w.entries & _U(0x7FFFFFFF)).astype(np.uint32) << np.uint32(1) | w.block
                yield _by_bucket(pack, w.entries >> _U(31), low.astype(np.uint32))

    def extended(w: PackWindows, answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        at = w.candidates(_marks(answers, 0, w.entries >> _U(31)))
        return at, *_sent(w, at, buckets)

    def extend(key, left: pa.Table, answers: pa.Table) -> pa.Table:
        if not left.num_rows or not answers.num_rows:
            return pa.table({"bucket": pa.array([], pa.int64()), "pack": pa.array([], pa.int64()), "sent": pa.array([], pa.binary())})
        _, pairs, of, _ = extended(PackWindows(left.column("data")[0], window, buckets), answers)
        return pa.Table.from_batches([_by_bucket(key[0].as_py(), of, pairs)])

    def clean(key, left: pa.Table, answers: pa.Table) -> pa.Table:
        w = PackWindows(left.column("data")[0], window, buckets)
        at, _, of, number = extended(w, answers)
        elsewhere = at[_marks(answers, 1, of)[number]]
        a, b, starts = w.windows()
        order, new, _ = _distinct(a[starts], b[starts])
        again = np.ones(len(starts), bool)
        again[order[new]] = False
        return _cleaned(w, np.union1d(elsewhere, starts[again]))

    data = packs.select("pack", "data")
    sent = data.mapInArrow(anchors, "bucket long, pack long, sent binary")
    hits = stored(_answers(sent, _judge_anchors, 0), "hits")
    sent = data.groupBy("pack").cogroup(hits.groupBy("pack")).applyInArrow(extend, "bucket long, pack long, sent binary")
    answers = hits.unionByName(stored(_answers(sent, _judge_windows, 1), "earlier"))
    out = data.groupBy("pack").cogroup(answers.groupBy("pack")).applyInArrow(clean, _OUT)
    return out.withColumnRenamed("id", id_col)
