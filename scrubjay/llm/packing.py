"""Hierarchical multi-length packing of tokenised documents.

Each document's ids (with the end id) are routed to context-size tiers: whole windows
of the longest tier are cut off first, the remainder goes to the shortest tier that
holds it. Tiers are packed from long to short. A remainder opens a window of its own
tier; the gap behind it is filled best-fit from shorter tiers, and what no piece
fits exactly is filled by cutting one, whose rest is routed again. Every window is
therefore full. What is left when a partition ends is cut into windows of powers of two.

Step groups hold sequences of one tier and about ``step_tokens`` tokens; the
sequences of a flush are dealt to them in serpentine order of attention cost (the sum
of squared piece lengths), so steps take alike times.

Packing needs no shuffle: each input partition is packed as it streams by, with at
most ``buffer`` remainders (under one long window each) in memory. Sequence and step
ids are made unique by the partition number, so a lost task is redone alike.

Tokenising is the costly part. A text is cut into units at white space and between
ASCII letters or digits and ASCII punctuation other than the apostrophe, none of which
the tokenizer's pre-tokens cross; equal units (ASCII letters in either case, which the
tokenizer lower-cases) are encoded once and kept in a bounded cache. ``tokenize``
equals a plain call of the tokenizer on the text; the tests compare the two.

Defined cases: null and empty texts have the end id only; ids may be null or repeat
(each row is packed); an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubjay.llm.textbytes import Chunk, chunks, span_hashes, word_bounds
from scrubjay.session import ship_package

TIERS = (512, 1024, 2048, 4096)
END_ID = 2
CACHE_UNITS = 1 << 19
SCHEMA = ("doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long, tier int, step_group long")

_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[b for b in range(33, 127) if not _ALNUM[b] and b != 39]] = True


class UnitTokenizer:
    """Token ids of texts by encoding each distinct unit once (see the module text)."""

    def __init__(self, path: str, cache_units: int = CACHE_UNITS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.whole = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        vocab = self.tok.get_vocab()
        suffix = getattr(self.tok.model, "end_of_word_suffix", None)
        self.ends = None  # which ids end a word
        if suffix:
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.limit = cache_units
        self._clear()

    def _clear(self) -> None:
        self.index: dict[int, int] = {}
        self.pool = np.zeros(1 << 16, np.uint32)
        self.begin = np.zeros(1 << 14, np.int64)
        self.used, self.n = 0, 0

    def _encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units, and how many ids each has.

        Units of letters only are one pre-token each, so a whole run of them is encoded
        as one text and cut after the ids that end a word; if the count of ends is not
        the count of units (a letter that lower-cases to several), they go one by one.
        """
        words = [i for i, u in enumerate(units) if u.isalpha()]
        parts: list = [None] * len(units)
        if self.ends is not None and words:
            ids = np.asarray(self.tok.encode(" ".join([units[i] for i in words]), add_special_tokens=False).ids, np.uint32)
            stop = np.flatnonzero(self.ends[ids]) + 1
            if len(stop) == len(words):
                for i, s, e in zip(words, [0, *stop[:-1].tolist()], stop.tolist()):
                    parts[i] = ids[s:e]
        rest = [i for i, x in enumerate(parts) if x is None]
        for i, e in zip(rest, self.tok.encode_batch_fast([units[i] for i in rest], add_special_tokens=False)):
            parts[i] = np.asarray(e.ids, np.uint32)
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))

    def _add(self, keys: list[int], units: list[str]) -> None:
        for at in range(0, len(units), 512):
            ids, sizes = self._encode(units[at:at + 512])
            while self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            while self.n + len(sizes) + 1 > len(self.begin):
                self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
            self.pool[self.used:self.used + len(ids)] = ids
            self.begin[self.n + 1:self.n + 1 + len(sizes)] = self.used + np.cumsum(sizes)
            self.index.update(zip(keys[at:at + 512], range(self.n, self.n + len(sizes))))
            self.used += len(ids)
            self.n += len(sizes)

    def _units(self, c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = c.buf.tobytes() if self.whole else b""
        if len(c.buf) < 2 or any(s in raw for s in self.whole):
            return word_bounds(c)  # an added token may hold letters and punctuation: keep words whole
        a, p = _ALNUM[c.buf], _PUNCT[c.buf]
        return word_bounds(c, cut_before=(a[:-1] & p[1:]) | (p[:-1] & a[1:]))

    def tokenize(self, c: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """``ids, first``: document i has ids[first[i]:first[i+1]] (no end id)."""
        us, ue, first = self._units(c)
        if not len(us):
            return np.zeros(0, np.uint32), np.zeros(c.n + 1, np.int64)
        h = span_hashes(c.buf, us, ue, lower=True)
        keys, at, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.index) + len(keys) > self.limit:
            self._clear()
        known = [self.index.get(k) for k in keys.tolist()]
        new = [i for i, k in enumerate(known) if k is None]
        if new:
            raw = c.buf.tobytes()
            self._add(keys[new].tolist(), [raw[us[at[i]]:ue[at[i]]].decode("utf-8", "replace") for i in new])
            for i in new:
                known[i] = self.index[int(keys[i])]
        entry = np.asarray(known, np.int64)
        length, begin = (self.begin[entry + 1] - self.begin[entry])[inverse], self.begin[entry][inverse]
        total = np.concatenate([[0], np.cumsum(length)])
        where = np.repeat(begin - total[:-1], length) + np.arange(total[-1])
        return self.pool[where], total[first]


class TierPacker:
    """Streaming packer of one partition; ``add`` documents, then ``finish``."""

    def __init__(self, tiers: tuple[int, ...], buffer: int, step_tokens: int, partition: int):
        self.tiers, self.buffer, self.step_tokens = tuple(sorted(tiers)), buffer, step_tokens
        if any(t & (t - 1) for t in self.tiers):
            raise ValueError("tiers must be powers of two")
        self.next_seq = self.next_step = partition << 36
        self.pending: list[tuple] = []      # (length, serial, doc, start, ids, doc_tokens), sorted
        self.done: dict[int, list[list[tuple]]] = {}
        self.serial = self.held = 0

    def _push(self, doc, start: int, ids: np.ndarray, total: int) -> None:
        self.serial += 1
        insort(self.pending, (len(ids), self.serial, doc, start, ids, total), key=lambda x: x[:2])

    def add(self, doc, ids: np.ndarray) -> None:
        top, total, start = self.tiers[-1], len(ids), 0
        while total - start >= top:
            self._close(top, [(doc, start, ids[start:start + top], total)])
            start += top
        if start < total:
            self._push(doc, start, ids[start:].copy(), total)

    def _close(self, tier: int, pieces: list[tuple]) -> None:
        rows = [(d, s, len(i), zlib.crc32(i.astype("<u4").tobytes()), t) for d, s, i, t in pieces]
        self.done.setdefault(tier, []).append(rows)
        self.held += 1

    def _tier(self, n: int) -> int:
        return next(t for t in self.tiers if n <= t)

    def _fill(self, size: int) -> None:
        """Take pieces of exactly ``size`` tokens in all from the pending remainders, the longest first."""
        pieces, gap = [], size
        while gap:
            i = bisect_right(self.pending, gap, key=lambda x: x[0]) - 1
            n, _, doc, start, ids, total = self.pending.pop(max(i, 0))
            if n > gap:  # nothing fits: cut the shortest that does not
                self._push(doc, start + gap, ids[gap:].copy(), total)
                ids = ids[:gap]
            pieces.append((doc, start, ids, total))
            gap -= len(ids)
        self._close(size, pieces)

    def pack(self, keep: int) -> None:
        """Pack full windows, longest tier first, until at most about ``keep`` tokens are pending."""
        left = sum(p[0] for p in self.pending)
        while self.pending:
            tier = self._tier(self.pending[-1][0])
            if left - tier < keep:
                return
            self._fill(tier)
            left -= tier

    def drain(self) -> list[tuple]:
        """Rows of the closed sequences, dealt to balanced step groups of one tier."""
        out = []
        for tier, seqs in sorted(self.done.items()):
            groups = max(1, -(-len(seqs) * tier // self.step_tokens))
            order = sorted(range(len(seqs)), key=lambda k: -sum(r[2] * r[2] for r in seqs[k]))
            for rank, k in enumerate(order):
                lap, g = divmod(rank, groups)
                step, offset = self.next_step + (g if lap % 2 == 0 else groups - 1 - g), 0
                for doc, start, n, crc, total in seqs[k]:
                    out.append((doc, start, n, crc, total, self.next_seq, offset, tier, step))
                    offset += n
                self.next_seq += 1
            self.next_step += groups
        self.done, self.held = {}, 0
        return out

    def finish(self) -> list[tuple]:
        self.pack(keep=0)
        left = sum(p[0] for p in self.pending)
        while left:
            size = 1 << (left.bit_length() - 1)
            self._fill(size)
            left -= size
        return self.drain()


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                   end_id: int = END_ID, tiers: tuple[int, ...] = TIERS, buffer: int = 1024,
                   step_tokens: int = 64 * 4096) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group``."""
    ship_package(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(tokenizer_path)
        ctx = TaskContext.get()
        packer = TierPacker(tiers, buffer, step_tokens, ctx.partitionId() if ctx else 0)
        id_type, names = None, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]

        def rows(found: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*found))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], id_type)] + [pa.array(x, pa.int64()) for x in cols[1:7]]
                                              + [pa.array(cols[7], pa.int32()), pa.array(cols[8], pa.int64())], names=names)

        for b in batches:
            id_type = b.column(0).type
            doc_ids = b.column(0).to_pylist()
            for c in chunks(b.column(1)):
                ids, first = tok.tokenize(c)
                for i in range(c.n):
                    packer.add(doc_ids[c.lo + i], np.append(ids[first[i]:first[i + 1]], np.uint32(end_id)))
                    if len(packer.pending) >= buffer:
                        packer.pack(keep=packer.tiers[-1] * 8)
                    if packer.held >= 4 * buffer:
                        yield rows(packer.drain())
        last = packer.finish()
        if last:
            yield rows(last)

    return src.mapInArrow(run, SCHEMA.format(id=src.schema["doc_id"].dataType.simpleString()))


_TOKENIZERS: dict[str, UnitTokenizer] = {}


def _tokenizer(path: str) -> UnitTokenizer:
    """One tokenizer and cache per Python worker."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = UnitTokenizer(path)
    return _TOKENIZERS[path]
