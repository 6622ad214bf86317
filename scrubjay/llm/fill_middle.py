"""Fill-in-the-middle texts by content-defined chunk memoization.

A text is a row of tokens (``[A-Za-z]+`` or any one other code point). Two drawn token numbers cut it into prefix, middle
and suffix, which are put together in one of two orders behind marks.

1. A rolling gear hash over 32 bytes cuts each text into chunks: where its top ``AVERAGE_BITS`` bits are zero, and
   nowhere else but at ``MAX_CHUNK`` bytes, so equal passages give equal chunks wherever they stand.
2. A chunk's boundary summary holds its tokens, its code points and whether it begins and ends with a letter. Each task keeps
   the summaries of the chunks it has seen, looked up by the chunk's content itself (so a shared hash can never mix two chunks up),
   in two generations of ``CACHE_BYTES`` each; a chunk not found is counted, all new chunks of a batch in one numpy call.
3. Summaries combine: a chunk that begins with a letter behind one that ends with a letter opens one token less. Running sums over a
   document's chunks give its token count and lead to the chunk of each cut, and only that chunk is read again to place the cut.

Everything happens in one scan: rows stay where they are, memory is bounded by a batch, the longest text and the cache.

Defined cases: null texts are empty; an empty text is plain; a null id draws from the bare salt; rows that repeat an id draw alike
and each is returned; an empty table gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubjay.llm.textbytes import Chunk, chunks
from scrubjay.session import ship_package

#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
AVERAGE_BITS, MIN_CHUNK, MAX_CHUNK = 8, 64, 4096
CACHE_BYTES = 32 << 20

_GEAR = np.random.default_rng(77).integers(0, 1 << 32, 256, dtype=np.uint32)
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_SCHEMA = "id long, n long, form string, prefix_chars long, middle_chars long, output string"


def gear_hashes(buf: np.ndarray) -> np.ndarray:
    """Hash of the last 32 bytes at each byte; five doublings instead of a loop over the bytes."""
    h = _GEAR[buf]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k)
    return h


def chunk_bounds(c: Chunk) -> np.ndarray:
    """Sorted start offsets of the chunks and the end; a chunk never spans two documents nor splits a code point."""
    n = len(c.buf)
    if n == 0:
        return np.zeros(1, np.int64)
    at = np.flatnonzero(gear_hashes(c.buf) >> np.uint32(32 - AVERAGE_BITS) == 0) + 1
    at = at[np.diff(at, prepend=-MIN_CHUNK) >= MIN_CHUNK]
    at = np.unique(np.concatenate([at, c.offs, [0, n]]))
    gap = np.diff(at)
    extra = (gap - 1) // MAX_CHUNK  # cuts inside gaps that are too wide
    nth = np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra) + 1
    at = np.concatenate([at, np.repeat(at[:-1], extra) + nth * MAX_CHUNK])
    tail = np.append((c.buf & 0xC0) == 0x80, False)  # bytes inside a code point
    for _ in range(3):
        at = at + tail[at]
    return np.unique(at)


def _token_starts(buf: np.ndarray, fresh: np.ndarray | None = None) -> np.ndarray:
    """True at the first byte of each token; ``fresh`` marks bytes before which all is forgotten."""
    letter = _LETTER[buf]
    before = np.zeros(len(buf), bool)
    before[1:] = letter[:-1]
    if fresh is not None:
        before[fresh] = False
    return np.where(letter, ~before, (buf & 0xC0) != 0x80)


class SummaryCache:
    """Content of a chunk -> (tokens, code points, begins with a letter, ends with a letter), in two generations."""

    def __init__(self, limit: int = CACHE_BYTES):
        self.limit, self.used, self.young, self.old = limit, 0, {}, {}

    def keep(self, content: bytes, summary: tuple) -> None:
        if self.used + len(content) > self.limit:
            self.young, self.old, self.used = {}, self.young, 0
        self.young[content] = summary
        self.used += len(content)

    def summaries(self, contents: list[bytes]) -> np.ndarray:
        """One row per chunk; chunks not seen before are counted together."""
        new: dict[bytes, int] = {}
        out: list = [None] * len(contents)
        for i, x in enumerate(contents):
            s = self.young.get(x)
            if s is None:
                s = self.old.get(x)
                if s is not None:
                    self.keep(x, s)
                else:
                    new.setdefault(x, len(new))
            out[i] = s
        if new:
            buf = np.frombuffer(b"".join(new), np.uint8)
            ends = np.cumsum(np.fromiter(map(len, new), np.int64, len(new)))
            starts = np.concatenate([[0], ends[:-1]])
            tokens = np.add.reduceat(_token_starts(buf, starts), starts, dtype=np.int64)
            points = np.add.reduceat((buf & 0xC0) != 0x80, starts, dtype=np.int64)
            rows = list(zip(tokens.tolist(), points.tolist(), _LETTER[buf[starts]].tolist(), _LETTER[buf[ends - 1]].tolist()))
            for x, s in zip(new, rows):
                self.keep(x, s)
            for i, s in enumerate(out):
                if s is None:
                    out[i] = rows[new[contents[i]]]
        return np.array(out, np.int64).reshape(len(contents), 4)


def draws(salt: str, doc_id: int | None) -> list[int]:
    """The first four 8-digit groups of the hex sha256 of ``salt:doc_id``."""
    x = hashlib.sha256(f"{salt}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(x[i:i + 4], "big") for i in range(0, 16, 4)]


def _middles(c: Chunk, ids: list, cache: SummaryCache, salt: str, percent: int, spm_percent: int) -> list[tuple]:
    raw, at = c.buf.tobytes(), chunk_bounds(c)
    s = cache.summaries([raw[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist())])
    joined = np.zeros(len(s), np.int64)
    joined[1:] = s[1:, 2] & s[:-1, 3]
    own = np.searchsorted(at, c.offs)  # the first chunk of each document, and the end
    joined[own[:-1][own[:-1] < len(s)]] = 0
    opened, points = (np.concatenate([[0], np.cumsum(x)]) for x in (s[:, 0] - joined, s[:, 1]))

    def place(doc: int, k: int) -> tuple[int, int]:
        """Byte offset and code points of the first k tokens of a document."""
        lo, hi = own[doc], own[doc + 1]
        if k == opened[hi] - opened[lo]:
            return int(c.offs[doc + 1]), int(points[hi] - points[lo])
        ch = int(np.searchsorted(opened, opened[lo] + k, "right")) - 1
        part = c.buf[at[ch]:at[ch + 1]]
        inside = int(np.flatnonzero(_token_starts(part))[opened[lo] + k - opened[ch] + joined[ch]])
        return int(at[ch]) + inside, int(points[ch] - points[lo] + ((part[:inside] & 0xC0) != 0x80).sum())

    out = []
    marks = [m.encode() for m in MARKS]
    for d in range(c.n):
        lo, hi = int(c.offs[d]), int(c.offs[d + 1])
        n, text = int(opened[own[d + 1]] - opened[own[d]]), raw[lo:hi]
        h1, h2, h3, h4 = draws(salt, ids[d])
        if lo == hi or h3 % 100 >= percent or any(m in text for m in marks):
            out.append((n, "plain", None, None, text))
            continue
        k1, k2 = h1 % (n + 1), h2 % (n + 1)
        (p, pc), (m, mc) = place(d, min(k1, k2)), place(d, max(k1, k2))
        prefix, middle, suffix = raw[lo:p], raw[p:m], raw[m:hi]
        spm = h4 % 100 < spm_percent
        put = marks[1] + suffix + marks[0] + prefix if spm else marks[0] + prefix + marks[1] + suffix
        out.append((n, "spm" if spm else "psm", pc, mc - pc, put + marks[2] + middle))
    return out


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salt: str = "1", percent: int = 90,
                   spm_percent: int = 20) -> DataFrame:
    """``<id>, n, form, prefix_chars, middle_chars, output`` per document.

    ``percent`` of the documents are rearranged, ``spm_percent`` of these with the suffix first; texts that are empty or hold a mark stay plain.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = SummaryCache()
        for b in batches:
            for c in chunks(b.column(1)):
                ids = b.column(0).slice(c.lo, c.n)
                n, form, pc, mc, text = zip(*_middles(c, ids.to_pylist(), cache, salt, percent, spm_percent))
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(pc, pa.int64()), pa.array(mc, pa.int64()),
                                                  pa.array(text, pa.binary()).view(pa.string())], names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, _SCHEMA)
    return out.withColumnRenamed("id", id_col)


def restore(output: Column, form: Column) -> Column:
    """The exact text again. A rearranged text held no mark, and a mark's first sign stands in no other place of it, so the three marks are the only ones."""
    p = F.split(output, "<[PSM]>", -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(p[1], p[3], p[2])).otherwise(F.concat(p[2], p[3], p[1]))
