"""Vectorised word, line and hash arithmetic over UTF-8 text columns.

The helpers work on the byte buffer of an Arrow string array, so one numpy call
handles thousands of documents. Only ASCII bytes are ever tested, which is safe
in UTF-8: a byte below 0x80 is always a whole character.

* words are maximal runs of bytes other than space and \\t..\\r;
* hashes are 64-bit polynomial hashes over seeded random byte values, finished
  by a splitmix step; equal strings have equal hashes on every machine;
* memory is bounded: chunks hold up to ``CHUNK_BYTES`` of text and ``CHUNK_ROWS`` documents
  (at least one document) and byte-wide temporaries are made ``BLOCK`` bytes at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
CHUNK_ROWS = 4096
BLOCK = 1 << 18

_U = np.uint64
_rng = np.random.default_rng(20240517)
_BASE = int(_rng.integers(1 << 40, 1 << 62)) * 2 + 1
_INV = pow(_BASE, -1, 1 << 64)
_BYTES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
LOWER_MAP = np.arange(256, dtype=np.uint8)
LOWER_MAP[65:91] += 32
_BYTES_LOWER = _BYTES[LOWER_MAP]
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _powers(base: int) -> np.ndarray:
    out = np.ones(BLOCK + 1, np.uint64)
    np.multiply.accumulate(np.concatenate([[_U(1)], np.full(BLOCK, _U(base))]), out=out)
    return out


_POW, _POW_INV = _powers(_BASE), _powers(_INV)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser of a uint64 array."""
    z = x + _U(0x9E3779B97F4A7C15)
    z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
    return z ^ (z >> _U(31))


@dataclass
class Chunk:
    """Rows [lo, hi) of a batch: text bytes ``buf``; document i is buf[offs[i]:offs[i+1]]."""

    lo: int
    hi: int
    buf: np.ndarray
    offs: np.ndarray

    @property
    def n(self) -> int:
        return self.hi - self.lo


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Split an Arrow string column into chunks; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    col = pc.fill_null(column.cast(pa.large_string()), "")
    if len(col) == 0:
        return
    _, off, data = col.buffers()
    offs = np.frombuffer(off, np.int64)[col.offset:col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, min(lo + CHUNK_ROWS, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1))
        yield Chunk(lo, hi, raw[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo])
        lo = hi


def word_bounds(c: Chunk, cut_before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``starts, ends`` of all words and ``first``: document i owns words first[i]:first[i+1].

    ``cut_before`` marks bytes (from the second on) at which a word is also cut in two.
    """
    n = len(c.buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(c.n + 1, np.int64)
    solid = ~IS_SPACE[c.buf]
    cut = c.offs[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    begin[cut] = solid[cut]
    end = solid.copy()
    end[:-1] &= ~solid[1:]
    end[cut - 1] = solid[cut - 1]
    if cut_before is not None:
        begin[1:] |= cut_before
        end[:-1] |= cut_before
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, c.offs)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hash of each byte span (spans sorted by start and not overlapping)."""
    table = _BYTES_LOWER if lower else _BYTES
    at_start, at_end, back = (np.zeros(len(starts), np.uint64) for _ in range(3))
    total, power, inverse = 0, 1, 1
    mask = (1 << 64) - 1
    prefix = np.zeros(BLOCK + 1, np.uint64)
    for b0 in range(0, len(buf), BLOCK):
        v = table[buf[b0:b0 + BLOCK]]
        v *= _POW[:len(v)]
        np.cumsum(v, out=prefix[1:len(v) + 1])
        here = prefix[:len(v) + 1] * _U(power) + _U(total)
        i, j = np.searchsorted(starts, [b0, b0 + len(v)])
        rel = starts[i:j] - b0
        at_start[i:j] = here[rel]
        back[i:j] = _POW_INV[rel] * _U(inverse)
        i, j = np.searchsorted(ends, [b0 + 1, b0 + len(v) + 1])
        at_end[i:j] = here[ends[i:j] - b0]
        total = int(here[len(v)])
        power = power * int(_POW[BLOCK]) & mask
        inverse = inverse * int(_POW_INV[BLOCK]) & mask
    return mix((at_end - at_start) * back + (ends - starts).astype(np.uint64))


def owners(first: np.ndarray) -> np.ndarray:
    """Document index of each element, given the per-document boundaries ``first``."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def count_in_docs(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Per document, the number of set bytes of ``mask``."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive word hashes (len(h) - width + 1 of them)."""
    out = h[:len(h) - width + 1].copy()
    for k in range(1, width):
        out = mix(out * _U(_BASE) + h[k:len(h) - width + 1 + k])
    return out
