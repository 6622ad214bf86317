"""Quality rules, line first: clean lines by punctuation, navigation and
boilerplate rules, then reject documents that lose too much text.

A line is a piece of the text between ``\\n``. A line fails when one of these holds:

* boilerplate: phrases of ``BOILERPLATE`` (ASCII letters in either case, no letter or digit beside them) make up at least
  ``phrase_pct`` percent of its words;
* navigation: at least ``nav_pct`` percent of its words are bare separators (``|``, ``>``, ``/``, ...);
* punctuation: at least ``symbol_pct`` percent of its words end in a symbol or in ``!!``, or the line has
  at least ``long_line`` words, ends in a letter or digit and no word of it ends in ``.``, ``!`` or ``?``;
* repeat: it equals an earlier line of the document, or at least ``stutter_pct`` percent of its words equal the word before.

Removed lines go from the text. A document is rejected when it fails the base
rules (fewer than ``min_words`` words, or over ``max_repeat_pct`` percent of its
words in repeated 5-word windows) or when more than ``max_loss_pct`` percent of
its words lie in failed lines.

Defined cases: a null or empty text has no words and is rejected; a text of
white space likewise; ids may be null or repeated (each row is judged on its
own); an empty table gives an empty table; input columns other than the id and
the text are passed through ``clean_documents`` and ignored by ``line_quality``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubjay.llm.textbytes import IS_SPACE, LOWER_MAP, Chunk, chunks, count_in_docs, mix, owners, span_hashes, window_hashes, word_bounds
from scrubjay.session import ship_package

# fixed values: phrases of page furniture
BOILERPLATE = ["all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service",
               "enable javascript", "javascript is disabled", "lorem ipsum", "click here", "read more",
               "sign up", "log in", "skip to content", "subscribe to", "share this"]
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|>/\\-*<"
WINDOW = 5

_PHRASES = [p.encode() for p in BOILERPLATE]
_SYMBOL_BYTES = np.isin(np.arange(256), list(SYMBOLS.encode()))
_SEPARATOR_BYTES = np.isin(np.arange(256), list(SEPARATORS.encode()))
_SHOUT_BYTES = np.isin(np.arange(256), list(b"#*$%&|<>"))
_STOP_BYTES = np.isin(np.arange(256), list(b".!?"))
_OPEN_BYTES = np.isin(np.arange(256), list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
_LETTER_LEAD = (np.arange(256) >= 0xC3) & (np.arange(256) < 0xE0)  # first bytes of two-byte letters


def _lines(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """starts, ends and document of each line (lines without bytes are left out)."""
    nl = np.flatnonzero(c.buf == 10)
    docs = np.flatnonzero(np.diff(c.offs) > 0)
    after = nl + 1
    starts = np.unique(np.concatenate([c.offs[docs], after[after < len(c.buf)]]))
    doc = np.searchsorted(c.offs, starts, "right") - 1
    stop = np.concatenate([nl, [len(c.buf)]])
    ends = np.minimum(stop[np.searchsorted(nl, starts)], c.offs[doc + 1])
    some = ends > starts
    return starts[some], ends[some], doc[some]


def _repeated(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(equal to an earlier one of the document, equal to any other) per element."""
    key = mix(h ^ mix(doc.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = np.zeros(len(s) + 1, bool)
    same[1:-1] = s[1:] == s[:-1]
    later, any_ = np.zeros(len(s), bool), np.zeros(len(s), bool)
    later[order] = same[:-1]
    any_[order] = same[:-1] | same[1:]
    return later, any_


def _phrase_spans(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the boilerplate phrases in the lower-cased buffer, with no letter or digit on either side. A phrase
    has no line break; one that runs over a document's end belongs to no line of it."""
    raw, starts, ends = LOWER_MAP[c.buf].tobytes(), [], []
    for phrase in _PHRASES:
        at = raw.find(phrase)
        while at >= 0:
            i = int(np.searchsorted(c.offs, at, "right"))
            lo, hi, end = (int(c.offs[i - 1]), int(c.offs[i]), at + len(phrase)) if i <= c.n else (0, len(raw), at + len(phrase))
            if (end <= hi and not (end < hi and (_OPEN_BYTES[raw[end]] or _LETTER_LEAD[raw[end]]))
                    and not (at > lo and _OPEN_BYTES[raw[at - 1]]) and not (at - 1 > lo and raw[at - 1] >= 0x80 and _LETTER_LEAD[raw[at - 2]])):
                starts.append(at)
                ends.append(end)
            at = raw.find(phrase, at + 1)
    return np.asarray(starts, np.int64), np.asarray(ends, np.int64)


def judge_chunk(c: Chunk, p: dict) -> dict:
    """Counts, verdicts and failed line spans of the documents of one chunk."""
    ws, we, first = word_bounds(c)
    n_words = np.diff(first)
    solid = ~IS_SPACE[c.buf]
    word_chars = count_in_docs(solid & ((c.buf & 0xC0) != 0x80), c.offs)
    n_symbols = count_in_docs(_SYMBOL_BYTES[c.buf], c.offs)
    ls, le, ldoc = _lines(c)
    lw0, lw1 = np.searchsorted(ws, ls), np.searchsorted(ws, le)
    worded = lw1 > lw0
    ls, le, ldoc, lw0, lw1 = (x[worded] for x in (ls, le, ldoc, lw0, lw1))
    size = lw1 - lw0
    dup, _ = _repeated(ldoc, span_hashes(c.buf, ls, le, lower=False))
    n_dup = np.bincount(ldoc[dup], minlength=c.n)

    # words in repeated windows
    h = span_hashes(c.buf, ws, we, lower=False)
    cover = np.zeros(len(h) + 1, np.int64)
    wdoc = owners(first)
    if len(h) >= WINDOW:
        inside = np.flatnonzero(wdoc[:len(h) - WINDOW + 1] == wdoc[WINDOW - 1:])
        _, rep = _repeated(wdoc[inside], window_hashes(h, WINDOW)[inside])
        at = inside[rep]
        np.add.at(cover, at, 1)
        np.subtract.at(cover, at + WINDOW, 1)
    n_repeat = np.bincount(wdoc[np.cumsum(cover)[:-1] > 0], minlength=c.n)
    base_failed = (n_words < p["min_words"]) | (100 * n_repeat > p["max_repeat_pct"] * n_words)

    # line rules
    bare = (we - ws == 1) & _SEPARATOR_BYTES[c.buf[ws]] if len(ws) else np.zeros(0, bool)
    shout = _SHOUT_BYTES[c.buf[we - 1]] if len(ws) else np.zeros(0, bool)
    if len(ws):
        bang = (we - ws > 2) & (c.buf[we - 1] == 33) & (c.buf[np.maximum(we - 2, 0)] == 33)
        shout = (shout | bang) & ~bare
    n_bare = np.concatenate([[0], np.cumsum(bare)])
    n_shout = np.concatenate([[0], np.cumsum(shout)])
    nav = 100 * (n_bare[lw1] - n_bare[lw0]) >= p["nav_pct"] * size
    loud = 100 * (n_shout[lw1] - n_shout[lw0]) >= p["symbol_pct"] * size
    stop = _STOP_BYTES[c.buf[we - 1]] if len(ws) else np.zeros(0, bool)
    n_stop = np.concatenate([[0], np.cumsum(stop)])
    open_end = np.zeros(0, bool)
    if len(ls):
        open_end = (size >= p["long_line"]) & _OPEN_BYTES[c.buf[we[lw1 - 1] - 1]] & (n_stop[lw1] == n_stop[lw0])
    again = np.concatenate([[0, 0], np.cumsum(h[1:] == h[:-1])]) if len(h) else np.zeros(1, np.int64)
    stutter = (size >= 4) & (100 * (again[lw1] - again[np.minimum(lw0 + 1, len(again) - 1)]) >= p["stutter_pct"] * size)
    in_phrase = np.zeros(len(ws) + 1, np.int64)
    ps, pe = _phrase_spans(c)
    np.add.at(in_phrase, np.searchsorted(we, ps, "right"), 1)
    np.subtract.at(in_phrase, np.searchsorted(ws, pe), 1)
    n_phrase = np.concatenate([[0], np.cumsum(np.cumsum(in_phrase)[:-1] > 0)])[:len(ws) + 1]
    n_phrase = n_phrase[lw1] - n_phrase[lw0]
    phrase = (n_phrase > 0) & (100 * n_phrase >= p["phrase_pct"] * size)
    bad = nav | loud | open_end | stutter | phrase | dup
    lost = np.bincount(ldoc[bad], weights=size[bad], minlength=c.n).astype(np.int64)
    kept = ~base_failed & (100 * lost <= p["max_loss_pct"] * n_words)
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup,
            "n_repeat_words": n_repeat, "base_failed": base_failed, "lost_words": lost, "kept": kept,
            "bad_lines": (ls[bad], le[bad], ldoc[bad])}


DEFAULTS = {"min_words": 10, "max_repeat_pct": 20, "nav_pct": 30, "symbol_pct": 50, "long_line": 40, "stutter_pct": 30, "phrase_pct": 30,
            "max_loss_pct": 40}
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_words"]


def line_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """One row per document: the id, the word, symbol and repeat counts,
    ``base_failed``, ``lost_words`` (words in failed lines) and ``kept``.

    One scan, no shuffle: a document is judged from its own text.
    """
    p = {**DEFAULTS, **params}
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b.column(1)):
                r = judge_chunk(c, p)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(c.lo, c.n)] + [pa.array(r[k].astype(np.int64)) for k in _COUNTS]
                    + [pa.array(r["base_failed"]), pa.array(r["kept"])], names=[id_col, *_COUNTS, "base_failed", "kept"])

    src = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("text"))
    kind = src.schema[0].dataType.simpleString()
    return src.mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{k} long" for k in _COUNTS) + ", base_failed boolean, kept boolean")


def clean_documents(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", **params) -> DataFrame:
    """The kept documents with their failed lines removed; all columns stay, and
    ``length_col`` (if present) is set to the new length in code points."""
    p = {**DEFAULTS, **params}
    ship_package(docs.sparkSession)
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b.column(at)):
                r = judge_chunk(c, p)
                keep = np.flatnonzero(r["kept"])
                part = b.slice(c.lo, c.n).take(pa.array(keep))
                texts = part.column(at).to_pylist()
                ls, le, ldoc = r["bad_lines"]
                lo, hi = np.searchsorted(ldoc, keep), np.searchsorted(ldoc, keep, "right")
                for k in np.flatnonzero(hi > lo):
                    raw, out, pos = c.buf[c.offs[keep[k]]:c.offs[keep[k] + 1]].tobytes(), [], 0
                    for s, e in zip(ls[lo[k]:hi[k]] - c.offs[keep[k]], le[lo[k]:hi[k]] - c.offs[keep[k]]):
                        out.append(raw[pos:s])
                        pos = e + 1  # with its line break
                    out.append(raw[pos:])
                    texts[k] = b"".join(out).decode()
                cols = [part.column(i) if i != at else pa.array(texts, part.column(at).type) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    out = docs.mapInArrow(run, docs.schema)
    if length_col and length_col in names:
        out = out.withColumn(length_col, F.length(F.coalesce(F.col(text_col), F.lit(""))).cast(docs.schema[length_col].dataType))
    return out
