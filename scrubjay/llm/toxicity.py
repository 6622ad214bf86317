"""Toxicity of documents: a support vector machine over a gap-weighted subsequence
string kernel with Nystrom landmarks.

Kernel. A unit is a word with a boundary mark on each side (ASCII letters in either case, Latin letters with marks,
digits and signs that look like a letter as that letter; other characters take a place but match nothing),
or a window of a run of one-character words (any signs, three or more letters) read as one ("i d i o t"), whatever the
run's length. Its features are all subsequences
of three symbols within ``SPAN`` places, each weighted by ``DECAY`` to the places it spans; the
kernel of two units is the normalised dot product. Characters put between or left out of an insult only
thin the weights, so "id-iot" and "idxiot" stay close to "idiot".

Landmarks. Words that mark toxic training documents, and the words of clean ones that look most like them, spread so
that no two are nearly equal. A unit's Nystrom features are its similarities to the landmarks, whitened by
the inverse root of the landmarks' own kernel matrix.

Training. A linear SVM (squared hinge) learns on these features from labelled sentences. Labels are given by
document, so a toxic document is represented by the most toxic unit of its most toxic sentences under the last
round's machine, and clean ones by the nearest units of all their sentences. A logistic curve over a document's three
highest sentence values gives the score; a sentence's value is that of its highest unit. The toxic words found, and the clean landmarks,
are also shown with gaps and put-in letters (``gapped``), each as a unit and as a sentence of its own, so a spelled-out insult counts where
a spelled-out harmless word does not.

Scoring. The machine is linear in the similarities, so all landmarks fold into one weight per triple: a unit costs
one table look-up per triple, and its norm only if it can pass ``LEAST``. Values per distinct unit are kept
in a bounded cache.

The fit uses at most ``n_toxic`` + ``n_clean`` labelled documents (those with the smallest hash of their id) and at most
``max_units`` of their units; scoring is one scan over whole texts, without a shuffle.

Defined cases: null and empty texts score as text without any similar unit; ids may be null or repeat (each
row is scored; of one id's labels the fit takes the toxic one, of its texts the smallest); without labels of both kinds every score is the share of toxic labels (0 without any); an empty
table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubjay.llm.textbytes import Chunk, chunks, owners, span_hashes, word_bounds
from scrubjay.session import ship_package

DECAY, SPAN = 0.65, 8
NEAR = 0.3        # similarity from which a unit of a training sentence is looked at
LEAST = -0.6      # unit values below this count as this
CACHE_UNITS = 1 << 20
WIDTH = 26       # places of a unit, boundary marks included; longer words are read in overlapping windows
RUN_WINDOWS = (8, 16, 32)  # characters of a window of a run, moved on by a quarter: words of up to 7, 13 and 25 letters lie whole in one
POSITIVE, NEGATIVE = 56, 40
DISTINCT = 0.5   # most similarity of a toxic word shown with gaps to any clean landmark
GAPPED_UNITS, GAPPED_SENTENCES = 0.5, 0.1  # weight of gapped spellings against the documents of their label, as units and under the curve
EDGE, NONE, SYMBOLS = 31, 32, 33

# symbol of each byte: letters, look-alikes (fixed values), marks on Latin letters by their second byte
_SYMBOL = np.full(256, NONE, np.uint8)
_SYMBOL[97:123] = _SYMBOL[65:91] = np.arange(26)
for _sign, _letter in {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}.items():
    _SYMBOL[ord(_sign)] = ord(_letter) - 97
_SYMBOL[0x80:0xC0] = 26 + np.arange(64) % 5
_LEAD = np.arange(256) >= 0xC0  # lead bytes are no places of their own


def _offsets() -> np.ndarray:
    return np.array([(j, k) for k in range(2, SPAN) for j in range(1, k)])


@dataclass
class Units:
    """Distinct units of a chunk (hash, a place in ``buf``) and, per occurrence, the unit
    and its sentence; ``sentence_first`` bounds the sentences by document."""

    buf: np.ndarray
    keys: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    unit: np.ndarray
    sentence: np.ndarray
    sentence_first: np.ndarray

    def blocks(self, which: np.ndarray, size: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Symbol rows of the units ``which``, by length: ``(which, rows)`` blocks."""
        order = which[np.argsort(self.ends[which] - self.starts[which], kind="stable")]
        for i in range(0, len(order), size):
            part = order[i:i + size]
            yield part, _symbol_rows(self.buf, self.starts[part], self.ends[part])


def _symbol_rows(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Padded symbol rows of byte spans: an edge mark, the symbols, an edge mark. Signs before the first and after the
    last symbol fall away."""
    length = ends - starts
    place = np.arange(int(length.max()) if len(length) else 0)
    at = starts[:, None] + place[None, :]
    inside = place[None, :] < length[:, None]
    byte = buf[np.minimum(at, max(len(buf) - 1, 0))] if len(buf) else np.zeros(at.shape, np.uint8)
    inside &= ~_LEAD[byte]
    sym = np.where(inside, _SYMBOL[byte], NONE)
    real = sym < NONE
    some = real.any(axis=1)
    lo = np.where(some, real.argmax(axis=1), 0)
    hi = np.where(some, real.shape[1] - 1 - real[:, ::-1].argmax(axis=1), -1)
    inside &= (place[None, :] >= lo[:, None]) & (place[None, :] <= hi[:, None])
    dest = np.cumsum(inside, axis=1)
    n = dest[:, -1] if dest.shape[1] else np.zeros(len(starts), np.int64)
    out = np.full((len(starts), int(n.max() if len(n) else 0) + 2), NONE, np.uint8)
    r, col = np.nonzero(inside)
    out[r, dest[r, col]] = sym[r, col]
    out[some, 0] = EDGE
    out[np.flatnonzero(some), n[some] + 1] = EDGE
    return out


def _run_windows(c: Chunk, ws: np.ndarray, we: np.ndarray, doc: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
    """``buf`` with the runs of one-character words behind it (one blank after each character), and per size of ``RUN_WINDOWS``
    the starts, ends and sentences of their windows. A run may hold any signs, and at least three letters."""
    lead = c.buf[ws]
    we = we - ((we - ws == 2) & (_SYMBOL[lead] < 26) & np.isin(c.buf[we - 1], list(b".,;:!?")))  # "t," ends a spelled word
    single = we - ws == np.select([lead < 0x80, lead < 0xE0, lead < 0xF0], [1, 2, 3], 4)
    letter = single & ((_SYMBOL[lead] < 26) | (we - ws == 2))
    go = single[1:] & single[:-1] & (doc[1:] == doc[:-1])
    run0 = np.flatnonzero(single & ~np.concatenate([[False], go]))
    run1 = np.flatnonzero(single & ~np.concatenate([go, [False]])) + 1
    letters = np.concatenate([[0], np.cumsum(letter)])
    some = letters[run1] - letters[run0] >= 3
    run0, n = run0[some], (run1 - run0)[some]
    if not len(n):
        return c.buf, []
    begin = np.cumsum(n) - n
    word = np.repeat(run0 - begin, n) + np.arange(n.sum())
    other = we[word] - ws[word] > 2  # matches nothing; one sign takes its place
    size = np.where(other, 1, we[word] - ws[word])
    end = np.cumsum(size + 1) - 1
    start = end - size
    text = np.full(end[-1] + 1, 32, np.uint8)
    text[start] = np.where(other, ord("-"), c.buf[ws[word]])
    two = np.flatnonzero(size == 2)
    text[start[two] + 1] = c.buf[ws[word[two]] + 1]
    out = []
    for i, width in enumerate(RUN_WINDOWS):
        step = width // 4
        fit = np.flatnonzero(n > RUN_WINDOWS[i - 1]) if i else np.arange(len(n))  # shorter runs are one window of the size before
        if not len(fit):
            break
        many = 1 + np.maximum(0, -((width - n[fit]) // step))
        w0 = np.repeat(begin[fit], many) + step * (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
        w1 = np.minimum(w0 + width, np.repeat((begin + n)[fit], many))
        out.append((len(c.buf) + start[w0], len(c.buf) + end[w1 - 1], sentence[word[w0]]))
    return np.concatenate([c.buf, text]), out


def units_of(c: Chunk) -> Units:
    """Units of a chunk. A sentence ends with a word that ends in ``.``, ``!`` or ``?`` or before a line break."""
    ws, we, first = word_bounds(c)
    n = len(ws)
    if not n:
        z = np.zeros(0, np.int64)
        return Units(c.buf, z, z, z, z, z, np.zeros(c.n + 1, np.int64))
    stop = np.isin(c.buf[we - 1], list(b".!?"))
    breaks = np.flatnonzero(c.buf == 10)
    stop[:-1] |= np.searchsorted(breaks, ws[1:]) > np.searchsorted(breaks, we[:-1])
    stop[np.maximum(first[1:][np.diff(first) > 0] - 1, 0)] = True
    sentence = np.concatenate([[0], np.cumsum(stop)[:-1]])
    sentence_first = np.concatenate([[0], np.cumsum(stop)])[first]
    # runs of one-character words become units more
    buf, runs = _run_windows(c, ws, we, owners(first), sentence)
    us, ue, s = ws, we, sentence
    body = WIDTH - 2
    long = we - ws > body
    if len(runs) or long.any():  # overlapping windows of runs and of long words are hashed in layers sorted by start and by end
        layers = [(ws[~long], we[~long], sentence[~long])]
        step = body // 2
        k, w0, w1, sl = 0, ws[long], we[long], sentence[long]
        while len(w0):
            layers.append((w0, np.minimum(w0 + body, w1), sl))
            more = w1 - w0 > body
            k, w0, w1, sl = k + 1, w0[more] + step, w1[more], sl[more]
        h = np.concatenate([span_hashes(c.buf, a, b, lower=True) for a, b, _ in layers]
                           + [span_hashes(buf[len(c.buf):], a - len(c.buf), b - len(c.buf), lower=True) for a, b, _ in runs])
        us, ue, s = (np.concatenate([x[i] for x in layers + runs]) for i in range(3))
    else:
        h = span_hashes(c.buf, us, ue, lower=True)
    keys, at, inv = np.unique(h, return_index=True, return_inverse=True)
    return Units(buf, keys, us[at], ue[at], inv, s, sentence_first)


_PLACES: dict[int, tuple] = {}


def _places(width: int) -> tuple:
    """First, second and third place and weight of every triple within a row of ``width`` places."""
    if width not in _PLACES:
        i, j, k = np.array([(i, i + j, i + k) for i in range(width) for k in range(2, SPAN) for j in range(1, k) if i + k < width],
                           np.int64).reshape(-1, 3).T
        _PLACES[width] = i, j, k, (DECAY ** (k - i + 1.0)).astype(np.float32)
    return _PLACES[width]


def triples(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and weights of all triples of the rows; one with a place that is no symbol has
    the code 0 and the weight 0."""
    i, j, k, w = _places(rows.shape[1])
    r = rows.astype(np.int32)
    gap = rows == NONE
    off = gap[:, i] | gap[:, j] | gap[:, k]
    code = (r[:, i] * SYMBOLS + r[:, j]) * SYMBOLS + r[:, k]
    code[off] = 0
    return code, np.where(off, np.float32(0), w)


def norms(codes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Exact norm of each row's feature vector (equal codes are added up first)."""
    if not codes.size:
        return np.zeros(len(codes))
    order = np.argsort(codes, axis=1)
    code, w = np.take_along_axis(codes, order, 1), np.take_along_axis(weight, order, 1).astype(np.float64)
    begin = np.ones(code.shape, bool)
    begin[:, 1:] = code[:, 1:] != code[:, :-1]
    flat = np.add.reduceat(w.reshape(-1), np.flatnonzero(begin.reshape(-1)))
    row = np.repeat(np.arange(len(code)), begin.sum(axis=1))
    return np.sqrt(np.bincount(row, weights=flat * flat, minlength=len(code)))


def rows_of(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(x) for x in raw]).astype(np.int64)
    return _symbol_rows(np.frombuffer(b"".join(raw), np.uint8), ends - [len(x) for x in raw], ends)


class Landmarks:
    """Landmark units; ``table[code]`` has their normalised feature weights, one column each."""

    def __init__(self, words: list[str]):
        self.words = words
        codes, weight = triples(rows_of(words))
        norm = np.maximum(norms(codes, weight), 1e-9)
        self.table = np.zeros((SYMBOLS ** 3, len(words)), np.float32)
        for j in range(len(words)):
            np.add.at(self.table[:, j], codes[j], weight[j] / norm[j])

    def similar(self, rows: np.ndarray) -> np.ndarray:
        """Kernel of each row with each landmark."""
        out = np.zeros((len(rows), len(self.words)), np.float32)
        for i in range(0, len(rows), 256):
            codes, weight = triples(rows[i:i + 256])
            if codes.size:
                out[i:i + 256] = np.einsum("nt,ntm->nm", weight, self.table[codes]) / np.maximum(norms(codes, weight), 1e-9)[:, None]
        return out


@dataclass
class Model:
    fold: np.ndarray | None  # weight of each triple code, all landmarks folded in
    bias: float
    curve: np.ndarray        # logistic over the three highest sentence values, bias last
    constant: float = 0.0
    serial: int = 0

    def unit_values(self, u: Units, which: np.ndarray) -> np.ndarray:
        """Machine value, at least LEAST, of the distinct units ``which``."""
        out = np.full(len(u.keys), LEAST, np.float32)
        for part, rows in u.blocks(which):
            codes, weight = triples(rows)
            if not codes.size:
                continue
            dot = (self.fold[codes] * weight).sum(axis=1)
            least = np.sqrt((weight * weight).sum(axis=1))  # at most the norm
            go = np.flatnonzero(dot > (LEAST - self.bias) * least)  # no other can pass
            if len(go):
                out[part[go]] = np.maximum(dot[go] / norms(codes[go], weight[go]) + self.bias, LEAST)
        return out[which]

    def scores(self, c: Chunk, cache: dict | None = None) -> np.ndarray:
        if self.fold is None:
            return np.full(c.n, self.constant)
        u = units_of(c)
        value = np.full(len(u.keys), np.nan)
        cache = {} if cache is None else cache
        if len(cache) + len(u.keys) > CACHE_UNITS:
            cache.clear()
        keys = u.keys.tolist()
        value = np.array([cache.get(k, np.nan) for k in keys], np.float64).reshape(-1)
        new = np.flatnonzero(np.isnan(value))
        if len(new):
            value[new] = self.unit_values(u, new)
            cache.update(zip([keys[i] for i in new], value[new].tolist()))
        hit = np.flatnonzero(value[u.unit] > LEAST)
        s, v = u.sentence[hit], value[u.unit[hit]]
        order = np.lexsort((-v, s))
        s, v = s[order], v[order]
        best = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
        doc = np.searchsorted(u.sentence_first, s[best], "right") - 1
        return self.curve_of(top_values(doc, v[best], c.n))

    def curve_of(self, top: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(top @ self.curve[:3] + self.curve[3], -30, 30)))


def top_values(doc: np.ndarray, f: np.ndarray, n: int) -> np.ndarray:
    """The three highest sentence values per document; missing ones are LEAST."""
    out = np.full((n, 3), LEAST)
    order = np.lexsort((-f, doc))
    d, f = doc[order], f[order]
    rank = np.arange(len(d)) - np.searchsorted(d, d)
    ok = rank < 3
    out[d[ok], rank[ok]] = np.maximum(f[ok], LEAST)
    return out


def fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 1000.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Linear SVM, squared hinge, by Newton steps on the rows inside the margin (weights sum to about one)."""
    xb = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    reg = np.concatenate([np.ones(x.shape[1]), [1e-3]])
    w = np.zeros(xb.shape[1])

    def loss(v: np.ndarray) -> float:
        return float(reg @ (v * v) / 2 + c * (weight * np.maximum(0, 1 - y * (xb @ v)) ** 2).sum())

    now = loss(w)
    for _ in range(rounds):
        live = y * (xb @ w) < 1
        xa, wa = xb[live], weight[live]
        step = np.linalg.solve(np.diag(reg) + 2 * c * (xa * wa[:, None]).T @ xa, 2 * c * xa.T @ (wa * y[live])) - w
        size = 1.0
        while size > 1e-3 and loss(w + size * step) > now:
            size /= 2
        w, before = w + size * step, now
        now = loss(w)
        if before - now < 1e-6 * before:
            break
    return w[:-1], float(w[-1])


def fit_curve(top: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Weighted logistic regression by Newton steps with a small ridge."""
    x = np.concatenate([top, np.ones((len(top), 1))], axis=1)
    w = np.zeros(4)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(4)
        w = w - np.linalg.solve(h, x.T @ (weight * (p - y)) + 1e-2 * w)
    return w


def _choose_landmarks(sample: DataFrame, n_toxic: int, n_clean: int) -> tuple[list[str], list[str]]:
    """(toxic, clean) words: words by how much more often documents of the toxic class hold them, then the
    clean class's words that look most like those."""
    words = sample.select("id", "toxic", F.explode(F.array_distinct(F.transform(
        F.split(F.lower("text"), r"[\x20\x09-\x0D]+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")))).alias("w"))
    words = words.filter(F.length("w").between(3, WIDTH - 2)).distinct()
    df = words.groupBy("w").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    pt, pc = (F.col("t") + 0.5) / (n_toxic + 1), (F.col("c") + 0.5) / (n_clean + 1)
    best = df.filter((F.col("t") >= 3) & (pt > 4 * pc)).orderBy((-F.col("t") * F.log(pt / pc)), "w").limit(20 * POSITIVE)
    found = [r["w"] for r in best.select("w").collect()]
    if not found:
        return [], []
    positive = _spread(found, np.arange(len(found)), POSITIVE, 0.85)
    common = [r["w"] for r in df.filter((F.col("c") >= 3) & (pt < 2 * pc)).orderBy(-F.col("c"), "w").limit(20_000).select("w").collect()]
    if common:
        sim = Landmarks(positive).similar(rows_of(common)).max(axis=1)
        order = np.argsort(-sim, kind="stable")
        return positive, _spread(common, order[sim[order] > NEAR], NEGATIVE, 0.9)
    return positive, []


def _spread(words: list[str], order: np.ndarray, most: int, limit: float) -> list[str]:
    """Words in the given order, without those nearly equal to one taken before."""
    some = [words[i] for i in order[:20 * most]]
    if not some:
        return []
    sim = Landmarks(some).similar(rows_of(some))
    taken: list[int] = []
    for i in range(len(some)):
        if len(taken) < most and not (sim[i, taken] > limit).any():
            taken.append(i)
    return [some[i] for i in taken]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        folds: int = 5, held_fold: int = 0, n_toxic: int = 1500, n_clean: int = 3000, max_units: int = 200_000) -> Model:
    """Fit on a bounded sample of the labelled rows whose crc32(id as text) mod ``folds`` is not ``held_fold``."""
    ship_package(docs.sparkSession)
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("toxic")).filter(
        F.col("id").isNotNull() & F.col("toxic").isin(0, 1) & (F.crc32(F.col("id").cast("string")) % folds != held_fold)).groupBy("id").agg(F.max("toxic").alias("toxic"))
    pick = lambda v, n: known.filter(F.col("toxic") == v).orderBy(F.xxhash64("id"), "id").limit(n)
    chosen = pick(1, n_toxic).unionByName(pick(0, n_clean))  # at most n_toxic + n_clean rows: safe to broadcast
    sample = (docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
              .join(F.broadcast(chosen), "id").groupBy("id", "toxic").agg(F.min("text").alias("text")).repartition(16, "id").persist())
    try:
        sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
        nt, nc = sizes.get(1, 0), sizes.get(0, 0)
        share = nt / (nt + nc) if nt + nc else 0.0
        bad, good = _choose_landmarks(sample, nt, nc) if nt and nc else ([], [])
        words = bad + good
        if not words:
            return Model(None, 0.0, np.zeros(4), share)
        marks = docs.sparkSession.sparkContext.broadcast(words)

        def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            land = Landmarks(marks.value)
            for b in batches:
                ids, toxic = b.column(0).to_numpy(), b.column(1).to_numpy()
                for c in chunks(b.column(2)):
                    doc, units = near_units(land, c)
                    blank = np.setdiff1d(np.arange(c.n), doc)  # a document without near units: one blank unit
                    doc, units = np.concatenate([doc, blank]), units + [""] * len(blank)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[c.lo + doc]), pa.array(toxic[c.lo + doc]), pa.array(units, pa.string())], names=["id", "toxic", "unit"])

        got = sample.select("id", "toxic", "text").mapInArrow(features, "id long, toxic int, unit string").orderBy(
            F.xxhash64("id", "unit"), "id", "unit").limit(max_units).toArrow()
    finally:
        sample.unpersist()
    ids, y = got["id"].to_numpy(), got["toxic"].to_numpy() * 2.0 - 1
    units, unit = np.unique(np.array(got["unit"].to_pylist(), object), return_inverse=True)
    _, doc = np.unique(ids, return_inverse=True)
    label = np.zeros(doc.max() + 1)
    label[doc] = y
    return _train(Landmarks(words), units.tolist(), unit, doc, label, len(bad))


def near_units(land: Landmarks, c: Chunk) -> tuple[np.ndarray, list[str]]:
    """Document and text of the two units of each sentence that come nearest to any landmark."""
    u = units_of(c)
    near = np.zeros(len(u.keys), np.float32)
    for part, rows in u.blocks(np.arange(len(u.keys)), 512):
        near[part] = land.similar(rows).max(axis=1, initial=0)
    hit = np.flatnonzero(near[u.unit] > NEAR)
    s, unit = np.unique(np.stack([u.sentence[hit], u.unit[hit]]), axis=1)
    order = np.lexsort((-near[unit], s))
    s, unit = s[order], unit[order]
    two = np.arange(len(s)) - np.searchsorted(s, s) < 2
    raw = u.buf.tobytes()
    return np.searchsorted(u.sentence_first, s[two], "right") - 1, [raw[u.starts[i]:u.ends[i]].decode("utf-8", "replace") for i in unit[two]]


def _train(marks: Landmarks, units: list[str], unit: np.ndarray, doc: np.ndarray, label: np.ndarray, n_bad: int) -> Model:
    """Fit on (document, unit) pairs; equal units are one row, weighted by how often they stand for a label.

    The first ``n_bad`` landmarks are the toxic words. Those that the machine calls toxic and that look like no clean landmark, and all
    clean landmarks, are also shown spelled with gaps: as units more, and as sentences of their own under the curve.
    """
    gram = marks.similar(rows_of(marks.words)).astype(np.float64)
    value, vec = np.linalg.eigh((gram + gram.T) / 2)
    root = vec @ np.diag(1 / np.sqrt(np.maximum(value, 1e-2))) @ vec.T
    z = marks.similar(rows_of(units + [""])) @ root  # the last row is the blank unit
    positive, negative = np.flatnonzero(label[doc] > 0), np.flatnonzero(label[doc] < 0)
    n_clean = max(1, (label < 0).sum())
    clean = np.bincount(unit[negative], minlength=len(z)).astype(float)
    clean_weight = 0.5 * clean / n_clean
    clean_weight[-1] += 0.5
    # at first a unit speaks for its label as often as it is found there
    toxic = np.bincount(unit[positive], minlength=len(z)).astype(float)
    start = 0.5 * np.concatenate([toxic / max(1, toxic.sum()), clean / max(1, clean.sum())])
    w, bias = _fit_units(z, start)
    for _ in range(4):
        f = (z @ w + bias)[unit]
        witness = positive[np.lexsort((-f[positive], doc[positive]))]
        d = doc[witness]
        witness = witness[(np.arange(len(d)) - np.searchsorted(d, d) < 2) & (f[witness] > bias)]
        toxic = np.bincount(unit[witness], minlength=len(z)).astype(float)
        w, bias = _fit_units(z, np.concatenate([0.5 * toxic / max(1, len(witness)), clean_weight]))
    toxic_word = gram @ root @ w + bias > 0
    if n_bad < len(marks.words):  # a word that looks like a clean one says too little once it is thinned
        toxic_word &= gram[:, n_bad:].max(axis=1) < DISTINCT
    shown = [(g, 1.0 if i < n_bad else -1.0) for i, m in enumerate(marks.words) if (i >= n_bad or toxic_word[i]) for g in gapped(m)]
    top, truth, weight = None, (label > 0).astype(float), np.ones(len(label))
    if any(y > 0 for _, y in shown):
        more = marks.similar(rows_of([g for g, _ in shown])) @ root
        y = np.array([y for _, y in shown])
        each = 1.0 / np.where(y > 0, max(1, (y > 0).sum()), max(1, (y < 0).sum()))
        w, bias = _fit_units(z, np.concatenate([0.5 * toxic / max(1, len(witness)), clean_weight]), more, y, 0.5 * GAPPED_UNITS * each)
        top = np.full((len(y), 3), LEAST)
        top[:, 0] = np.maximum(more @ w + bias, LEAST)
        weight = np.concatenate([weight, GAPPED_SENTENCES * each * np.where(y > 0, (label > 0).sum(), (label < 0).sum())])
        truth = np.concatenate([truth, (y > 0).astype(float)])
    f = (z @ w + bias)[unit]
    tops = top_values(doc, f, len(label))
    curve = fit_curve(tops if top is None else np.concatenate([tops, top]), truth, weight)
    serial = int(np.random.default_rng().integers(1 << 60))
    return Model((marks.table.astype(np.float64) @ (root @ w)).astype(np.float32), bias, curve, serial=serial)


def _fit_units(z: np.ndarray, weight: np.ndarray, more: np.ndarray | None = None, more_y: np.ndarray | None = None,
               more_weight: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """SVM over units, each as a toxic and as a clean row, and ``more`` rows with their labels; rows without weight are left out."""
    at = np.flatnonzero(weight)
    x, y, wt = z[at % len(z)], np.where(at < len(z), 1.0, -1.0), weight[at]
    if more is not None:
        x, y, wt = np.concatenate([x, more]), np.concatenate([y, more_y]), np.concatenate([wt, more_weight])
    return fit_svm(x, y, wt)


def gapped(word: str) -> list[str]:
    """The word spelled with blanks, dots or dashes between its letters, with blanks in a longer run, and with a letter put in at each inner place."""
    if len(word) < 4:
        return []
    runs = [" ".join(x) for x in ("an" + word, word + "so", "an" + word + "so")]  # as windows of a longer run show it
    return [sign.join(word) for sign in " .-"] + runs + [word[:i] + "x" + word[i:] for i in range(2, len(word) - 1)]


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_fold: int = 0) -> DataFrame:
    """``<id>, held_out, score, predicted`` per row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        if _CACHE.get("serial") != model.serial:
            _CACHE.clear()
            _CACHE.update(serial=model.serial, values={})
        for b in batches:
            for c in chunks(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(c.lo, c.n), pa.array(model.scores(c, _CACHE["values"]))], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double")
    held = F.coalesce(F.crc32(F.col("id").cast("string")) % folds == held_fold, F.lit(False))
    return out.select(F.col("id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


_CACHE: dict = {}  # values of distinct units under one model, per Python worker
