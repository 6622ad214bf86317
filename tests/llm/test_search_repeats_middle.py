"""Ranked search, repeat removal and fill-in-the-middle against brute force on small tables."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scrubjay.llm import fill_middle, ranked_search, repeats
from scrubjay.llm.textbytes import chunks

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, n long, terms string, tie long, pack string"
LONG = " ".join(f"w{i % 97}x{i % 89}" for i in range(30000))
HARD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One two three. " * 400), (5, "One two three. " * 400), (None, "null id " * 30), (5, "Another text. " * 12),
        (6, "é" * 3000 + " ok"), (7, "a\n\nb\n\nc. d! e?"), (8, "tie text"), (9, "tie text"), (10, LONG), (11, "kept " + LONG), (12, "has <S> inside"), (13, "日本 <P <<M ab")]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2, "x", 3, "p") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def hard(spark):
    return table(spark, HARD)


@pytest.fixture(scope="module")
def texts(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


# ---------- ranked search

def terms(t):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_search(docs, items, k=10):
    bags = [(i, collections.Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    wanted = collections.defaultdict(set)
    for i, t in items:
        wanted[i] |= set(terms(t))
    out = set()
    for item, ts in wanted.items():
        scored = []
        for i, b in bags:
            m = 10 + 90 * sum(b.values()) * n_docs // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * b[t] // (1000 * b[t] + 8 * m)) for t in ts if b[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out |= {(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)}
    return out


def found(df):
    return [tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()]


@pytest.mark.parametrize("block_terms", [1, 200, 16384])
def test_search_equals_brute_force(spark, texts, block_terms):
    """Also with many blocks of items: the same rows whatever is shared."""
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()][:12 if block_terms == 1 else None]
    got = found(ranked_search.ranked_search(table(spark, texts), spark.createDataFrame(items, "item_id long, text string"), block_terms=block_terms))
    assert len(got) == len(set(got)) and set(got) == brute_search(texts, items)


def test_search_hard_rows(spark, hard):
    items = [(1, "ONE two"), (1, "tie"), (2, None), (3, ""), (4, "nowhere"), (None, "id null"), (5, "日本 é" + "é" * 2999), (6, "text text text tie")]
    got = found(ranked_search.ranked_search(hard, spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string"), k=4))
    want = brute_search(HARD, items, 4)
    assert {(i, r, s) for i, r, d, s in got} == {(i, r, s) for i, r, d, s in want} and len(got) == len(want)
    assert [(d, s) for i, r, d, s in sorted(got, key=str) if i == 6][:2] == [(8, want_s) for i, r, d, want_s in want if i == 6 and d == 8] + [(9, want_s) for i, r, d, want_s in want if i == 6 and d == 9]
    assert found(ranked_search.ranked_search(hard.limit(0), spark.createDataFrame(items, "item_id long, text string"))) == []
    assert found(ranked_search.ranked_search(hard, spark.createDataFrame([], "item_id long, text string"))) == []


def test_sharing_dag_sums_and_shares():
    rnd = random.Random(4)
    items = [sorted(rnd.sample(range(60), rnd.randint(0, 20))) for _ in range(80)]
    pairs, rows = ranked_search.sharing_dag(items, 60)
    value = [1 << t for t in range(60)]
    for x, y in pairs:
        assert value[x] & value[y] == 0
        value.append(value[x] + value[y])
    assert [sum(value[e] for e in r) for r in rows] == [sum(1 << t for t in x) for x in items]
    assert pairs and len(pairs) + sum(map(len, rows)) < 0.8 * sum(map(len, items))


# ---------- repeats

def brute_repeats(docs, window=20):
    """(doc_id, n_words, n_removed, kept) in the order (null first, id)."""
    seen, out = set(), []
    for i, t in docs:
        w = WORD.findall(t or "")
        gone = set()
        for s in range(len(w) - window + 1):
            x = tuple(w[s:s + window])
            if x in seen:
                gone.update(range(s, s + window))
            seen.add(x)
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return out


def cleaned(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in df.collect()), key=repr)


def planted(seed):
    """Unrelated documents with shared passages at every alignment, inner repeats, copies and near misses of 19 words."""
    rnd = random.Random(seed)
    fresh = lambda n: [f"{rnd.randrange(10 ** 9):x}" for _ in range(n)]
    passages = [fresh(n) for n in (19, 20, 21, 29, 30, 55, 80)]
    docs = []
    for i in range(90):
        w = fresh(rnd.randrange(40))
        for _ in range(rnd.randrange(4)):
            p = rnd.choice(passages)
            lo = rnd.randrange(max(1, len(p) - 19))
            w += p[lo:] + fresh(rnd.randrange(12))
        docs.append((i, " ".join(w)))
    return docs + [(200 + i, docs[5][1]) for i in range(30)] + [(300, " ".join(["same"] * 60)), (301, " ".join(["same"] * 25))]


@pytest.mark.parametrize("pack_bytes,bucket", [(1, 50), (3000, 500), (4 << 20, 4_000_000)])
def test_repeats_equal_brute_force(spark, pack_bytes, bucket):
    """One document a pack, some, and all in one; few and many buckets."""
    docs = planted(pack_bytes)
    got = cleaned(repeats.remove_repeats(table(spark, random.Random(1).sample(docs, len(docs))), pack_bytes=pack_bytes, bucket=bucket))
    assert got == sorted(brute_repeats(docs), key=repr) and sum(x[2] for x in got) > 2000


@pytest.mark.parametrize("window", [2, 5, 21])
def test_repeats_of_other_windows(spark, window):
    docs = planted(8)[:60]
    assert cleaned(repeats.remove_repeats(table(spark, docs), window=window, pack_bytes=500)) == sorted(brute_repeats(docs, window), key=repr)


def test_repeats_of_given_documents_and_spans(spark, texts):
    got = repeats.remove_repeats(table(spark, texts), pack_bytes=20000).cache()
    assert cleaned(got) == sorted(brute_repeats(sorted(texts)), key=repr)
    for r in got.filter("n_removed > 0").collect():
        spans = [tuple(x) for x in r["repeats"]]
        assert sum(e - s for s, e in spans) == r["n_removed"] and all(e - s >= 20 for s, e in spans)
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:])) and spans[-1][1] <= r["n_words"]


def test_repeats_hard_rows(spark, hard):
    got = cleaned(repeats.remove_repeats(hard, pack_bytes=100))
    order = sorted(HARD, key=lambda x: (x[0] is not None, x[0] or 0))
    want = sorted(brute_repeats(order), key=repr)  # the two equal rows of id 5 share no window with the third
    assert got == want
    assert cleaned(repeats.remove_repeats(hard.limit(0))) == []


# ---------- fill in the middle

TOKEN = re.compile("[A-Za-z]+|[^A-Za-z]")


def brute_middle(i, t):
    t = t or ""
    k = TOKEN.findall(t)
    x = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(x[a:a + 8], 16) for a in (0, 8, 16, 24))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return i, len(k), "plain", None, None, t
    a, b = sorted((h1 % (len(k) + 1), h2 % (len(k) + 1)))
    p, m, s = "".join(k[:a]), "".join(k[a:b]), "".join(k[b:])
    if h4 % 100 < 20:
        return i, len(k), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return i, len(k), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_equals_brute_force(spark, texts, hard):
    for rows in (texts, HARD):
        df = fill_middle.fill_in_middle(table(spark, rows))
        got = [tuple(r) for r in df.collect()]
        assert sorted(got, key=repr) == sorted((brute_middle(i, t) for i, t in rows), key=repr)
        back = df.select(fill_middle.restore(F.col("output"), F.col("form")).alias("t")).collect()
        assert collections.Counter(r["t"] for r in back) == collections.Counter(t or "" for _, t in rows)
    assert fill_middle.fill_in_middle(hard.limit(0)).count() == 0


def test_chunks_follow_content_and_summaries_are_shared():
    rnd = random.Random(2)
    shared = "".join(rnd.choice("abc dé\nZ.") for _ in range(6000))
    rows = ["x" * k + shared + "tail" * k for k in (0, 1, 50, 333)] + ["", "a" * 10000, "é" * 9000, shared]
    (c,) = chunks(pa.array(rows))
    at = fill_middle.chunk_bounds(c)
    assert set(c.offs.tolist()) <= set(at.tolist()) and np.diff(at).max() <= fill_middle.MAX_CHUNK + 3
    raw = c.buf.tobytes()
    parts = [raw[i:j] for i, j in zip(at[:-1], at[1:])]
    assert all(p.decode() for p in parts) and len(set(parts)) < 0.5 * len(parts)
    cache = fill_middle.SummaryCache(limit=4000)  # so small that generations change all the time
    for _ in range(2):
        for p, s in zip(parts, cache.summaries(parts)):
            t = p.decode()
            assert list(s) == [len(TOKEN.findall(t)), len(t), t[0].isascii() and t[0].isalpha(), t[-1].isascii() and t[-1].isalpha()]
    assert cache.used <= 4000 + fill_middle.MAX_CHUNK
