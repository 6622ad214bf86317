"""Ranked lexical search of many items at once, with common subexpressions evaluated once.

1. Items are taken in blocks of up to ``BLOCK_TERMS`` terms (at least one item), so what is sent to the tasks is bounded
   whatever the number of items; each block is one pass over all documents.
2. The driver mines a block for shared term sets: items list their terms from the most shared to the least, and neighbouring
   entries that two items or more have in common become a node of their own, again and again. The nodes form a directed acyclic graph: each is the sum of two earlier
   ones, and an item is the sum of the few entries it has left. Terms of one item only stay single.
3. One scan of the texts writes the documents' postings of the block's terms to the shared folder. Document frequencies, the number and the length
   of all documents come from these by grouped sums.
4. A second job turns postings into accumulators, documents by nodes, each node once for all items that share it, walks the graph
   and keeps the best ``k`` documents of each item in each task; the last step ranks these.

Scores are 64-bit integers, so results do not depend on the order of the sums. Terms are met by 64-bit hashes of their bytes.

Defined cases: null and empty texts have no terms; documents without terms count nowhere; an item without terms, or without any document above 0, has no
rows; rows that repeat an item id are one item with the terms of all of them (null ids too); rows that repeat a doc_id are documents of their own, a null doc_id
ranks behind equal scores; empty tables give an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrubjay.llm.textbytes import LOWER_MAP, Chunk, chunks, owners, span_hashes, word_bounds
from scrubjay.session import ensure_checkpoint_dir, ship_package

#: A term is a maximal run of these (ASCII letters and digits, and everything beyond ASCII).
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK_TERMS = 16384
SCORED_DOCS = 512

_TERM_BYTES = LOWER_MAP.copy()
_TERM_BYTES[[b for b in range(128) if not chr(b).isalnum()]] = 32
_POSTINGS = "id long, n long, terms array<int>, tfs array<int>"


def sharing_dag(items: list[list[int]], n_terms: int) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Nodes and items over them: node ``n_terms + i`` is the sum of the two entries of ``pairs[i]``.

    Each round merges every neighbouring pair that at least two items hold, the most frequent first and no entry twice.
    """
    held = Counter(t for x in items for t in x)
    rows = [sorted(x, key=lambda t: (-held[t], t)) for x in items]
    pairs: list[tuple[int, int]] = []
    while True:
        seen = Counter(p for x in rows for p in zip(x, x[1:]))
        used: set[int] = set()
        node: dict[tuple[int, int], int] = {}
        for p, n in sorted(seen.items(), key=lambda e: (-e[1], e[0])):
            if n < 2:
                break
            if not used & set(p):
                used.update(p)
                node[p] = n_terms + len(pairs)
                pairs.append(p)
        if not node:
            return pairs, rows
        for k, x in enumerate(rows):
            y, i = [], 0
            while i < len(x):
                made = node.get((x[i], x[i + 1])) if i + 1 < len(x) else None
                y.append(x[i] if made is None else made)
                i += 1 if made is None else 2
            rows[k] = y


def _terms_of(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of a chunk and ``first``: document i owns terms first[i]:first[i+1]."""
    t = Chunk(c.lo, c.hi, _TERM_BYTES[c.buf], c.offs)
    ws, we, first = word_bounds(t)
    return span_hashes(t.buf, ws, we, lower=False), first


def _hashes(terms: list[str]) -> np.ndarray:
    return np.concatenate([_terms_of(c)[0] for c in chunks(pa.array(terms, pa.string()))]) if terms else np.zeros(0, np.uint64)


def _lists(counts: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values.astype(np.int32)))


def _postings(docs: DataFrame, terms: list[str]) -> DataFrame:
    """``_POSTINGS`` per document with a term: its length and what it has of ``terms`` (their numbers, ascending) and how often."""
    h = _hashes(terms)
    order = np.argsort(h)
    table = h[order]
    maybe = np.zeros(1 << 16, bool)
    maybe[(h & np.uint64(0xFFFF)).astype(np.int64)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b.column(1)):
                x, first = _terms_of(c)
                n = np.diff(first)
                near = np.flatnonzero(maybe[(x & np.uint64(0xFFFF)).astype(np.int64)])
                at = np.searchsorted(table, x[near])
                at[at == len(table)] = 0
                hit = table[at] == x[near] if len(table) else np.zeros(0, bool)
                key, tf = np.unique(owners(first)[near[hit]] * len(table) + order[at[hit]], return_counts=True)
                some = np.flatnonzero(n)
                per = np.bincount(key // max(len(table), 1), minlength=c.n)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(c.lo, c.n).take(pa.array(some)), pa.array(n[some].astype(np.int64)),
                                                  _lists(per[some], key % max(len(table), 1)), _lists(per[some], tf)], names=["id", "n", "terms", "tfs"])

    return docs.mapInArrow(run, _POSTINGS)


def _best(postings: DataFrame, item_ids: list, weights: np.ndarray, pairs: list, rows: list, n_docs: int, length: int, k: int) -> DataFrame:
    """``item, id, score``: in each task, the best ``k`` documents of each item."""
    n_terms = len(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in rows]
        floor = np.ones(len(rows), np.int64)
        for whole in batches:
            for lo in range(0, whole.num_rows, SCORED_DOCS):
                b = whole.slice(lo, SCORED_DOCS)
                null = np.asarray(b.column(0).is_null())
                ids, n = np.asarray(b.column(0).fill_null(0)), np.asarray(b.column(1))
                terms, tf = np.asarray(b.column(2).flatten()), np.asarray(b.column(3).flatten()).astype(np.int64)
                doc = np.repeat(np.arange(len(n)), np.asarray(b.column(2).value_lengths()))
                m = 100 - 90 + 90 * n * n_docs // length
                acc = np.zeros((n_terms + len(pairs), len(n)), np.int64)
                acc[terms, doc] = weights[terms] * (1000000000 * tf // (1000 * tf + 8 * m[doc]))
                for i, (x, y) in enumerate(pairs, n_terms):
                    np.add(acc[x], acc[y], out=acc[i])
                for j, entries in enumerate(rows):
                    score = acc[entries].sum(axis=0)
                    at = np.flatnonzero(score >= floor[j])
                    if len(at):
                        s, d, z = (np.concatenate([p, q]) for p, q in zip(kept[j], (score[at], ids[at], null[at])))
                        first = np.lexsort((d, z, -s))[:k]
                        kept[j] = (s[first], d[first], z[first])
                        if len(first) == k:
                            floor[j] = s[first[-1]]
        for j, (s, d, z) in enumerate(kept):
            if len(s):
                yield pa.RecordBatch.from_arrays([pa.array([item_ids[j]] * len(s), pa.int64()), pa.array(d, mask=z), pa.array(s)], names=["item", "id", "score"])

    return postings.mapInArrow(run, "item long, id long, score long")


def _blocks(items: DataFrame, limit: int) -> Iterator[tuple[list, list[list[str]]]]:
    """Item ids and their terms, block by block; the driver holds one partition of items at a time."""
    ids, sets, size = [], [], 0
    for r in items.orderBy("item").toLocalIterator():
        if ids and size + len(r["terms"]) > limit:
            yield ids, sets
            ids, sets, size = [], [], 0
        ids.append(r["item"])
        sets.append(r["terms"])
        size += len(r["terms"])
    if ids:
        yield ids, sets


def ranked_search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", k: int = 10, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``<item>, rank, <id>, score``: the ``k`` documents of each item with the highest score above 0, equal scores by ascending id."""
    spark = docs.sparkSession
    ship_package(spark)
    folder = f"{ensure_checkpoint_dir(spark)}/search-{uuid.uuid4().hex}"
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = F.regexp_extract_all(F.translate(F.col(item_text_col), UPPER, LOWER), F.lit(TERM), F.lit(0))
    wanted = (items.select(F.col(item_col).cast("long").alias("item"), F.explode(found).alias("t")).distinct()
              .groupBy("item").agg(F.array_sort(F.collect_list("t")).alias("terms")))
    best = None
    for b, (ids, sets) in enumerate(_blocks(wanted, block_terms)):
        terms = sorted({t for x in sets for t in x})
        number = {t: i for i, t in enumerate(terms)}
        pairs, rows = sharing_dag([[number[t] for t in x] for x in sets], len(terms))
        _postings(texts, terms).write.parquet(f"{folder}/{b}")
        postings = spark.read.schema(_POSTINGS).parquet(f"{folder}/{b}")
        n_docs, length = postings.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(terms), np.int64)
        for r in postings.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most the terms of a block
            df[r["t"]] = r["count"]
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        part = _best(postings, ids, weights, pairs, rows, n_docs, length, k)
        best = part if best is None else best.unionByName(part)
    if best is None:
        best = spark.createDataFrame([], "item long, id long, score long")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last()))
    return best.withColumn("rank", place).filter(F.col("rank") <= k).select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")
