"""Search for tables of queries against the one-query rules in plain Python."""
import random

from pyspark.sql import functions as F

from scrubjay.operators import search as J

ENTRIES = [(1, "The Cat sat", ["Pets", "home"], 0.5), (2, None, ["cats"], 0.9), (3, "concatenate  the\ttheatre", None, 0.5), (4, "", [], 1.0), (5, "é x cat", ["home", None], None), (6, "the the", ["home", "home"], 0.7)]
QUERIES = [("a", "cat THE"), ("b", "the the cat"), ("c", ""), ("d", None), ("e", "zebra"), ("f", "e"), ("g", "at é"), ("h", "home")]


def table(spark, rows=ENTRIES):
    return spark.createDataFrame(rows, "id long, summary string, tags array<string>, prior double")


def brute(entries, queries, k):
    out = set()
    for q, text in queries:
        words = (text or "").lower().split()
        scored = []
        for i, summary, tags, prior in entries:
            low = " ".join([summary or "", *[t for t in (tags or []) if t is not None]]).lower()
            hit = sum(w in low for w in words)
            if hit:
                scored.append((-hit / len(words), prior is None, -(prior or 0), i))
        out |= {(q, r, x[3], round(-x[0], 9)) for r, x in enumerate(sorted(scored)[:k], 1)}
    return out


def found(df):
    return [(r["q"], r["rank"], r["id"], round(r["score"], 9)) for r in df.collect()]


def search(spark, entries, queries, k):
    q = spark.createDataFrame(queries, "q string, words string")
    return found(J.keyword_search_many(table(spark, entries), ["summary"], q, "id", "q", "words", k=k, tags_col="tags", prior_col="prior"))


def test_keyword_search_many_equals_the_rule(spark):
    for k in (2, 10):
        got = search(spark, ENTRIES, QUERIES, k)
        assert len(got) == len(set(got)) and set(got) == brute(ENTRIES, QUERIES, k)
    assert search(spark, ENTRIES[:0], QUERIES, 3) == [] and search(spark, ENTRIES, QUERIES[:0], 3) == []
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 6)))
    entries = [(i, " ".join(word() for _ in range(rnd.randint(0, 9))), [word()], rnd.choice([None, 1.0, 2.0])) for i in range(80)]
    queries = [(f"q{i}", " ".join(word() for _ in range(rnd.randint(1, 4)))) for i in range(25)]
    assert set(search(spark, entries, queries, 7)) == brute(entries, queries, 7)


def test_keyword_search_ties_keep_the_prior_order(spark):
    got = [r["id"] for r in J.keyword_search(table(spark), ["summary"], "home", "id", tags_col="tags", prior_col="prior").collect()]
    assert got == [6, 1, 5]  # equal scores: prior 0.7, 0.5, none


def test_tag_overlap_many(spark):
    q = spark.createDataFrame([("a", ["home", "Pets", "home"]), ("b", None), ("c", ["cats", None]), ("d", ["none"])], "q string, t array<string>")
    got = J.tag_overlap_many(table(spark), "tags", q, "q", "t", "id", "prior", k=2).collect()
    assert {(r["q"], r["rank"], r["id"], r["overlap"]) for r in got} == {("a", 1, 1, 2), ("a", 2, 6, 1), ("c", 1, 2, 1)}


def test_queries_meet_kinds_of_entries(spark, monkeypatch):
    """400 entries of two kinds, 30 queries of one: what is ranked grows with kinds and answers, not with entries times queries."""
    ranked, top = [], J._top
    monkeypatch.setattr(J, "_top", lambda df, *a: ranked.append(df.count()) or top(df, *a))
    entries = [(i, "red ring" if i % 2 else "ring", ["a", "b"] if i % 2 else ["a"], float(i % 50)) for i in range(400)]
    q = spark.createDataFrame([(f"q{i}", "ring red", ["b", "a"]) for i in range(30)], "q string, words string, t array<string>")
    want = sorted((i for i in range(400) if i % 2), key=lambda i: (-(i % 50), i))[:3]
    tags = J.tag_overlap_many(table(spark, entries), "tags", q, "q", "t", "id", "prior", k=3).collect()
    assert {(r["q"], r["rank"], r["id"], r["overlap"]) for r in tags} == {(f"q{i}", p, n, 2) for i in range(30) for p, n in enumerate(want, 1)}
    words = J.keyword_search_many(table(spark, entries), ["summary"], q, "id", "q", "words", k=3, prior_col="prior").collect()
    assert {(r["q"], r["rank"], r["id"], r["score"]) for r in words} == {(f"q{i}", p, n, 1.0) for i in range(30) for p, n in enumerate(want, 1)}
    assert max(ranked) <= 30 * 2 * 3


def test_tag_overlap_counts_repeated_rows(spark):
    q = spark.createDataFrame([("a", ["x", "y"]), ("a", ["x"]), (None, ["y"])], "q string, t array<string>")
    e = table(spark, [(1, "", ["x", "y"], 0.5), (1, "", ["y"], 0.5), (1, "", ["x"], 0.1), (None, "", ["y"], None)])
    got = J.tag_overlap_many(e, "tags", q, "q", "t", "id", "prior", k=9).collect()
    assert {(r["q"], r["rank"], r["id"], r["overlap"]) for r in got} == {("a", 1, 1, 4), ("a", 2, 1, 2), ("a", 3, None, 1), (None, 1, 1, 2), (None, 2, None, 1)}
