"""Fuzzy matching against brute force; clustering; plan shape."""
import itertools
import random

import pytest
from pyspark.sql import functions as F

from scrubjay.functions.similarity import jaro_winkler_py
from scrubjay.operators import resolve as R


def lev(a, b):
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
        prev = cur
    return prev[-1]


def random_strings(n, seed=7):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abcde ") for _ in range(rnd.randint(1, 14))) for _ in range(n // 2)]
    out = list(base)
    for s in base:  # near copies: one or two edits
        t = list(s)
        for _ in range(rnd.randint(1, 2)):
            op = rnd.random()
            pos = rnd.randrange(len(t) + 1)
            if op < 0.4 and t:
                t[min(pos, len(t) - 1)] = rnd.choice("abcde")
            elif op < 0.7:
                t.insert(pos, rnd.choice("abcde"))
            elif t:
                del t[min(pos, len(t) - 1)]
        out.append("".join(t))
    return out


def values_df(spark, strings):
    rows = [(i, s) for i, s in enumerate(strings)]
    df = spark.createDataFrame(rows, "id long, v string")
    return R.value_groups(df, "id", F.col("v"))


@pytest.mark.parametrize("t", [0.6, 0.75, 0.8, 0.9])
def test_edit_prefix_join_is_lossless(spark, t):
    strings = random_strings(160)
    vals = values_df(spark, strings)
    vid = {r["value"]: r["vid"] for r in vals.collect()}
    got = {(r["va"], r["vb"]) for r in R.similar_values(vals, t).collect()}
    want = set()
    for a, b in itertools.combinations(vid, 2):
        m = max(len(a), len(b))
        sim = 1.0 if m == 0 else 1 - lev(a, b) / m
        if sim >= t:
            want.add((min(vid[a], vid[b]), max(vid[a], vid[b])))
    assert got == want


@pytest.mark.parametrize("t", [0.75, 0.85, 0.9])
def test_jaro_winkler_prefix_join_is_lossless(spark, t):
    strings = [s for s in random_strings(120, seed=3) if s]
    vals = values_df(spark, strings)
    vid = {r["value"]: r["vid"] for r in vals.collect()}
    got = {(r["va"], r["vb"]) for r in R.similar_values(vals, t, "jaro_winkler").collect()}
    want = {(min(vid[a], vid[b]), max(vid[a], vid[b])) for a, b in itertools.combinations(vid, 2)
            if jaro_winkler_py(a, b) >= t}
    assert got == want


def union_find(edges, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_connected_components(spark, shape):
    rnd = random.Random(5)
    if shape == "chain":
        edges = [(i, i + 1) for i in range(0, 60)]
    elif shape == "star":
        edges = [(1000, i) for i in range(50)] + [(i, i + 100) for i in range(0, 50, 7)]
    else:
        edges = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(70)]
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    edges = [e for e in edges if e[0] != e[1]]
    want = union_find(edges, nodes)
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r["node"]: r["component"] for r in R.connected_components(df).collect()}
    assert got == {n: min(k for k, v in want.items() if v == want[n]) for n in nodes}


def test_minhash_finds_near_duplicates(spark):
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    docs = []
    for d in range(30):
        docs.append(" ".join(rnd.choice(words) for _ in range(200)))
    rows = [(i, t) for i, t in enumerate(docs)]
    # near copies: change one word at the end (Jaccard of 3-shingles >= 0.97)
    rows += [(100 + i, t.rsplit(" ", 1)[0] + " zzz") for i, t in enumerate(docs[:10])]
    df = spark.createDataFrame(rows, "id long, text string")
    out = {r["id"]: r["canonical_id"] for r in R.near_duplicate_documents(df, "id", "text", 0.9).collect()}
    for i in range(10):
        assert out[100 + i] == i
    assert all(out[i] == i for i in range(30))


def test_near_duplicates_in_large_buckets(spark):
    """Pairs alike each other but not the smallest member of a bucket of more than 64."""
    rnd = random.Random(12)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for k in range(150):
        t = list(base)
        for j, at in enumerate(rnd.sample(range(298), 15)):
            t[at] = f"p{k}x{j}"
        rows += [(2 * k, " ".join(t)), (2 * k + 1, " ".join([*t[:-1], "zzz"]))]
    df = spark.createDataFrame(rows, "id long, text string")
    # four bands of one row: about half of the pairs meet in large buckets only
    out = {r["id"]: r["canonical_id"] for r in R.near_duplicate_documents(df, "id", "text", 0.9, num_hashes=4, bands=4).collect()}
    assert out == {i: i - i % 2 for i in range(300)}


def test_texts_without_likeness_are_not_stored(spark):
    """Disk: documents that no candidate pair names leave their keys in the checkpoint folder, neither texts nor shingle sets."""
    from pathlib import Path
    from urllib.parse import urlparse
    rnd = random.Random(13)
    rows = [(i, " ".join(f"w{rnd.randrange(10 ** 6)}" for _ in range(4000))) for i in range(40)]
    rows.append((40, rows[0][1] + " zzz"))
    df = spark.createDataFrame(rows, "id long, text string")
    folder = Path(urlparse(spark.sparkContext.getCheckpointDir()).path)
    used = lambda: sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())
    before = used()
    out = {r["id"]: r["canonical_id"] for r in R.near_duplicate_documents(df, "id", "text", 0.9).collect()}
    assert out == {**{i: i for i in range(40)}, 40: 0}
    assert used() - before < sum(len(t) for _, t in rows) / 4


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cartesian_or_nested_loop(spark):
    vals = values_df(spark, random_strings(40))
    for df in (R.similar_values(vals, 0.8), R.similar_values(vals, 0.85, "jaro_winkler")):
        p = _plan(df)
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_fellegi_sunter_separates_matches(spark):
    from pyspark.sql import functions as F
    rows = [(i, 1.0, 1.0) for i in range(50)] + [(100 + i, 0.3, 0.0) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, s1 double, s2 double")
    lv = R.comparison_levels(df, ["s1", "s2"])
    out, params = R.fellegi_sunter(lv, ["s1", "s2"])
    p = {r["id"]: r["match_probability"] for r in out.select("id", "match_probability").collect()}
    assert min(p[i] for i in range(50)) > 0.5 > max(p[100 + i] for i in range(500))
    assert 0 < params["lambda"] < 1


def test_fellegi_sunter_takes_u_from_random_pairs(spark):
    """Candidates all agree on the first field, which half of all pairs do: it may not count as strong evidence."""
    from pyspark.sql import functions as F
    n = 2000
    df = spark.range(n).select(F.col("id"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2)).alias("f"), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(100)).alias("g"))
    l, r = (df.select(F.col("id").alias(v), F.col("f").alias(f"{s}_f"), F.col("g").alias(f"{s}_g")) for v, s in (("va", "l"), ("vb", "r")))

    def levels(pairs):
        sc = R.score_pairs(pairs.join(l, "va").join(r, "vb"), [("f", "exact", 0.5), ("g", "exact", 0.5)])
        return R.comparison_levels(sc, ["sim_f", "sim_g"])

    drawn = R.random_pairs(df, "id")
    pairs = {(x["va"], x["vb"]) for x in drawn.collect()}
    assert pairs == {(x["va"], x["vb"]) for x in R.random_pairs(df.repartition(7), "id").collect()}
    assert all(a < b for a, b in pairs) and n < len(pairs) < 3 * n
    candidates = l.join(r, (F.col("l_f") == F.col("r_f")) & (F.col("l_g") == F.col("r_g")) & (F.col("va") < F.col("vb"))).select("va", "vb")
    _, fitted = R.fellegi_sunter(levels(candidates), ["sim_f", "sim_g"], random_levels=levels(drawn))
    share = {c: [x[0] / n for x in df.groupBy(c).count().select("count").collect()] for c in ("f", "g")}
    for k, c in enumerate(("f", "g")):  # u of agreement is the chance that two rows hold one value
        assert abs(fitted["u"][k][0] - sum(p * p for p in share[c])) < 0.03
    _, biased = R.fellegi_sunter(levels(candidates), ["sim_f", "sim_g"])
    assert biased["u"][0][0] > 0.9
    # no records: no pairs, and levels without any pair share u evenly
    assert R.random_pairs(df.limit(0), "id").count() == 0
    _, none = R.fellegi_sunter(levels(candidates), ["sim_f", "sim_g"], random_levels=levels(drawn).limit(0))
    assert none["u"][0] == [0.25] * 4


def _union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in list(parent)}


def test_components_child_with_two_parents(spark):
    from scrubjay.operators.resolve import connected_components
    edges = [(1, 4), (4, 3), (3, 5), (5, 2)]
    got = connected_components(spark.createDataFrame(edges, "src long, dst long"))
    assert {r["node"]: r["component"] for r in got.collect()} == {i: 1 for i in range(1, 6)}


def test_components_random_sparse_graphs(spark):
    """Sixty sparse random graphs, laid side by side in disjoint id ranges, equal union-find."""
    import random

    from scrubjay.operators.resolve import connected_components
    rnd = random.Random(5)
    edges = []
    for g in range(60):
        n = rnd.randint(2, 40)
        edges += [(g * 1000 + rnd.randrange(n), g * 1000 + rnd.randrange(n)) for _ in range(rnd.randint(1, n))]
    got = connected_components(spark.createDataFrame(edges, "src long, dst long"))
    want = {k: v for k, v in _union_find([e for e in edges if e[0] != e[1]]).items()}
    assert {r["node"]: r["component"] for r in got.collect()} == want


def test_components_round_limit_raises(spark):
    import pytest

    from scrubjay.operators.resolve import connected_components
    chain = spark.createDataFrame([(i, i + 1) for i in range(64)], "src long, dst long")
    with pytest.raises(RuntimeError):
        connected_components(chain, max_rounds=1)
