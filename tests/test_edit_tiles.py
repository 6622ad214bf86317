"""Edit-similarity candidates by tiles, and linkage where a side lacks a field."""
import random

import pytest

from scrubjay.operators import edit_tiles as E
from scrubjay.operators import linkage as L
from scrubjay.operators import resolve as R
from scrubjay.operators import string_joins as S


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def texts(n, longest, seed):
    rng = random.Random(seed)
    out = {"", "é\U0001f600x"}
    while len(out) < n:
        w = "".join(rng.choice("the aonéß") for _ in range(rng.randint(1, longest)))
        out.add(w)
        for _ in range(3):  # near ones
            k, c = rng.randrange(len(w) + 1), rng.choice("thx")
            w = w[:k] + c + w[k + rng.randint(0, 2):]
            out.add(w)
    return sorted(out)


@pytest.mark.parametrize("longest,t", [(30, 0.8), (70, 0.583), (200, 0.7)])
def test_bit_vectors_lose_no_pair(longest, t):
    v = [x for x in texts(90, longest, longest) if x]
    a, b = v[::2], v[1::2]
    want = {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if 1 - lev(x, y) / max(len(x), len(y)) >= t}
    assert want <= set(zip(*(k.tolist() for k in E.near_pairs(a, b, t)))) and want


@pytest.mark.parametrize("t", [0.583, 0.8])
def test_tiles_find_all_pairs(spark, t):
    """Many small tiles, two blocks, values above a machine word."""
    v = texts(150, 80, 3)
    rows = [(i, "ab"[i % 2], x, len(x)) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vid long, blk string, value string, len int")
    got = [(r["va"], r["vb"]) for r in E.tile_candidates(df, t, tile=7).collect()]
    want = {(i, j) for i, bi, x, _ in rows for j, bj, y, _ in rows if i < j and bi == bj and x and y and 1 - lev(x, y) / max(len(x), len(y)) >= t}
    assert want <= set(got) and len(set(got)) == len(got) and all(a < b for a, b in got)


def test_weak_prefixes_are_not_listed(spark, monkeypatch):
    """Below a threshold a gram prefix is most of a value: such joins go by tiles, and give the same pairs."""
    monkeypatch.setattr(S, "_gram_pairs", lambda *a: pytest.fail("gram prefixes at a low threshold"))
    v = texts(60, 40, 9)
    df = spark.createDataFrame([(i, "", x, 1) for i, x in enumerate(v)], "vid long, blk string, value string, n long")
    got = {(r["va"], r["vb"]) for r in R.similar_values(df, 0.6).collect()}
    assert got == {(i, j) for i, x in enumerate(v) for j, y in enumerate(v) if i < j and x and y and 1 - lev(x, y) / max(len(x), len(y)) >= 0.6 - 1e-12}


def test_string_ids_are_kept(spark):
    df = spark.createDataFrame([("a1", "", "some value", 10), ("b2", "", "some valuf", 10)], "vid string, blk string, value string, len int")
    assert [tuple(r) for r in E.tile_candidates(df, 0.7).collect()] == [("a1", "b2")]


def test_only_lacking_nodes_meet_over_lighter_fields(spark):
    """Of 600 nodes that share a host, two lack the title: only their pairs are looked at over the host, each once."""
    rows = [(i, None if i in (5, 300) else f"title {i}", "host.example.org") for i in range(600)]
    nodes = spark.createDataFrame(rows, "vid long, title string, host string")
    got = L._field_candidates(nodes, L.MatchField("host", 0.4, "jaro_winkler"), 0.6, ("title",))
    pairs = sorted(map(tuple, got.collect()))
    assert pairs == sorted({(min(i, j), max(i, j)) for i in (5, 300) for j in range(600) if i != j})
