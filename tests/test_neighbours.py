"""Nearest neighbours and donor fill against brute force."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from scrubjay.operators import neighbours as N
from scrubjay.operators import resolve as R

SCHEMA = "id long, vec array<double>"


def brute(ids, x, k, asked=None):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(unit @ unit.T, 9)
    out = {}
    for a in range(len(ids)):
        if asked is None or ids[a] in asked:
            out[ids[a]] = [n for _, n in sorted((-s[a, b], ids[b]) for b in range(len(ids)) if ids[b] != ids[a])[:k]]
    return out


def answers(df):
    out = {}
    for r in df.orderBy("id", "rank").collect():
        out.setdefault(r["id"], []).append(r["neighbour_id"])
        assert r["rank"] == len(out[r["id"]])
    return out


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    x[n // 4:n // 2] = x[0] + 0.05 * rng.standard_normal((n // 2 - n // 4, dim))  # a dense region
    x[n // 2:n // 2 + 40] = x[1]  # equal vectors
    x[n - 30:] *= 7.0  # length has no say
    return x


@pytest.mark.parametrize("n,dim,params", [(300, 16, {}), (900, 4, {"pivots": 6, "block": 25, "sample_values": 1024}), (600, 8, {"pivots": 1, "block": 64, "sample_values": 64})])
def test_neighbours_equal_brute_force(spark, n, dim, params):
    x, ids = clustered(n, dim, n), [3 * i - 100 for i in range(n)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], SCHEMA)
    assert answers(N.nearest_neighbours(df, "id", "vec", k=5, **params)) == brute(ids, x, 5)


def test_queries_against_all_rows(spark):
    x, ids = clustered(400, 6, 2), list(range(400))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], SCHEMA)
    got = R.vector_neighbours(df, "id", "vec", k=7, queries=df.filter(F.col("id") % 50 == 0))
    assert answers(got) == brute(ids, x, 7, set(range(0, 400, 50)))


def test_clustered_vectors_visit_few_blocks(spark):
    """What the rings rule out is never sent: most block meetings of well separated clusters are pruned."""
    rng = np.random.default_rng(1)
    x = (rng.standard_normal((20, 12)) * 5)[rng.integers(0, 20, 2000)] + 0.05 * rng.standard_normal((2000, 12))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    pivots = N.fit_pivots(unit[:300])
    a = np.arccos(np.clip(unit @ pivots.T, -1, 1))
    cell = a.argmin(axis=1)
    counts = np.zeros((len(pivots), N.BINS + 1), np.int64)
    np.add.at(counts, (cell, N._bins(a[np.arange(2000), cell])), 1)
    rings = N.Rings.build(pivots, counts, 50)
    tenth = np.sort(unit @ unit.T, axis=1)[:, -11]
    need = rings.needed(unit, tenth)
    assert need.mean() < 0.2
    near = unit @ unit.T >= tenth[:, None]
    own, _ = rings.home(unit, np.arange(2000))
    for q in range(0, 2000, 37):
        assert need[q, own[near[q]]].all()


def test_hard_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [2.0, 0.0]), (7, [1.0, 0.0]), (None, [1.0, 0.0]), (8, [-1.0, 1e-3]), (9, [None, 1.0])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("vid", F.lit("clash")).withColumn("block", F.lit(1))
    assert answers(N.nearest_neighbours(df, "id", "vec", k=3)) == {1: [6, 7, 8], 6: [1, 7, 8], 7: [1, 6, 8], 8: [1, 6, 7]}
    assert answers(N.nearest_neighbours(df.filter("id = 1"), "id", "vec", k=3)) == {}
    assert answers(N.nearest_neighbours(df.limit(0), "id", "vec", k=3)) == {}
    with pytest.raises(ValueError):
        N.nearest_neighbours(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], SCHEMA), "id", "vec")


def test_donor_fill_takes_the_nearest_and_flags_poor_ones(spark):
    rows = [(1, [1.0, 0.0], 10), (2, [0.0, 1.0], 20), (3, [0.9, 0.1], None), (4, [-1.0, 0.1], None), (5, None, None)]
    df = spark.createDataFrame(rows, "id long, vec array<double>, label int")
    got = {r["id"]: (r["label"], r["__flagged__"], r["__flag_reason__"]) for r in R.donor_fill(df, "id", "vec", "label").collect()}
    assert got[3] == (10, False, None) and got[1] == (10, False, None)
    assert got[4] == (20, True, "imputation:label") and got[5] == (None, True, "imputation_failed:label")


def test_blocks_grow_with_the_rows():
    """A query travels once a block: their number stays near that of the pivots until a block is full."""
    assert N.block_size(1000, 64, 32) == N.BLOCK
    assert N.block_size(500_000, 64, 32) == 15_625
    assert N.block_size(10 ** 9, 64, 32) * 64 == N.BLOCK_VALUES
    assert N.block_size(10 ** 9, 4096, 32) == N.BLOCK


def test_a_block_is_searched_in_slices(spark, monkeypatch):
    monkeypatch.setattr(N, "PRODUCT", 500)
    x, ids = clustered(300, 8, 4), list(range(300))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], SCHEMA)
    assert answers(N.nearest_neighbours(df, "id", "vec", k=5, pivots=2)) == brute(ids, x, 5)


def test_other_blocks_are_searched_without_a_shuffle(spark, monkeypatch):
    """Many blocks that all queries need: a query is packed once, not once a block, and the search has no exchange."""
    seen, search = [], N._search
    monkeypatch.setattr(N, "_search", lambda blocks, packs, *a: seen.append((blocks.count(), packs, search(blocks, packs, *a))) or seen[-1][2])
    rng = np.random.default_rng(6)
    x, ids = rng.standard_normal((500, 16)), list(range(500))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], SCHEMA)
    assert answers(N.nearest_neighbours(df, "id", "vec", k=5, pivots=4, block=20, sample_values=64)) == brute(ids, x, 5)
    (n_blocks, packs, found), = seen
    assert n_blocks >= 20 and sum(len(r["qids"]) // 8 for r in packs.collect()) == 500
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")
