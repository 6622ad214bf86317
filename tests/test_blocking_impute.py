"""Candidate pairs of several keys, exact quantiles and one-pass imputation against brute force."""
import collections
import datetime
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrubjay.operators import impute as IM
from scrubjay.operators.blocking import candidate_pairs
from scrubjay.operators.quantiles import exact_quantiles


def brute_pairs(rows, max_block, refined=True):
    """rows: id, (key, key), refine."""
    size = collections.Counter((i, k) for _, ks, _ in rows for i, k in enumerate(ks) if k is not None)
    out = {}
    for (a, ka, ra), (b, kb, rb) in itertools.combinations(sorted(rows), 2):
        for i, (x, y) in enumerate(zip(ka, kb)):
            if x is not None and x == y and (size[i, x] <= max_block or not refined or (ra is not None and ra == rb)):
                out[a, b] = i + 1
                break
    return out


@pytest.mark.parametrize("tile,refined", [(3, True), (1000, True), (7, False)])
def test_candidate_pairs_equal_brute_force(spark, tile, refined):
    rnd = random.Random(tile)
    rows = [(i, (rnd.choice(["hot", "hot", f"k{rnd.randrange(30)}", None]), f"s{rnd.randrange(25)}"), rnd.choice(["p", "q", "r", None])) for i in range(200)]
    df = spark.createDataFrame([(i, a, b, r, 1) for i, (a, b), r in rows], "id long, x string, y string, r string, g int")
    got = candidate_pairs(df, "id", [F.col("x"), F.col("y")], refine=F.col("r") if refined else None, max_block=20, tile=tile).collect()
    assert len(got) == len({(r["a"], r["b"]) for r in got})
    assert {(r["a"], r["b"]): r["block"] for r in got} == brute_pairs(rows, 20, refined)


def test_candidate_pairs_hard_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (None, "a"), (3, None), (4, "b")], "id long, x string")
    got = [tuple(r) for r in candidate_pairs(df, "id", [F.col("x")]).collect()]
    assert got == [(1, 2, 1)]  # of the two rows of id 1 the one with the smaller key counts
    assert candidate_pairs(df.limit(0), "id", [F.col("x")]).count() == 0


def test_exact_quantiles(spark):
    rng = np.random.default_rng(4)
    groups = {("a", None): rng.integers(0, 5, 3000), ("a", "g"): rng.standard_normal(777), ("b", "g"): np.array([7.0]), ("c", "h"): np.array([1.0, 2.0])}
    rows = [(k, g, float(v), 1) for (k, g), vs in groups.items() for v in vs] + [("d", "g", None, 1)]
    df = spark.createDataFrame(rows, "name string, grp string, v double, n long")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    for data in (df, df.groupBy("name", "grp", "v").agg(F.sum("n").alias("n"))):
        got = {(r["name"], r["grp"]): r for r in exact_quantiles(data, ["name", "grp"], "v", "n", probs).collect()}
        assert set(got) == set(groups)
        for k, vs in groups.items():
            assert np.allclose(got[k]["q"], np.percentile(vs, [100 * p for p in probs]), atol=1e-12)
            assert (got[k]["lo"], got[k]["hi"], got[k]["nn"]) == (vs.min(), vs.max(), len(vs))


def test_impute_types_groups_and_failures(spark):
    t = datetime.datetime(2024, 3, 1, 5)
    schema = "id int, g string, size int, price double, brand string, seen timestamp, tags map<string,int>, gone string, k array<int>"
    rows = [(1, "x", 1, 2.5, "b", t, {"a": 1, "b": 2}, None, [1]), (2, "x", None, 3.5, "b", None, {"b": 2, "a": 1}, None, [1]), (3, "x", 4, None, None, t, None, None, None),
            (4, "y", 10, 9.0, "a", None, {"c": 3}, None, [2]), (5, None, None, None, None, None, None, None, [2]), (6, None, 8, None, "z", None, None, None, None)]
    out = IM.impute(spark.createDataFrame(rows, schema), group_by="g", columns=["size", "price", "brand", "seen", "tags", "gone", "k"])
    got = {r["id"]: r for r in out.collect()}
    assert [got[i]["size"] for i in range(1, 7)] == [1, 2, 4, 10, 8, 8]  # the median 2.5 of group x is floored
    assert [got[i]["price"] for i in range(1, 7)] == [2.5, 3.5, 3.0, 9.0, 3.5, 3.5]  # group NULL has no price: the global median
    assert [got[i]["brand"] for i in range(1, 7)] == ["b", "b", "b", "a", "z", "z"]
    assert got[2]["seen"] == t and got[4]["seen"] == t and got[3]["tags"] == {"a": 1, "b": 2} and got[6]["k"] == [2]
    assert all("imputation_failed:gone" in r["__flag_reason__"] and r["gone"] is None for r in got.values())
    assert got[5]["__imputed_cells"] == 5 and got[1]["__imputed_cells"] == 0 and got[1]["__imputed_confidence"] is None
    assert out.columns == [*schema.replace("map<string,int>", "map").replace(",", "").split()[::2], "__flagged__", "__flag_reason__", "__imputed_confidence", "__imputed_cells"]


def test_impute_in_one_pass_whatever_the_number_of_columns(spark):
    """The plan joins the table once with groups, never without."""
    df = spark.range(100).select("id", *[F.when(F.col("id") % 7 > k, F.col("id") % 5).alias(f"c{k}") for k in range(5)], (F.col("id") % 3).alias("g"))
    for by, joins in ((None, 0), ("g", 1)):
        out = IM.impute(df, columns=[f"c{k}" for k in range(5)], group_by=by)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join ") == joins
        assert out.filter(" or ".join(f"c{k} is null" for k in range(5))).count() == 0


def test_approximate_medians_agree_on_small_input(spark):
    df = spark.range(101).select(F.when(F.col("id") != 50, F.col("id").cast("double")).alias("v"), (F.col("id") % 2).alias("g"))
    exact, close = (IM.fill_statistics(df, "v", "median", approx=a).first()["fill"] for a in (False, True))
    assert exact == 50.0 and abs(close - exact) <= 1
    assert {r["g"]: r["nn"] for r in IM.fill_statistics(df, "v", "median", group_by="g", approx=True).collect()} == {0: 50, 1: 50}
    with pytest.raises(ValueError):
        IM.fill_statistics(df, "v", "mean")


def test_capped_rate_below_and_above(spark):
    df = spark.createDataFrame([(i, "a" if i % 2 else "b", None if i < 2 else f"v{i % 2}") for i in range(40)], "id int, g string, v string")
    below = IM.impute_capped(df, "v", group_by="g", max_rate=0.05)
    assert {r["id"]: r["v"] for r in below.filter("id < 2").collect()} == {0: "v0", 1: "v1"}
    assert below.filter("__flagged__").count() == 0
    above = IM.impute_capped(df, "v", group_by="g", max_rate=0.01)
    assert [r["__flag_reason__"] for r in above.filter("id < 2").collect()] == ["imputation:v;imputation_capped:v"] * 2
