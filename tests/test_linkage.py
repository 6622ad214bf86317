"""Weighted linkage over several fields against brute force over all pairs."""
import itertools

import pytest
from pyspark.sql import functions as F

from scrubjay.functions.similarity import jaro_winkler_py
from scrubjay.operators import linkage as L
from scrubjay.operators.metrics import cluster_pair_scores
from scrubjay.plans.clean import clean, task_metrics

FIELDS = [("name", 0.6, "jaro_winkler"), ("street", 0.3, "levenshtein"), ("phone", 0.1, "exact")]


def _lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return 1 - row[-1] / max(len(a), len(b)) if a or b else 1.0


_SIM = {"jaro_winkler": jaro_winkler_py, "levenshtein": _lev, "exact": lambda a, b: float(a == b)}


def _brute(rows, fields, review):
    out = {}
    for x, y in itertools.combinations(sorted({r[1:]: r for r in sorted(rows, reverse=True, key=lambda r: r[0])}.values(), key=lambda r: r[0]), 2):
        both = [(w, _SIM[c](x[i], y[i])) for i, (_, w, c) in enumerate(fields, 1) if x[i] is not None and y[i] is not None]
        score = round(sum(w * s for w, s in both) / sum(w for w, _ in both), 9) if both else 0.0
        if score >= review:
            out[x[0], y[0]] = score
    return out


def _rows(n=60):
    names = ["anna meyer", "anna meier", "ana meyer", "bert olsen", "bert ohlsen", "carla diaz", "karla diaz", "dora kim"]
    streets = ["long road 1", "long road 11", "short lane 2", "short lane 22", "hill 5"]
    phones = ["111", "222", "333"]
    pick = lambda xs, i, every: None if i % every == 0 else xs[(i * 7919 >> 3) % len(xs)]
    rows = [(i, pick(names, i, 5), pick(streets, i * 3 + 1, 4), pick(phones, i + 2, 7)) for i in range(n)]
    return rows + [(n, None, None, None), (n + 1, None, None, None)]


@pytest.mark.parametrize("weights, review", [((0.6, 0.3, 0.1), 0.75), ((0.6, 0.3, 0.1), 0.9), ((1.0, 1.0, 1.0), 0.7)])
def test_candidates_lose_no_pair(spark, weights, review):
    fields = [(n, w, c) for (n, _, c), w in zip(FIELDS, weights)]
    df = spark.createDataFrame(_rows(), "id long, name string, street string, phone string")
    members, pairs = L.link_records(df, "id", [L.MatchField(*f) for f in fields], match=0.95, review=review)
    got = {(r["va"], r["vb"]): r["score"] for r in pairs.collect()}
    want = _brute(_rows(), fields, review)
    assert got.keys() == want.keys() and len(want) > 20
    assert all(abs(got[k] - want[k]) < 1e-8 for k in want)
    assert {r["decision"] for r in pairs.collect()} <= {"match", "review"} and members.count() == 62


def test_hot_values_are_dealt_into_tiles(spark, monkeypatch):
    monkeypatch.setattr(L, "TILE", 4)
    rows = [(i, "one name", f"street {i:03d}", None) for i in range(40)] + [(100 + i, f"other {i}", None, None) for i in range(3)]
    df = spark.createDataFrame(rows, "id long, name string, street string, phone string")
    _, pairs = L.link_records(df, "id", [L.MatchField(*f) for f in FIELDS])
    got = [(r["va"], r["vb"]) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == _brute(rows, FIELDS, 0.75).keys()


def test_cover_is_by_lead_or_by_average():
    by_lead = L.cover([L.MatchField(*f) for f in FIELDS], 0.75)
    assert [(f.name, round(t, 4), no) for f, t, no in by_lead] == [
        ("name", 0.5833, ()), ("street", 0.6667, ("name",)), ("phone", 0.75, ("name", "street"))]
    assert [(f.name, t) for f, t, _ in L.cover([L.MatchField(n, 1.0, c) for n, _, c in FIELDS], 0.7)] == [("name", 0.7), ("street", 0.7), ("phone", 0.7)]


def test_entities_review_band_and_odd_rows(spark):
    rows = [(1, "anna meyer", "long road 1", "1"), (2, "anna meyer", "long road 1", "1"), (2, "anna meyer", "long road 1", "1"),
            (3, "anna meier", "long road 1", "1"), (4, "anna meyer", "hill 5", "9"), (5, None, None, None), (None, "anna meyer", "long road 1", "1")]
    df = spark.createDataFrame(rows, "id long, name string, street string, phone string").withColumn("vid", F.lit("clash"))
    res = clean(df, "entity_resolution", id_col="id", match_fields=[dict(zip(("name", "weight", "comparator"), f)) for f in FIELDS], review=0.6)
    got = {(r["id"], r["canonical_id"], r["__flagged__"], r["vid"]) for r in res.output.collect()}
    assert got == {(1, 1, True, "clash"), (2, 1, True, "clash"), (3, 1, True, "clash"), (4, 4, True, "clash"), (5, 5, False, "clash"), (None, None, False, "clash")}
    assert res.output.count() == 7 and res.status == "human_review"  # five of seven rows are flagged
    gold = res.output.filter("id is not null").distinct().withColumn("gold", F.when(F.col("id") <= 3, 1).otherwise(F.col("id")))
    assert cluster_pair_scores(gold, "id", "canonical_id", "gold").first()["tp"] == 3
    empty = clean(df.limit(0), "entity_resolution", id_col="id", match_fields=[L.MatchField("name", 1.0)])
    assert empty.output.count() == 0 and "canonical_id" in empty.output.columns
    assert task_metrics("entity_resolution", df, res).count() == 0


def test_declared_blocks_vectors_and_probability(spark):
    rows = [(1, "anna meyer", "a", [1.0, 0.0]), (2, "anna meier", "b", [1.0, 0.1]), (3, "anna mayer", "a", [0.0, 1.0]), (4, "zed", "b", [0.1, 1.0])]
    df = spark.createDataFrame(rows, "id long, name string, blk string, vec array<double>")
    ids = lambda **o: {(r["va"], r["vb"]) for r in L.link_records(df, "id", [L.MatchField("name", 1.0)], match=0.85, review=0.75, **o)[1].collect()}
    assert ids() == {(1, 2), (1, 3), (2, 3)}
    assert ids(block_exprs=[F.col("blk")]) == {(1, 3)}
    assert ids(algorithm="vector", vector_col="vec", vector_top_k=1) == {(1, 2)}
    assert ids(algorithm="hybrid", vector_col="vec", vector_top_k=1) == {(1, 2), (1, 3), (2, 3)}
    assert ids(algorithm="probabilistic") <= ids()
    for bad in ({"algorithm": "other"}, {"algorithm": "vector"}):
        with pytest.raises(ValueError):
            ids(**bad)
    for fields in ([], [{"name": "name", "weight": 0}], [{"name": "name", "weight": 1, "comparator": "soundex"}]):
        with pytest.raises(ValueError):
            L.match_fields(fields)
