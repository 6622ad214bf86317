"""Metric expectations of the reference's unit tests, computed over tables."""
import pytest
from pyspark.sql import functions as F

from scrubjay.operators import metrics as M


def pairs(spark, ps):
    return spark.createDataFrame(ps, "a long, b long")


def scores(spark, pred, gold):
    return M.pair_scores(pairs(spark, pred), pairs(spark, gold)).first()


def test_pair_f1_perfect(spark):
    assert scores(spark, [(1, 2), (3, 4)], [(1, 2), (3, 4)])["pair_f1"] == pytest.approx(1.0, abs=1e-6)


def test_pair_f1_none(spark):
    assert scores(spark, [(1, 2)], [(3, 4)])["pair_f1"] == pytest.approx(0.0)


def test_pair_f1_partial(spark):
    s = scores(spark, [(1, 2), (3, 4), (5, 6)], [(1, 2), (3, 4)])
    assert 0.75 <= s["pair_f1"] <= 0.85 and s["pair_f1"] == pytest.approx(0.8, abs=1e-6)


def test_pair_f1_empty(spark):
    assert scores(spark, [], [])["pair_f1"] == 0.0


def test_precision_recall(spark):
    s = scores(spark, [(1, 2), (3, 4)], [(1, 2), (5, 6), (7, 8), (9, 10)])
    assert s["precision"] == pytest.approx(0.5, abs=1e-6)
    assert s["recall"] == pytest.approx(0.25, abs=1e-6)


def test_pairs_are_unordered(spark):
    assert scores(spark, [(2, 1)], [(1, 2)])["pair_f1"] == pytest.approx(1.0, abs=1e-6)


def audit(spark, b, a, f):
    return spark.createDataFrame([(b, a, f)], "rows_before long, rows_after long, flagged_record_count long")


@pytest.mark.parametrize("b,a,expected", [(100, 100, 1.0), (100, 50, 0.5), (0, 0, 1.0)])
def test_row_retention(spark, b, a, expected):
    assert M.audit_metrics(audit(spark, b, a, 0)).first()["row_retention_rate"] == pytest.approx(expected)


@pytest.mark.parametrize("f,expected", [(0, 1.0), (100, 0.0), (10, 0.9)])
def test_coercion_success(spark, f, expected):
    assert M.audit_metrics(audit(spark, 100, 100, f)).first()["coercion_success_rate"] == pytest.approx(expected)


def test_all_metrics_registered():
    assert len(M.METRICS) == 12
    assert M.METRICS["null_rate_delta"] is False
    assert all(v for k, v in M.METRICS.items() if k != "null_rate_delta")


def test_first_pass_rate_empty(spark):
    df = spark.createDataFrame([], "success boolean, retry_count int")
    assert M.first_pass_rate(df).first()[0] == 0.0


def test_cluster_pair_scores_match_listed_pairs(spark):
    import itertools
    rows = [(i, i // 3, i // 2) for i in range(12)]
    df = spark.createDataFrame(rows, "id long, p long, g long")
    s = M.cluster_pair_scores(df, "id", "p", "g").first()

    def listed(key):
        groups = {}
        for r in rows:
            groups.setdefault(r[key], []).append(r[0])
        return {tuple(sorted(x)) for g in groups.values() for x in itertools.combinations(g, 2)}
    p, g = listed(1), listed(2)
    assert (s["n_pred"], s["n_gold"], s["tp"]) == (len(p), len(g), len(p & g))


def test_task_scores_skip_unknown_and_zero_failed(spark):
    mv = spark.createDataFrame([("deduplication", "uniqueness_rate", 1.0), ("deduplication", "row_retention_rate", None),
                                ("deduplication", "bogus", 9.0)], "task string, metric string, value double")
    s = M.task_scores(mv).first()
    assert s["weighted_score"] == pytest.approx(0.5)
    o = M.overall_score(M.task_scores(mv), min_score=0.85).first()
    assert o["overall_weighted_score"] == pytest.approx(0.5) and o["passed"] is False


def test_completeness_formula(spark):
    df = spark.range(1).select(M.completeness_rate(F.lit(-0.2)).alias("c"), M.completeness_rate(F.lit(0.3)).alias("d"))
    r = df.first()
    assert r["c"] == pytest.approx(0.8) and r["d"] == 1.0


def test_imputation_confidence_counts_cells(spark):
    df = spark.createDataFrame([(0.5, 2), (0.8, 1), (None, 0)], "__imputed_confidence double, __imputed_cells int")
    assert abs(M.imputation_confidence_score(df).first()[0] - 0.6) < 1e-12
