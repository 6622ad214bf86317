"""Evaluation metrics as aggregations over tables.

Pair metrics come in two forms: over pair tables (distinct ``a < b``), and
over cluster assignments, where pair counts are computed from cluster and
contingency-cell sizes (``n(n-1)/2``) so no pair is ever materialised, even
for a cluster holding a third of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPS = 1e-9
DEFAULT_IMPUTATION_CONFIDENCE = 0.75

# Metric weights per task (reference task declarations).
TASK_WEIGHTS = [
    ("deduplication", "uniqueness_rate", 0.50),
    ("deduplication", "row_retention_rate", 0.30),
    ("deduplication", "script_first_pass_rate", 0.20),
    ("entity_resolution", "pair_f1", 0.50),
    ("entity_resolution", "precision", 0.25),
    ("entity_resolution", "recall", 0.25),
    ("format_standardization", "format_compliance_rate", 0.60),
    ("format_standardization", "null_rate_delta", 0.40),
    ("missing_value_imputation", "completeness_rate", 0.70),
    ("missing_value_imputation", "imputation_confidence_score", 0.30),
    ("type_coercion", "type_consistency_rate", 0.60),
    ("type_coercion", "coercion_success_rate", 0.40),
]
# The twelve registered metric names and whether higher is better.
METRICS = {
    "pair_f1": True, "precision": True, "recall": True, "completeness_rate": True, "uniqueness_rate": True,
    "row_retention_rate": True, "script_first_pass_rate": True, "format_compliance_rate": True,
    "null_rate_delta": False, "imputation_confidence_score": True, "type_consistency_rate": True,
    "coercion_success_rate": True,
}

_CUSTOM: dict[str, tuple[Column, bool]] = {}


def weights_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TASK_WEIGHTS, "task string, metric string, weight double")


def metric_registry(spark: SparkSession) -> DataFrame:
    rows = [(k, v) for k, v in METRICS.items()] + [(k, v[1]) for k, v in _CUSTOM.items()]
    return spark.createDataFrame(rows, "metric string, higher_is_better boolean")


# ---------- I1-I3 ----------

def ordered_pairs(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Distinct unordered pairs as ``(a, b)`` with ``a < b``; self pairs dropped."""
    return (pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
            .filter(F.col("a") != F.col("b")).distinct())


def pair_scores(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """One row ``tp, n_pred, n_gold, pair_f1, precision, recall`` from pair tables."""
    p, g = ordered_pairs(pred), ordered_pairs(gold)
    tp = p.join(g, ["a", "b"]).agg(F.count(F.lit(1)).alias("tp"))
    npd = p.agg(F.count(F.lit(1)).alias("n_pred"))
    ngd = g.agg(F.count(F.lit(1)).alias("n_gold"))
    return _scores(tp.crossJoin(npd).crossJoin(ngd))  # 1 x 1 x 1 rows


def _scores(row: DataFrame) -> DataFrame:
    tp, np_, ng = F.col("tp"), F.col("n_pred"), F.col("n_gold")
    return row.select(tp.cast("bigint").alias("tp"), np_.cast("bigint").alias("n_pred"),
                      ng.cast("bigint").alias("n_gold"),
                      (2 * tp / (np_ + ng + EPS)).alias("pair_f1"),
                      (tp / (np_ + EPS)).alias("precision"), (tp / (ng + EPS)).alias("recall"))


def cluster_pair_scores(assign: DataFrame, id_col: str, pred_col: str, gold_col: str) -> DataFrame:
    """Pair F1/precision/recall from two cluster assignments of the same ids.

    Pairs are implied, never listed: n_pred = sum C(|c|, 2) over predicted
    clusters, n_gold likewise, tp = sum C(|cell|, 2) over (pred, gold) cells.
    Three grouped counts, each combined map-side. Rows whose cluster id is
    NULL are singletons.
    """
    x = assign.select(F.col(id_col).alias("id"), F.coalesce(F.col(pred_col).cast("string"),
                                                            F.concat(F.lit("~"), F.col(id_col).cast("string"))).alias("p"),
                      F.coalesce(F.col(gold_col).cast("string"),
                                 F.concat(F.lit("~"), F.col(id_col).cast("string"))).alias("g"))

    def pairs(keys):
        return (x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
                .agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0)).cast("bigint").alias("v")))
    row = (pairs(["p", "g"]).select(F.col("v").alias("tp"))
           .crossJoin(pairs(["p"]).select(F.col("v").alias("n_pred")))
           .crossJoin(pairs(["g"]).select(F.col("v").alias("n_gold"))))
    return _scores(row)


# ---------- I4-I12: per-run metrics from audit / profile / attempts tables ----------

def completeness_rate(null_rate_delta: Column) -> Column:
    """Reference formula, as written: clamp(1 + delta) (I4)."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.0 + null_rate_delta))


def retention_rate(before: Column, after: Column) -> Column:
    """rows_after / rows_before clamped to [0, 1]; 1.0 when before = 0 (I5 proxy, I6)."""
    return F.when(before == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), after / before)))


def coercion_success_rate(before: Column, flagged: Column) -> Column:
    """max(0, 1 - flagged / max(before, 1))."""
    return F.greatest(F.lit(0.0), 1.0 - flagged / F.greatest(before, F.lit(1)))


def audit_metrics(audit_row: DataFrame) -> DataFrame:
    """Uniqueness proxy, retention and coercion success from a one-row audit."""
    b, a, f = F.col("rows_before"), F.col("rows_after"), F.col("flagged_record_count")
    return audit_row.select(retention_rate(b, a).alias("uniqueness_rate"),
                            retention_rate(b, a).alias("row_retention_rate"),
                            coercion_success_rate(b, f).alias("coercion_success_rate"))


def true_uniqueness(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """distinct rows / rows (I5, true form); 1.0 on an empty table."""
    cols = columns or df.columns
    d = df.select(*cols).distinct().agg(F.count(F.lit(1)).alias("d"))
    n = df.agg(F.count(F.lit(1)).alias("n"))
    return d.crossJoin(n).select(F.when(F.col("n") > 0, F.col("d") / F.col("n")).otherwise(F.lit(1.0))
                                 .alias("true_uniqueness"))


def first_pass_rate(attempts: DataFrame) -> DataFrame:
    """Share of attempts that succeeded with retry_count = 0; 0.0 when empty."""
    ok = F.col("success") & (F.coalesce(F.col("retry_count"), F.lit(0)) == 0)
    return attempts.agg(F.coalesce(F.avg(F.when(ok, 1.0).otherwise(0.0)), F.lit(0.0)).alias("script_first_pass_rate"))


def imputation_confidence_score(imputed: DataFrame) -> DataFrame:
    """Mean confidence over imputed cells; 0.75 when none.

    A row counts once per cell filled in it (``__imputed_cells``, as :func:`impute.impute`
    adds it; without that column one cell a row).
    """
    conf = F.col("__imputed_confidence")
    cells = F.col("__imputed_cells") if "__imputed_cells" in imputed.columns else F.lit(1)
    return imputed.agg(F.coalesce(F.sum(conf * cells) / F.sum(F.when(conf.isNotNull(), cells)), F.lit(DEFAULT_IMPUTATION_CONFIDENCE))
                       .alias("imputation_confidence_score"))


def null_rate_delta(delta_table: DataFrame) -> DataFrame:
    """Mean per-column null-rate delta (I9), from :func:`impute.quality_delta`."""
    return delta_table.agg(F.coalesce(F.avg("null_rate_delta"), F.lit(0.0)).alias("null_rate_delta"))


# ---------- I13-I15 ----------

def task_scores(metric_values: DataFrame, weights: DataFrame | None = None, signed: bool = False) -> DataFrame:
    """Weighted score per task (I13): ``task, weighted_score``.

    ``metric_values``: ``task, metric, value`` (value NULL = failed metric ->
    0.0). Metrics that are not registered are skipped. Values are rounded to
    4 dp before weighting, the sum again to 4 dp. ``signed=True`` negates
    lower-is-better metrics (the reference adds them as they are).
    """
    spark = metric_values.sparkSession
    weights = weights if weights is not None else weights_table(spark)
    reg = F.broadcast(metric_registry(spark))
    ran = metric_values.select("task").distinct()  # only tasks that produced metrics are scored
    w = weights.join(reg, "metric").join(ran, "task")  # unknown metrics drop out
    j = w.join(metric_values, ["task", "metric"], "left")
    v = F.round(F.coalesce(F.col("value"), F.lit(0.0)), 4)
    if signed:
        v = F.when(F.col("higher_is_better"), v).otherwise(-v)
    return j.groupBy("task").agg(F.round(F.sum(v * F.col("weight")), 4).alias("weighted_score"))


def overall_score(scores: DataFrame, min_score: float | None = None) -> DataFrame:
    """Mean of task scores without error, 0.0 if none (I14); gate.

    ``scores`` may carry an ``error`` column; rows with a non-NULL error are left out.
    """
    ok = F.col("error").isNull() if "error" in scores.columns else F.lit(True)
    out = scores.agg(F.round(F.coalesce(F.avg(F.when(ok, F.col("weighted_score"))), F.lit(0.0)), 4)
                     .alias("overall_weighted_score"))
    if min_score is not None:
        out = out.withColumn("passed", F.col("overall_weighted_score") >= min_score)
    return out


def register_metric(name: str, expr: Column, higher_is_better: bool = True) -> None:
    """User-defined metric (L4): an aggregate expression over an audit/attempts table."""
    _CUSTOM[name] = (expr, higher_is_better)


def custom_metrics(table: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Evaluate registered user metrics in one aggregation: ``metric, value`` rows."""
    names = names or list(_CUSTOM)
    if not names:
        return table.sparkSession.createDataFrame([], "metric string, value double")
    one = table.agg(*[_CUSTOM[n][0].cast("double").alias(f"m{i}") for i, n in enumerate(names)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"m{i}").alias("value"))
                                         for i, n in enumerate(names)])))
