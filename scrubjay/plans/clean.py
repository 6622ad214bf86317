"""One-call cleaning of a table and multi-task evaluation.

``clean`` runs profile -> clean -> flag -> audit -> guard for one task. All
outputs are lazy DataFrames; the only driver reads are the one-row or
one-row-per-column summaries that choose defaults (inferred keys, types,
rules) and the one-row audit that decides the status.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubjay.functions.flags import FLAG, ensure_flags, split_flagged
from scrubjay.operators import coerce as CO
from scrubjay.operators import dedup as D
from scrubjay.operators import guard as G
from scrubjay.operators import impute as IM
from scrubjay.operators import linkage as LK
from scrubjay.operators import metrics as M
from scrubjay.operators import profile as P
from scrubjay.operators import resolve as R
from scrubjay.operators import standardize as S

TASKS = ("deduplication", "entity_resolution", "format_standardization", "missing_value_imputation", "type_coercion")


@dataclass
class CleanResult:
    clean: DataFrame
    flagged: DataFrame
    output: DataFrame
    audit: DataFrame
    status: str
    breaker_reason: str
    params: dict = field(default_factory=dict)


def _string_cols(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and not f.name.startswith("__")]


def run_task(df: DataFrame, task: str, **params) -> tuple[DataFrame, dict]:
    """The cleaning step of one task; returns (output, parameters actually used)."""
    if task == "deduplication":
        if params.get("mode", "exact") == "fuzzy":
            if not params.get("fuzzy_field") or not params.get("id_col"):
                raise ValueError("mode='fuzzy' needs fuzzy_field and id_col")
            out = R.fuzzy_dedup(df, params["id_col"], params["fuzzy_field"], params.get("fuzzy_threshold", 0.90))
            return ensure_flags(out), {"fuzzy_field": params["fuzzy_field"]}
        keys = params.get("key_fields") or D.infer_key_fields(
            P.profile_columns(df, order_by=params.get("order_by"), with_patterns=False, with_samples=False))
        return ensure_flags(D.dedup_exact(df, keys, order_by=params.get("order_by"))), {"key_fields": keys}
    if task == "entity_resolution" and params.get("match_fields"):
        options = {k: params[k] for k in ("match", "review", "algorithm", "block_exprs", "refine", "vector_col", "vector_top_k", "normalize") if k in params}
        return LK.resolve_entities(df, params["id_col"], params["match_fields"], **options), {"match_fields": params["match_fields"]}
    if task == "entity_resolution":
        cl = R.fuzzy_clusters(df, params["id_col"], params["match_field"], params.get("threshold", 0.85),
                              params.get("comparator", "levenshtein"))
        out = df.join(cl.withColumnRenamed("id", "__rid"), F.col(params["id_col"]) == F.col("__rid"), "left").drop("__rid")
        return ensure_flags(out), {}
    if task == "format_standardization":
        rules = params.get("field_rules")
        if not rules:
            cols = params.get("columns") or _string_cols(df)
            rules = [r.asDict() for r in S.infer_format_rules(df, cols, params.get("locale", S.DEFAULT_LOCALE),
                                                               params.get("min_confidence", 0.70)).collect()]
        elif any("field" in r for r in rules):
            return declared_formats(df, rules, params.get("locale", S.DEFAULT_LOCALE)), {"field_rules": rules}
        out = S.apply_format_rules(ensure_flags(df), [r for r in rules if r.get("rule")],
                                   params.get("locale", S.DEFAULT_LOCALE), params.get("target_format", "%Y-%m-%d"))
        return out, {"field_rules": rules}
    if task == "missing_value_imputation":
        cols = params.get("columns") or [c for c in df.columns if not c.startswith("__")]
        out = IM.impute(df, params.get("strategy_map"), cols, group_by=params.get("group_by"),
                        min_confidence=params.get("min_confidence", IM.DEFAULT_MIN_CONFIDENCE))
        return out, {"columns": cols}
    if task == "type_coercion":
        tm = params.get("type_map") or CO.type_map_from(CO.infer_types(df, min_confidence=params.get("min_confidence", 0.75)))
        return CO.coerce_types(df, tm), {"type_map": tm}
    raise ValueError(f"unknown task {task}")


def declared_formats(df: DataFrame, rules: list[dict], locale: str = S.DEFAULT_LOCALE) -> DataFrame:
    """Columns brought to their declared ``{field, target_format}``: a date layout (``%Y-%m-%d``), a phone template
    (``+86-{area}-{number}``), ``postal`` or ``money``. Values that do not parse become NULL and are flagged; any other target is refused.

    The layouts a date column is read with are those inferred from its values, or all known ones if no rule is inferred.
    """
    targets = {r["field"]: r["target_format"] for r in rules}
    other = [t for t in targets.values() if not ("%" in t or "{number}" in t or t in ("postal", "money"))]
    if other or len(targets) < len(rules) or not set(targets) <= set(df.columns):
        raise ValueError(f"field_rules need one known target_format per existing field: {rules}")
    dates = [c for c, t in targets.items() if "%" in t]
    found = {r["name"]: r["formats"] for r in S.infer_format_rules(df, dates, locale).collect()} if dates else {}  # one row a column
    out = ensure_flags(df)
    for c, target in targets.items():
        if "%" in target:
            out = S.standardize_dates(out, c, list(found.get(c) or S.CANDIDATE_DATE_FORMATS), target)
        elif "{number}" in target:
            out = S.standardize_phone(out, c, locale, template=target)
        else:
            out = S.standardize_postal(out, c, locale) if target == "postal" else S.standardize_money(out, c)
    return out


def clean(df: DataFrame, task: str, persist: bool = True, **params) -> CleanResult:
    """Run one cleaning task with audit and circuit breaker (L1).

    Status: ``complete`` when the breaker holds, ``human_review`` when it trips.
    The output is persisted (memory and disk) so audit, split and write reuse
    one computation.
    """
    out, used = run_task(df, task, **params)
    if persist:
        out = out.persist(StorageLevel.MEMORY_AND_DISK)
    limit = params.get("max_row_reduction", G.MAX_ROW_REDUCTION.get(task, G.DEFAULT_MAX_ROW_REDUCTION))
    audit = G.circuit_breaker(G.audit(df, out), limit)
    row = audit.first()  # one row
    status = "human_review" if row["circuit_breaker_hit"] else "complete"
    clean_df, flagged = split_flagged(out)
    return CleanResult(clean_df, flagged, out, audit, status, row["breaker_reason"], used)


def apply_custom(df: DataFrame, fn: Callable[[DataFrame], DataFrame], max_row_reduction: float = 0.30) -> CleanResult:
    """A user transformation under the audit contract (L3): the result keeps the
    flag columns and gets the same audit and breaker as built-in tasks."""
    out = ensure_flags(fn(df))
    audit = G.circuit_breaker(G.audit(df, out), max_row_reduction)
    row = audit.first()
    clean_df, flagged = split_flagged(out)
    return CleanResult(clean_df, flagged, out, audit, "human_review" if row["circuit_breaker_hit"] else "complete",
                       row["breaker_reason"])


def apply_custom_arrow(df: DataFrame, fn, schema: str, max_row_reduction: float = 0.30) -> CleanResult:
    """Per-partition form of L3: ``fn`` maps an iterator of Arrow record batches
    (``mapInArrow``), for logic that has no DataFrame expression.

    Rows before, rows after and flagged rows are counted by observations in the one pass that makes the persisted output. Both sit in
    the stage that writes it, so a task that runs again counts once. ``schema`` may name the two flag columns; without them no row is flagged.
    """
    from pyspark.sql import Observation

    from scrubjay.session import ship_package
    spark = df.sparkSession
    ship_package(spark)
    read, made = Observation(), Observation()
    out = ensure_flags(df.observe(read, F.count(F.lit(1)).alias("n")).mapInArrow(fn, schema))
    out = out.observe(made, F.count(F.lit(1)).alias("n"), F.count_if(F.col(FLAG)).alias("flagged")).persist(StorageLevel.MEMORY_AND_DISK)
    out.write.format("noop").mode("overwrite").save()
    counts = spark.createDataFrame([(read.get["n"], made.get["n"], made.get["flagged"])], "rows_before long, rows_after long, flagged_record_count long")
    audit = G.circuit_breaker(counts.select("rows_before", "rows_after", G.delta_rate(F.col("rows_before"), F.col("rows_after")).alias("row_delta_rate"),
                                            "flagged_record_count"), max_row_reduction)
    row = audit.first()
    clean_df, flagged = split_flagged(out)
    return CleanResult(clean_df, flagged, out, audit, "human_review" if row["circuit_breaker_hit"] else "complete", row["breaker_reason"])


def task_metrics(task: str, before: DataFrame, result: CleanResult, attempts: DataFrame | None = None,
                 gold_pairs: DataFrame | None = None, pred_pairs: DataFrame | None = None,
                 compliance_pattern: dict[str, str] | None = None, gold_col: str | None = None, id_col: str | None = None) -> DataFrame:
    """Metric rows ``task, metric, value`` for one run, as aggregates of its tables (L2): nothing is read on the driver.

    ``gold_pairs`` and ``pred_pairs`` (``a, b``) score entity resolution by pairs; ``gold_col`` names a column of the output with the true
    entity, which scores its ``canonical_id`` by cluster sizes. Without either it has no metrics.
    """
    cols = [c for c in before.columns if not c.startswith("__")]

    def rows(df: DataFrame, **vals: Column) -> DataFrame:
        """Metric rows of a one-row table."""
        return df.select(F.inline(F.array(*[F.struct(F.lit(task).alias("task"), F.lit(k).alias("metric"), v.cast("double").alias("value"))
                                            for k, v in vals.items()])))

    def delta() -> DataFrame:
        return IM.quality_delta(*(P.profile_columns(x.select(*cols), with_patterns=False) for x in (before, result.output)))

    audit = M.audit_metrics(result.audit)
    if task == "deduplication":
        first = M.first_pass_rate(attempts) if attempts is not None else result.audit.select(
            F.when(F.col("circuit_breaker_hit"), 0.0).otherwise(1.0).alias("script_first_pass_rate"))
        names = ("uniqueness_rate", "row_retention_rate", "script_first_pass_rate")
        return rows(audit.crossJoin(first), **{n: F.col(n) for n in names})  # one row each
    if task == "type_coercion":
        tm = result.params.get("type_map", {})
        rate = CO.type_consistency_rate(before, tm) if tm else audit.select(F.lit(0.0).alias("type_consistency_rate"))
        return rows(audit.select("coercion_success_rate").crossJoin(rate), type_consistency_rate=F.col("type_consistency_rate"),
                    coercion_success_rate=F.col("coercion_success_rate"))
    if task == "missing_value_imputation":
        full = delta().agg(M.completeness_rate(F.avg("null_rate_delta")).alias("completeness_rate"))
        return rows(full.crossJoin(M.imputation_confidence_score(result.output)), completeness_rate=F.col("completeness_rate"),
                    imputation_confidence_score=F.col("imputation_confidence_score"))
    if task == "format_standardization":
        rates = [rows(S.compliance_rate(result.output, c, p), format_compliance_rate=F.col("format_compliance_rate"))
                 for c, p in (compliance_pattern or {}).items()]
        null = M.null_rate_delta(delta())
        if not rates:
            return rows(null, format_compliance_rate=F.lit(0.0), null_rate_delta=F.col("null_rate_delta"))
        mean = reduce(DataFrame.unionByName, rates).groupBy("task", "metric").agg(F.avg("value").alias("value"))
        return mean.unionByName(rows(null, null_rate_delta=F.col("null_rate_delta")))
    if task == "entity_resolution" and gold_col is not None:
        score = M.cluster_pair_scores(result.output, id_col, "canonical_id", gold_col)
    elif task == "entity_resolution" and gold_pairs is not None and pred_pairs is not None:
        score = M.pair_scores(pred_pairs, gold_pairs)
    else:
        return before.sparkSession.createDataFrame([], "task string, metric string, value double")
    return rows(score, **{n: F.col(n) for n in ("pair_f1", "precision", "recall")})


def evaluate(metric_rows: list[DataFrame], min_score: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Union per-task metric rows -> weighted task scores -> overall score."""
    allm = reduce(DataFrame.unionByName, metric_rows)
    scores = M.task_scores(allm)
    return scores, M.overall_score(scores, min_score)


# ---------------------------------------------------------------- B12

def recommend_tasks(df: DataFrame, id_col: str | None = None, min_confidence: float = 0.70,
                    profile: DataFrame | None = None) -> DataFrame:
    """Rule-based task recommendation from a profile (B12): ``task, reason``.

    deduplication: duplicate-row rate > 0; missing_value_imputation: any NULL;
    format_standardization: white-space issue, or a string column where a
    format rule is inferred and more than one format signature occurs;
    type_coercion: a string column castable to a typed column;
    entity_resolution: a near-unique text column (unique rate >= 0.5, not
    castable to a typed column) whose values have neighbours at similarity >= 0.9.
    """
    spark = df.sparkSession
    df = df.persist(StorageLevel.MEMORY_AND_DISK)  # several summary passes read it
    try:
        return _recommend(spark, df, id_col, min_confidence, profile)
    finally:
        df.unpersist()


def _recommend(spark, df: DataFrame, id_col: str | None, min_confidence: float, profile: DataFrame | None) -> DataFrame:
    prof = profile if profile is not None else P.profile_columns(df, with_patterns=True)
    rows = prof.select("name", "null_rate", "unique_rate", "detected_issues", "dtype").collect()  # one row per column
    dup = P.duplicate_rate(df).first()["duplicate_row_rate"]
    out = []
    if dup > 0:
        out.append(("deduplication", f"duplicate_row_rate={dup:.4f}"))
    nulls = [r["name"] for r in rows if r["null_rate"] > 0]
    if nulls:
        out.append(("missing_value_imputation", "nulls:" + ",".join(nulls)))
    strings = _string_cols(df)
    ws = [r["name"] for r in rows if "leading_trailing_whitespace" in (r["detected_issues"] or [])]
    fmt = []
    if strings:
        rules = {r["name"]: r["rule"] for r in S.infer_format_rules(df, strings, min_confidence=min_confidence).collect()}
        sig_counts = {}
        m = P.melt(df, strings).filter(F.col("value").isNotNull())
        for r in (m.groupBy("ordinal").agg(F.countDistinct(P.format_signature(F.col("value"))).alias("k")).collect()):
            sig_counts[df.columns[r["ordinal"]]] = r["k"]
        fmt = [c for c in strings if rules.get(c) and sig_counts.get(c, 0) > 1]
    if ws or fmt:
        out.append(("format_standardization", "columns:" + ",".join(ws + [c for c in fmt if c not in ws])))
    typed = CO.type_map_from(CO.infer_types(df, strings, min_confidence=0.75)) if strings else {}
    if typed:
        out.append(("type_coercion", "columns:" + ",".join(c for c in strings if c in typed)))
    if id_col:
        for r in rows:
            text_like = r["name"] in strings and r["name"] not in typed
            if text_like and r["name"] != id_col and r["unique_rate"] >= 0.5:
                vals = R.value_groups(df, id_col, F.col(r["name"]))
                if R.similar_values(vals, 0.9).limit(1).count() > 0:
                    out.append(("entity_resolution", f"column:{r['name']}"))
                    break
    return spark.createDataFrame(out, "task string, reason string")
