"""Column profiling.

Everything here is a handful of aggregation jobs, however wide or long the
table is:

* one scan computes row count, per-column NULL counts, white-space flags and
  (optionally) HyperLogLog distinct counts for all columns together;
* exact distinct counts melt the table to ``(column, value)`` and group twice,
  which avoids the k-fold ``Expand`` of k ``count(DISTINCT)`` and lets the
  first grouping combine map-side, so a hot value never reaches one task
  whole;
* sample values are k bounded top-n plans (TakeOrderedAndProject);
* the duplicate-row rate is one ``groupBy(all columns)``.

Only one-row or one-row-per-column results ever leave the executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubjay.functions.text import UNICODE_STRIP_RE
from scrubjay.sources.io import sample_first

# Fixed values from the reference's profiler (thresholds and issue names).
HIGH_NULL_RATE = 0.10
LOW_CARDINALITY_RATE = 0.01
LOW_CARDINALITY_MIN_ROWS = 100
SAMPLE_VALUES = 10
DEFAULT_SAMPLE_SIZE = 500


def groupable(df: DataFrame) -> DataFrame:
    """Replace MAP columns (not hashable/comparable in Spark) by sorted entry arrays."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.MapType):
            out.append(F.array_sort(F.map_entries(F.col(f.name))).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def value_text(c: Column, dtype: T.DataType) -> Column:
    """Lossless text form of a value, used for distinct counting and samples."""
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    if isinstance(dtype, T.BinaryType):
        return F.hex(c)
    return c.cast("string")


def _one_form(df: DataFrame) -> DataFrame:
    """Equal values in one form, so that their text is equal too: -0.0 as 0.0, map entries sorted."""
    out = groupable(df)
    zero = {f.name: F.col(f"`{f.name}`") + F.lit(0.0).cast(f.dataType)
            for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return out.withColumns(zero) if zero else out


def _restrict(df: DataFrame, sample_size: int | None, order_by) -> DataFrame:
    if sample_size is None:
        return df
    return sample_first(df, sample_size, order_by or [F.monotonically_increasing_id()])


def table_shape(df: DataFrame) -> DataFrame:
    """(B1) rows and columns."""
    return df.agg(F.count(F.lit(1)).alias("total_rows"),
                  F.lit(len(df.columns)).cast("int").alias("total_columns"))


def _is_string(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.VarcharType, T.CharType))


def column_stats(df: DataFrame, approx: bool = False) -> DataFrame:
    """One scan: per column ``null_count``, ``has_ws`` and (approx) ``n_unique``.

    Output: ``ordinal, name, dtype, total, null_count, has_ws, approx_unique``.
    """
    fields = df.schema.fields
    aggs = [F.count(F.lit(1)).alias("__total")]
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        aggs.append(F.count_if(c.isNull()).alias(f"__n{i}"))
        if _is_string(f.dataType):
            aggs.append(F.bool_or(c != F.regexp_replace(c, UNICODE_STRIP_RE, "")).alias(f"__w{i}"))
        if approx:
            # struct(c) keeps NULL as a value, like the reference's n_unique
            aggs.append(F.approx_count_distinct(F.struct(value_text(c, f.dataType))).alias(f"__u{i}"))
    one = df.agg(*aggs)
    rows = []
    for i, f in enumerate(fields):
        rows.append(F.struct(
            F.lit(i).alias("ordinal"), F.lit(f.name).alias("name"),
            F.lit(f.dataType.simpleString()).alias("dtype"),
            F.col("__total").alias("total"), F.col(f"__n{i}").alias("null_count"),
            (F.coalesce(F.col(f"__w{i}"), F.lit(False)) if _is_string(f.dataType) else F.lit(False)).alias("has_ws"),
            (F.col(f"__u{i}").cast("bigint") if approx else F.lit(None).cast("bigint")).alias("approx_unique")))
    return one.select(F.inline(F.array(*rows)))


def melt(df: DataFrame, columns: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Long form ``(ordinal, value)`` (+ ``keep`` columns) with values as lossless text."""
    keep = keep or []
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    items = [F.struct(F.lit(i).alias("ordinal"), value_text(F.col(f"`{f.name}`"), f.dataType).alias("value"))
             for i, f in enumerate(df.schema.fields) if f in fields]
    return df.select(*keep, F.inline(F.array(*items)))


def distinct_counts(df: DataFrame) -> DataFrame:
    """Exact distinct count per column, NULL counted as one value, 0.0 and -0.0 as one, maps by content.

    ``(ordinal, n_unique)``; two groupings over the melted table.
    """
    return (melt(_one_form(df)).select("ordinal", "value").distinct()
            .groupBy("ordinal").agg(F.count(F.lit(1)).alias("n_unique")))


def sample_values(df: DataFrame, order_by: list, n: int = SAMPLE_VALUES) -> DataFrame:
    """First ``n`` non-NULL values of every column as text.

    One bounded top-n plan per column (each reads only the key columns and
    that column), unioned; ``(ordinal, sample_values)``.
    """
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order_by]
    parts = []
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        top = (df.filter(c.isNotNull())
               .select(F.struct(*order_cols).alias("__k"), value_text(c, f.dataType).alias("value"))
               .orderBy("__k").limit(n))
        parts.append(top.select(F.lit(i).alias("ordinal"), "__k", "value"))
    if not parts:
        return df.sparkSession.createDataFrame([], "ordinal int, sample_values array<string>")
    allv = reduce(DataFrame.unionByName, parts)
    return (allv.groupBy("ordinal")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("__k", "value"))), lambda s: s["value"])
                 .alias("sample_values")))


def duplicate_rate(df: DataFrame) -> DataFrame:
    """(B8) ``total_rows, distinct_rows, duplicate_row_rate`` (unrounded)."""
    g = groupable(df)
    counts = g.groupBy(*[F.col(f"`{c}`") for c in g.columns]).agg(F.count(F.lit(1)).alias("__c"))
    return counts.agg(
        F.coalesce(F.sum("__c"), F.lit(0)).cast("bigint").alias("total_rows"),
        F.count(F.lit(1)).alias("distinct_rows")).select(
        "total_rows", "distinct_rows",
        F.when(F.col("total_rows") > 0, 1.0 - F.col("distinct_rows") / F.col("total_rows"))
         .otherwise(F.lit(0.0)).alias("duplicate_row_rate"))


def format_signature(c: Column) -> Column:
    """Digits -> 9, upper-case letters -> A, lower-case letters -> a; rest kept."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[0-9]", "9"), "\\p{Lu}", "A"), "\\p{Ll}", "a")


def format_patterns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Dominant format signature per string column (B14): ``(ordinal, format_pattern, pattern_share)``.

    Ties go to the smallest signature. The top-1 pick is a ``min(struct)``
    aggregate, so it combines map-side too.
    """
    cols = [f.name for f in df.schema.fields if _is_string(f.dataType) and (columns is None or f.name in columns)]
    if not cols:
        return df.sparkSession.createDataFrame([], "ordinal int, format_pattern string, pattern_share double")
    m = melt(df, cols).filter(F.col("value").isNotNull())
    sig = m.groupBy("ordinal", format_signature(F.col("value")).alias("sig")).agg(F.count(F.lit(1)).alias("n"))
    best = sig.groupBy("ordinal").agg(F.min(F.struct((-F.col("n")).alias("neg"), F.col("sig"))).alias("b"),
                                      F.sum("n").alias("tot"))
    return best.select("ordinal", F.col("b.sig").alias("format_pattern"),
                       (-F.col("b.neg") / F.col("tot")).alias("pattern_share"))


def issues_expr(null_rate: Column, unique_rate: Column, total: Column, has_ws: Column) -> Column:
    """Issue list, reference rules: strict thresholds on unrounded rates."""
    return F.array_compact(F.array(
        F.when(null_rate > HIGH_NULL_RATE,
               F.format_string("high_null_rate:%.1f%%", null_rate * 100)),
        F.when((unique_rate < LOW_CARDINALITY_RATE) & (total > LOW_CARDINALITY_MIN_ROWS), F.lit("low_cardinality")),
        F.when(has_ws, F.lit("leading_trailing_whitespace"))))


def profile_columns(df: DataFrame, order_by: list | None = None, sample_size: int | None = None,
                    approx: bool = False, with_patterns: bool = True, with_samples: bool = True) -> DataFrame:
    """Full column-profile table, one row per column.

    ``name, dtype, null_rate, unique_rate, sample_values, detected_issues,
    format_pattern, ordinal``. Default profiles the whole table (the
    reference profiled only its first ``sample_size`` rows; pass
    ``sample_size`` and ``order_by`` for that behaviour).
    """
    df = _restrict(df, sample_size, order_by)
    order_by = order_by or [F.monotonically_increasing_id()]
    stats = column_stats(df, approx=approx)
    if approx:
        uniq = stats.select("ordinal", F.col("approx_unique").alias("n_unique"))
    else:
        uniq = distinct_counts(df)
    # all inputs are one row per column: tiny, so broadcast joins
    prof = stats.join(F.broadcast(uniq), "ordinal", "left")
    if with_samples:
        prof = prof.join(F.broadcast(sample_values(df, order_by)), "ordinal", "left")
    else:
        prof = prof.withColumn("sample_values", F.lit(None).cast("array<string>"))
    if with_patterns:
        prof = prof.join(F.broadcast(format_patterns(df)), "ordinal", "left")
    else:
        prof = prof.withColumn("format_pattern", F.lit(None).cast("string"))
    total = F.col("total")
    null_rate = F.when(total > 0, F.col("null_count") / total).otherwise(F.lit(0.0))
    unique_rate = F.when(total > 0, F.coalesce(F.col("n_unique"), F.lit(0)) / total).otherwise(F.lit(0.0))
    return prof.select(
        "name", "dtype",
        F.round(null_rate, 4).alias("null_rate"),
        F.round(unique_rate, 4).alias("unique_rate"),
        F.coalesce(F.col("sample_values"), F.array().cast("array<string>")).alias("sample_values"),
        issues_expr(null_rate, unique_rate, total, F.col("has_ws")).alias("detected_issues"),
        "format_pattern", "ordinal", total.alias("total_rows"),
        F.coalesce(F.col("n_unique"), F.lit(0)).cast("bigint").alias("n_unique"))


def quality_report(df: DataFrame, order_by: list | None = None, sample_size: int | None = None,
                   approx: bool = False) -> DataFrame:
    """One-row quality report.

    ``total_rows, total_columns, duplicate_row_rate (round 4),
    overall_quality_score, columns ARRAY<STRUCT<profile>>``. The score uses
    the mean of the *rounded* per-column null rates and the *unrounded* dup
    rate, as the reference does.
    """
    df = _restrict(df, sample_size, order_by)
    prof = profile_columns(df, order_by=order_by, approx=approx)
    cols = prof.agg(
        F.avg("null_rate").alias("avg_null"),
        F.transform(F.array_sort(F.collect_list(F.struct(
            "ordinal", "name", "dtype", "null_rate", "unique_rate", "sample_values",
            "detected_issues", "format_pattern"))), lambda s: s.dropFields("ordinal")).alias("columns"))
    dup = duplicate_rate(df)
    out = dup.crossJoin(cols)  # one row x one row
    score = F.greatest(F.lit(0.0), F.round(1.0 - F.coalesce(F.col("avg_null"), F.lit(0.0))
                                           - F.col("duplicate_row_rate") * 0.5, 4))
    return out.select(
        "total_rows", F.lit(len(df.columns)).cast("int").alias("total_columns"),
        F.round("duplicate_row_rate", 4).alias("duplicate_row_rate"),
        score.alias("overall_quality_score"), "columns")


def profile_by_group(df: DataFrame, group_col: str) -> DataFrame:
    """Per-group profile (B15): ``group, name, rows, null_rate, unique_rate``
    and the group's ``duplicate_row_rate``.

    Grouped aggregations combine map-side, so a group holding a third of the
    table is reduced per partition before it is shuffled.
    """
    fields = [f for f in df.schema.fields if f.name != group_col]
    g = F.col(f"`{group_col}`")
    aggs = [F.count(F.lit(1)).alias("__rows")]
    aggs += [F.count_if(F.col(f"`{f.name}`").isNull()).alias(f"__n{i}") for i, f in enumerate(fields)]
    nulls = df.groupBy(g.alias("grp")).agg(*aggs).select(
        "grp", "__rows", F.inline(F.array(*[
            F.struct(F.lit(i).alias("ordinal"), F.lit(f.name).alias("name"), F.col(f"__n{i}").alias("nulls"))
            for i, f in enumerate(fields)])))
    items = [F.struct(F.lit(i).alias("ordinal"), value_text(F.col(f"`{f.name}`"), f.dataType).alias("value"))
             for i, f in enumerate(fields)]
    uniq = (df.select(g.alias("grp"), F.inline(F.array(*items)))
            .distinct()
            .groupBy("grp", "ordinal").agg(F.count(F.lit(1)).alias("n_unique")))
    gd = groupable(df)
    dup = (gd.groupBy(*[F.col(f"`{c}`") for c in gd.columns]).agg(F.count(F.lit(1)).alias("__c"))
           .groupBy(F.col(f"`{group_col}`").alias("grp"))
           .agg(F.sum("__c").alias("__t"), F.count(F.lit(1)).alias("__d"))
           .select("grp", (1.0 - F.col("__d") / F.col("__t")).alias("duplicate_row_rate")))
    # group keys may be NULL: null-safe joins (all three inputs are small)
    u = uniq.withColumnRenamed("grp", "__ug").withColumnRenamed("ordinal", "__uo")
    d = dup.withColumnRenamed("grp", "__dg")
    out = (nulls.join(u, F.col("grp").eqNullSafe(F.col("__ug")) & (F.col("ordinal") == F.col("__uo")), "left")
           .join(d, F.col("grp").eqNullSafe(F.col("__dg")), "left"))
    return out.select(
        F.col("grp").alias(group_col), "name", F.col("__rows").alias("rows"),
        F.round(F.col("nulls") / F.col("__rows"), 4).alias("null_rate"),
        F.round(F.col("n_unique") / F.col("__rows"), 4).alias("unique_rate"),
        F.round("duplicate_row_rate", 4).alias("duplicate_row_rate"))
