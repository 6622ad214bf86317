"""Missing-value imputation.

The statistics of all columns, and of all groups when there are any, come from
one pass: cells are melted to (column, group, value) and counted with map-side
combine, so a frequent value is one row. Modes are the largest counts, medians
are exact quantiles picked by rank (:mod:`scrubjay.operators.quantiles`), so no
task holds the values of a column and the number of jobs and shuffles does not
depend on the number of columns; ``approx=True`` uses the bounded
``percentile_approx`` sketch instead. Global statistics are one row a column,
read once and inlined as literals; those of groups are one row a group, joined
once for all columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubjay.functions.flags import add_flags, ensure_flags
from scrubjay.operators.quantiles import exact_quantiles
from scrubjay.session import cut_lineage

DEFAULT_MIN_CONFIDENCE = 0.65
DEFAULT_MAX_RATE = 0.05  # cap of the expensive strategy (reference: max_llm_imputation_rate)


def _numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def _integral(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def auto_strategy(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """Numeric -> median, otherwise mode."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return {c: ("median" if _numeric(types[c]) else "mode") for c in columns}


def _spread(q: Column, lo: Column, hi: Column) -> Column:
    """Confidence of a median: 1 - (interquartile range / range)."""
    return F.when(hi == lo, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.0 - (q[2] - q[0]) / (hi - lo))))


def _as_text(c: Column, dtype: T.DataType) -> Column:
    """A value as text that :func:`_from_text` reads back exactly."""
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(c).cast("string")
    if isinstance(dtype, T.BinaryType):
        return F.base64(c)
    if isinstance(dtype, T.MapType):  # entries in a fixed order, so equal maps are equal texts
        return F.to_json(F.array_sort(F.map_entries(c)))
    if isinstance(dtype, (T.ArrayType, T.StructType)):
        return F.to_json(c)
    return c.cast("string")


def _from_text(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.TimestampType):
        return F.timestamp_micros(c.cast("long"))
    if isinstance(dtype, T.BinaryType):
        return F.unbase64(c)
    if isinstance(dtype, T.MapType):
        entry = T.ArrayType(T.StructType([T.StructField("key", dtype.keyType), T.StructField("value", dtype.valueType)]))
        return F.map_from_entries(F.from_json(c, entry))
    if isinstance(dtype, (T.ArrayType, T.StructType)):
        return F.from_json(c, dtype)
    return c.cast(dtype)


def _ordered(c: Column, dtype: T.DataType) -> Column:
    """Numbers order by value; everything else by its text."""
    return c.cast("double") if _numeric(dtype) else F.lit(None).cast("double")


def column_statistics(df: DataFrame, strategies: dict[str, str], group_by: str | None = None, approx: bool = False) -> DataFrame:
    """``name, grp, total, fill (text), number, confidence, nn`` for all columns at once.

    ``total`` marks the row of the whole column; with ``group_by`` there is one more for each group (``grp``, as text, may be NULL) with a value.
    ``median``: ``number`` is the fill, ``mode``: ``fill`` (the most frequent value, the smallest on ties).
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    wrong = sorted(set(strategies.values()) - {"median", "mode"})
    if wrong:
        raise ValueError(f"unknown strategy {', '.join(wrong)}")
    grp = _as_text(F.col(group_by), types[group_by]) if group_by else F.lit(None).cast("string")
    cells = [F.struct(F.lit(c).alias("name"), (F.lit(None).cast("string") if s == "median" else _as_text(F.col(c), types[c])).alias("t"),
                      (F.col(c).cast("double") if s == "median" else _ordered(F.col(c), types[c])).alias("d")) for c, s in strategies.items()]
    x = df.select(grp.alias("grp"), F.explode(F.array(*cells)).alias("x")).select("grp", "x.*").filter(F.col("t").isNotNull() | F.col("d").isNotNull())
    counts = x.groupBy("name", "grp", "t", "d").agg(F.count(F.lit(1)).alias("n"))
    whole = counts.groupBy("name", "t", "d").agg(F.sum("n").alias("n")).select("name", F.lit(None).cast("string").alias("grp"), F.lit(True).alias("total"), "t", "d", "n")
    both = whole.unionByName(counts.withColumn("total", F.lit(False))) if group_by else whole
    key = ["name", "grp", "total"]
    medians, modes = ([c for c, s in strategies.items() if s == k] for k in ("median", "mode"))
    out = None
    if medians:
        m = both.filter(F.col("name").isin(medians))
        if approx:
            y = x.filter(F.col("name").isin(medians)).select("name", "grp", "d", F.explode(F.array(F.lit(True), F.lit(False)) if group_by else F.array(F.lit(True))).alias("total"))
            y = y.withColumn("grp", F.when(~F.col("total"), F.col("grp")))
            q = y.groupBy(*key).agg(F.percentile_approx("d", [0.25, 0.5, 0.75], 10000).alias("q"), F.min("d").alias("lo"), F.max("d").alias("hi"), F.count(F.lit(1)).alias("nn"))
        else:
            q = exact_quantiles(m, key, "d", "n", [0.25, 0.5, 0.75])
        out = q.select(*key, F.lit(None).cast("string").alias("fill"), F.col("q")[1].alias("number"), _spread(F.col("q"), F.col("lo"), F.col("hi")).alias("confidence"), "nn")
    if modes:
        best = both.filter(F.col("name").isin(modes)).groupBy(*key).agg(
            F.min(F.struct((-F.col("n")).alias("neg"), "d", F.col("t").alias("t"))).alias("b"), F.sum("n").alias("nn"))
        b = best.select(*key, F.col("b.t").alias("fill"), F.lit(None).cast("double").alias("number"), (-F.col("b.neg") / F.col("nn")).alias("confidence"), "nn")
        out = b if out is None else out.unionByName(b)
    return out


def fill_statistics(df: DataFrame, column: str, strategy: str, group_by: str | None = None,
                    approx: bool = False) -> DataFrame:
    """``[group], fill, confidence, nn`` for one column."""
    types = {f.name: f.dataType for f in df.schema.fields}
    s = column_statistics(df, {column: strategy}, group_by, approx)
    fill = (F.col("number") if strategy == "median" else _from_text(F.col("fill"), types[column])).alias("fill")
    if group_by:
        return s.filter(~F.col("total")).select(_from_text(F.col("grp"), types[group_by]).alias(group_by), fill, "confidence", "nn")
    return s.filter("total").select(fill, "confidence", "nn")


def impute(df: DataFrame, strategy_map: dict[str, str] | None = None, columns: list[str] | None = None,
           group_by: str | None = None, min_confidence: float = DEFAULT_MIN_CONFIDENCE,
           approx: bool = False) -> DataFrame:
    """Fill NULLs in all columns (F1-F5); every statistic is of the input.

    ``strategy_map`` column -> ``median`` | ``mode``; missing -> :func:`auto_strategy`.
    With ``group_by``, the group's statistic is used when the group has a
    non-NULL value, else the global one (F4). Integer columns get the
    median floored. A filled cell whose confidence is below
    ``min_confidence`` flags the row ``imputation:<col>``; an all-NULL column
    is left unchanged and its rows flagged ``imputation_failed:<col>``.
    Adds ``__imputed_confidence`` (mean confidence over the cells filled in
    the row, NULL when none) and ``__imputed_cells`` (how many were filled).
    """
    df = ensure_flags(df)
    types = {f.name: f.dataType for f in df.schema.fields}
    if columns is None:
        columns = [c for c in df.columns if not c.startswith("__")]
    strategies = {c: {**auto_strategy(df, columns), **(strategy_map or {})}[c] for c in columns}
    stats = cut_lineage(column_statistics(df.select(*{*columns, *([group_by] if group_by else [])}), strategies, group_by, approx)) if columns else None
    found = {r["name"]: r for r in stats.filter("total").collect()} if columns else {}  # one row a column
    if group_by and columns:
        one = F.struct("fill", "number", "confidence")
        groups = stats.filter(~F.col("total")).groupBy("grp").agg(F.map_from_entries(F.collect_list(F.struct("name", one.alias("s")))).alias("__stats")).withColumnRenamed("grp", "__grp")
        df = df.join(groups, _as_text(F.col(group_by), types[group_by]).eqNullSafe(F.col("__grp")), "left")
    confs, flags, fills = [], [], {}
    for c in columns:
        g, median = found.get(c), strategies[c] == "median"
        fill = F.lit(g["number"]).cast("double") if g and median else F.lit(g["fill"] if g else None).cast("string")
        conf = F.lit(g["confidence"] if g else None).cast("double")
        if group_by:
            own = F.col("__stats")[c]
            fill = F.coalesce(own["number"] if median else own["fill"], fill)
            conf = F.when(own.isNotNull(), own["confidence"]).otherwise(conf)
        if median:
            fill = (F.floor(fill) if _integral(types[c]) else fill).cast(types[c])
        else:
            fill = _from_text(fill, types[c])
        need = F.col(c).isNull()
        fills[c] = F.coalesce(F.col(c), fill).alias(c)
        flags += [(need & fill.isNotNull() & (conf < min_confidence), f"imputation:{c}"), (need & fill.isNull(), f"imputation_failed:{c}")]
        confs.append(F.when(need & fill.isNotNull(), conf))
    df = add_flags(df.withColumn("__confs", F.filter(F.array(*confs).cast("array<double>"), lambda x: x.isNotNull())), flags)
    df = df.select(*[fills.get(c, F.col(c)) for c in df.columns if c not in ("__grp", "__stats")])
    filled = F.col("__confs")
    df = df.withColumn("__imputed_confidence", F.when(F.size(filled) > 0, F.aggregate(
        filled, F.lit(0.0), lambda a, x: a + x) / F.size(filled))).withColumn("__imputed_cells", F.size(filled))
    return df.drop("__confs")


def impute_capped(df: DataFrame, column: str, expensive: str = "mode", group_by: str | None = None,
                  max_rate: float = DEFAULT_MAX_RATE, min_confidence: float = DEFAULT_MIN_CONFIDENCE) -> DataFrame:
    """Cap of the expensive strategy.

    The column's null rate (a one-row aggregate, read on the driver) decides:
    at or below ``max_rate`` the group-conditional ``expensive`` strategy
    runs; above it the cheap global statistic fills and every filled row is
    flagged ``imputation_capped:<col>``.
    """
    rate = df.agg(F.coalesce(F.count_if(F.col(column).isNull()) / F.count(F.lit(1)), F.lit(0.0))).first()[0]
    if rate <= max_rate:
        return impute(df, {column: expensive}, [column], group_by=group_by, min_confidence=min_confidence)
    out = impute(df, {column: expensive}, [column], min_confidence=min_confidence)
    return add_flags(out, [(F.col("__imputed_confidence").isNotNull(), f"imputation_capped:{column}")])


def quality_delta(before_profile: DataFrame, after_profile: DataFrame) -> DataFrame:
    """Per-column null-rate change (H6): ``name, null_rate_before, null_rate_after, null_rate_delta``."""
    b = before_profile.select("name", F.col("null_rate").alias("null_rate_before"))
    a = after_profile.select("name", F.col("null_rate").alias("null_rate_after"))
    return b.join(a, "name", "full_outer").select(
        "name", "null_rate_before", "null_rate_after",
        (F.coalesce(F.col("null_rate_after"), F.lit(0.0)) - F.coalesce(F.col("null_rate_before"), F.lit(0.0)))
        .alias("null_rate_delta"))
