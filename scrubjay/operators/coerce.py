"""Type coercion.

A cast is attempted only on text that a strict pattern accepts, then with
``try_cast`` so range overflow gives NULL instead of an error (ANSI mode stays
on). A non-NULL input whose result is NULL is flagged, never dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubjay.functions.flags import add_flags, ensure_flags
from scrubjay.functions.text import strip_unicode

# Accepted type names, text patterns and boolean spellings.
TYPE_ALIASES = {
    "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "int": "int", "integer": "int",
    "bigint": "bigint", "long": "bigint", "smallint": "smallint", "tinyint": "tinyint",
    "float32": "float", "float": "float", "float64": "double", "double": "double",
    "str": "string", "string": "string", "utf8": "string",
    "bool": "boolean", "boolean": "boolean",
    "date": "date", "datetime": "timestamp_ntz", "timestamp": "timestamp_ntz", "timestamp_ntz": "timestamp_ntz",
}
INT_RE = r"^[+-]?\d+$"
FLOAT_RE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
TRUE_WORDS = ["true", "t", "yes", "y", "1"]
FALSE_WORDS = ["false", "f", "no", "n", "0"]
DATE_PATTERN = "yyyy-M-d"
DATE_SHAPE = r"^\d{4}-\d{1,2}-\d{1,2}$"
TIMESTAMP_SHAPE = r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{1,2}:\d{1,2}(\.\d{1,6})?)?$"
TIMESTAMP_PATTERNS = ["yyyy-M-d H:m:s", "yyyy-M-d'T'H:m:s", "yyyy-M-d H:m:s.SSSSSS", "yyyy-M-d'T'H:m:s.SSSSSS"]
INFER_ORDER = ["bigint", "double", "boolean", "date", "timestamp_ntz"]
DEFAULT_INFER_CONFIDENCE = 0.75


def spark_type(name: str) -> str:
    n = name.strip().lower()
    if n.startswith("decimal"):
        return n
    if n not in TYPE_ALIASES:
        raise ValueError(f"unknown target type {name}")
    return TYPE_ALIASES[n]


def coerce_expr(c: Column, target: str, source_type: T.DataType | None = None) -> Column:
    """Typed value of ``c`` or NULL when it does not convert (G1)."""
    t = spark_type(target)
    if source_type is not None and not isinstance(source_type, T.StringType):
        return c.try_cast(t)
    s = strip_unicode(c.cast("string"))
    low = F.lower(s)
    if t in ("tinyint", "smallint", "int", "bigint"):
        return F.when(s.rlike(INT_RE), s.try_cast(t))
    if t in ("float", "double") or t.startswith("decimal"):
        return F.when(s.rlike(FLOAT_RE), s.try_cast(t))
    if t == "boolean":
        return F.when(low.isin(TRUE_WORDS), F.lit(True)).when(low.isin(FALSE_WORDS), F.lit(False))
    if t == "date":
        return F.when(s.rlike(DATE_SHAPE), F.to_date(F.try_to_timestamp(s, F.lit(DATE_PATTERN))))
    if t == "timestamp_ntz":
        return F.when(s.rlike(TIMESTAMP_SHAPE), F.coalesce(
            *[F.try_to_timestamp(s, F.lit(p)) for p in [DATE_PATTERN] + TIMESTAMP_PATTERNS]).cast("timestamp_ntz"))
    if t == "string":
        return c.cast("string")
    raise ValueError(t)


def coerce_types(df: DataFrame, type_map: dict[str, str]) -> DataFrame:
    """Cast columns by ``type_map``; un-castable non-NULL values become NULL and
    the row is flagged ``type_coercion:<column>`` (G1, G2). One projection."""
    df = ensure_flags(df)
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    new = {c: coerce_expr(F.col(c), t, dtypes[c]) for c, t in type_map.items()}
    conds = [(F.col(c).isNotNull() & new[c].isNull(), f"type_coercion:{c}") for c in type_map]
    flagged = add_flags(df, conds)
    return flagged.select(*[(new[c].alias(c) if c in new else F.col(c)) for c in flagged.columns])


def _castable_shares(df: DataFrame, columns: list[str], targets: list[str]) -> DataFrame:
    """One aggregation: share of non-NULL, non-blank values castable to each target.

    ``(name, target, share, n)`` long form.
    """
    # strip once per value in a projection; every cast test reads the stripped text
    x = df.select(*[strip_unicode(F.col(c).cast("string")).alias(f"s{i}") for i, c in enumerate(columns)])
    aggs = []
    for i, _c in enumerate(columns):
        s = F.col(f"s{i}")
        present = s.isNotNull() & (s != "")
        aggs.append(F.count_if(present).alias(f"n{i}"))
        for j, t in enumerate(targets):
            aggs.append(F.count_if(present & coerce_expr(s, t).isNotNull()).alias(f"k{i}_{j}"))
    df = x
    one = df.agg(*aggs)
    items = [F.struct(F.lit(c).alias("name"), F.lit(i).alias("ordinal"), F.lit(t).alias("target"),
                      F.lit(j).alias("rank"), F.col(f"k{i}_{j}").alias("k"), F.col(f"n{i}").alias("n"))
             for i, c in enumerate(columns) for j, t in enumerate(targets)]
    return one.select(F.inline(F.array(*items))).select(
        "name", "ordinal", "target", "rank", "n",
        F.when(F.col("n") > 0, F.col("k") / F.col("n")).otherwise(F.lit(0.0)).alias("share"))


def infer_types(df: DataFrame, columns: list[str] | None = None,
                min_confidence: float = DEFAULT_INFER_CONFIDENCE) -> DataFrame:
    """Target type per string column (G3): first of bigint, double, boolean,
    date, timestamp whose castable share is >= ``min_confidence``; NULL when
    none qualifies (column left as is). ``(name, inferred_type, share)``."""
    if columns is None:
        columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    shares = _castable_shares(df, columns, INFER_ORDER)
    best = (shares.filter(F.col("share") >= min_confidence)
            .groupBy("name").agg(F.min(F.struct("rank", "target", "share")).alias("b")))
    names = shares.select("name", "ordinal").distinct()
    return names.join(best, "name", "left").select(
        "name", "ordinal", F.col("b.target").alias("inferred_type"), F.col("b.share").alias("share"))


def type_map_from(inferred: DataFrame) -> dict[str, str]:
    """Driver-side dict from the small per-column inference table."""
    return {r["name"]: r["inferred_type"] for r in inferred.collect() if r["inferred_type"]}


def type_consistency(df: DataFrame, type_map: dict[str, str]) -> DataFrame:
    """Per-column castable share of non-NULL values and their mean.

    ``(name, share)`` rows; use :func:`type_consistency_rate` for the mean.
    """
    aggs = []
    cols = list(type_map)
    for i, c in enumerate(cols):
        nn = F.col(c).isNotNull()
        aggs.append(F.count_if(nn).alias(f"n{i}"))
        aggs.append(F.count_if(nn & coerce_expr(F.col(c), type_map[c]).isNotNull()).alias(f"k{i}"))
    one = df.agg(*aggs)
    items = [F.struct(F.lit(c).alias("name"),
                      F.when(F.col(f"n{i}") > 0, F.col(f"k{i}") / F.col(f"n{i}")).otherwise(F.lit(1.0)).alias("share"))
             for i, c in enumerate(cols)]
    return one.select(F.inline(F.array(*items)))


def type_consistency_rate(df: DataFrame, type_map: dict[str, str]) -> DataFrame:
    return type_consistency(df, type_map).agg(F.avg("share").alias("type_consistency_rate"))


def json_fields(df: DataFrame, column: str, schema_ddl: str, prefix: str = "") -> DataFrame:
    """Parse a JSON-text column into typed top-level fields.

    Malformed JSON or a field of the wrong type gives NULL and a
    ``json_coercion:<column>`` flag; the source column is kept.
    """
    parsed = F.from_json(F.col(column), schema_ddl, {"mode": "PERMISSIVE"})
    st = T.StructType.fromDDL(schema_ddl)
    df = df.withColumn("__j", parsed)
    out = [F.col(f"__j.{f.name}").alias(prefix + f.name) for f in st.fields]
    bad = F.col(column).isNotNull() & (F.col("__j").isNull() | F.array_contains(
        F.array(*[F.col(f"__j.{f.name}").isNull() for f in st.fields]), True))
    df = add_flags(df, [(bad, f"json_coercion:{column}")])
    return df.select(*[c for c in df.columns if c != "__j"], *out)
