"""The two reserved columns every operator carries: ``__flagged__`` and ``__flag_reason__``.

A row is never dropped because it looks uncertain; it is kept and marked. The
flag is a non-NULL boolean on output; reasons are ``<operator>:<column>`` tokens
joined by ``;`` in order of application.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLAG = "__flagged__"
REASON = "__flag_reason__"


def ensure_flags(df: DataFrame) -> DataFrame:
    """Add empty flag columns when absent; normalise a NULL flag to false."""
    if FLAG not in df.columns:
        df = df.withColumn(FLAG, F.lit(False))
    else:
        df = df.withColumn(FLAG, F.coalesce(F.col(FLAG).cast("boolean"), F.lit(False)))
    if REASON not in df.columns:
        df = df.withColumn(REASON, F.lit(None).cast("string"))
    return df


def add_flag(df: DataFrame, cond: Column, reason: str | Column) -> DataFrame:
    """OR a condition into the flag and append its reason token (H1)."""
    df = ensure_flags(df)
    hit = F.coalesce(cond, F.lit(False))
    token = reason if isinstance(reason, Column) else F.lit(reason)
    new_reason = F.when(hit, F.concat_ws(";", F.col(REASON), token)).otherwise(F.col(REASON))
    return df.withColumn(REASON, new_reason).withColumn(FLAG, F.col(FLAG) | hit)


def add_flags(df: DataFrame, conds: list[tuple[Column, str]]) -> DataFrame:
    """Apply several (condition, reason) pairs in one projection."""
    df = ensure_flags(df)
    hits = [(F.coalesce(c, F.lit(False)), r) for c, r in conds]
    if not hits:
        return df
    tokens = [F.when(h, F.lit(r)) for h, r in hits]
    any_hit = hits[0][0]
    for h, _ in hits[1:]:
        any_hit = any_hit | h
    reason = F.when(any_hit, F.concat_ws(";", F.col(REASON), *tokens)).otherwise(F.col(REASON))
    return df.withColumn(REASON, reason).withColumn(FLAG, F.col(FLAG) | any_hit)


def split_flagged(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clean, flagged) side outputs (A10). NULL flag counts as not flagged."""
    is_flagged = F.coalesce(F.col(FLAG), F.lit(False)) if FLAG in df.columns else F.lit(False)
    return df.filter(~is_flagged), df.filter(is_flagged)


def flagged_count(df: DataFrame) -> Column:
    """Aggregate expression: number of flagged rows; 0 when the column is absent (H2)."""
    if FLAG not in df.columns:
        return F.lit(0).cast("bigint")
    return F.count_if(F.coalesce(F.col(FLAG), F.lit(False))).cast("bigint")
