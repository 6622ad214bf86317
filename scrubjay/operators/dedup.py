"""Exact de-duplication and duplicate listings.

Survivor choice is an aggregate, not a window: ``min(struct(order, row))``
per key combines map-side, so a key that holds a third of the table is
reduced inside every input partition before the shuffle and never sorted in
one task. The struct ends with every column, so the survivor is
deterministic whatever the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def dedup_all(df: DataFrame) -> DataFrame:
    """Exact de-duplication on all columns."""
    return df.dropDuplicates()


def dedup_exact(df: DataFrame, keys: list[str], order_by: list[str] | None = None,
                keep: str = "first") -> DataFrame:
    """Keep one row per key (C2). NULL = NULL and NaN = NaN inside a key.

    Survivor: lowest ``order_by`` (NULLs first), ties broken by the remaining
    columns in schema order; ``keep='last'`` takes the highest instead.
    """
    order_by = order_by or []
    rest = [c for c in df.columns if c not in keys and c not in order_by]
    rec = F.struct(*[_c(c).alias(f"o{i}") for i, c in enumerate(order_by)],
                   *[_c(c).alias(f"r{i}") for i, c in enumerate(rest)])
    pick = F.min(rec) if keep == "first" else F.max(rec)
    g = df.groupBy(*[_c(k) for k in keys]).agg(pick.alias("__s"))
    back = {c: F.col(f"__s.o{i}") for i, c in enumerate(order_by)}
    back.update({c: F.col(f"__s.r{i}") for i, c in enumerate(rest)})
    return g.select(*[(_c(c) if c in keys else back[c]).alias(c) for c in df.columns])


def infer_key_fields(profile: DataFrame) -> list[str]:
    """Key columns for de-duplication from a profile table.

    Columns with fewer distinct values than rows (exact, not the rounded
    rate) that are not floating point, in schema order;
    if none, every non-float column; if none, all columns. Reads the small
    per-column profile only.
    """
    rows = profile.select("name", "dtype", "n_unique", "total_rows", "ordinal").orderBy("ordinal").collect()
    non_float = [r for r in rows if r["dtype"] not in ("float", "double")]
    keys = [r["name"] for r in non_float if r["n_unique"] < r["total_rows"]]
    if keys:
        return keys
    if non_float:
        return [r["name"] for r in non_float]
    return [r["name"] for r in rows]


def key_fields_table(profile: DataFrame) -> DataFrame:
    """The C3 rule as a DataFrame: ``name, is_key`` per profiled column."""
    non_float = ~F.col("dtype").isin("float", "double")
    cand = non_float & (F.col("n_unique") < F.col("total_rows"))
    stats = profile.agg(F.count_if(cand).alias("n_cand"), F.count_if(non_float).alias("n_nf"))
    is_key = (F.when(F.col("n_cand") > 0, cand).when(F.col("n_nf") > 0, non_float).otherwise(F.lit(True)))
    return profile.crossJoin(stats).select("name", "ordinal", is_key.alias("is_key"))  # stats: one row


def duplicate_groups(df: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """Duplicate groups (C7): ``keys..., group_size, survivor_id, max_id`` for keys
    seen more than once. Members are listed by :func:`duplicate_members`,
    never collected into one array, so a huge group stays distributed."""
    return (df.groupBy(*[_c(k) for k in keys])
            .agg(F.count(F.lit(1)).alias("group_size"), F.min(_c(id_col)).alias("survivor_id"),
                 F.max(_c(id_col)).alias("max_id"))
            .filter(F.col("group_size") > 1))


def duplicate_members(df: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """Every row of a duplicate group with its group's survivor id (C7 long form).

    The group summary has one row per key; the join back is an equi-join on
    the key whose skewed partitions AQE splits.
    """
    groups = duplicate_groups(df, keys, id_col).select(
        *[_c(k).alias(f"__g{i}") for i, k in enumerate(keys)], "group_size", "survivor_id")
    cond = None
    for i, k in enumerate(keys):
        e = _c(k).eqNullSafe(F.col(f"__g{i}"))
        cond = e if cond is None else cond & e
    out = df.join(groups, cond, "inner")
    return out.drop(*[f"__g{i}" for i in range(len(keys))])


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))
