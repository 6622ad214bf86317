"""Pair comparators (D2-D5) as column expressions; Jaro-Winkler as an Arrow-batched pandas UDF."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

# Winkler prefix scale and cap, boost only above this Jaro score.
JW_PREFIX_SCALE = 0.1
JW_PREFIX_MAX = 4
JW_BOOST_THRESHOLD = 0.7


def levenshtein_sim(a: Column, b: Column) -> Column:
    """1 - lev / greatest(len); both empty -> 1.0; NULL when either is NULL (D3)."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(
        longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def exact_sim(a: Column, b: Column) -> Column:
    """1.0 when equal, 0.0 otherwise; NULL against anything scores 0."""
    return F.when(a.isNull() | b.isNull(), F.lit(0.0)).when(a == b, F.lit(1.0)).otherwise(F.lit(0.0))


def cosine_sim(a: Column, b: Column) -> Column:
    """sum(a*b) / (|a| |b|) in DOUBLE; zero norm or NULL -> 0.0."""
    ad, bd = a.cast("array<double>"), b.cast("array<double>")
    dot = F.aggregate(F.zip_with(ad, bd, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    na = F.sqrt(F.aggregate(ad, F.lit(0.0), lambda acc, x: acc + x * x))
    nb = F.sqrt(F.aggregate(bd, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.when(a.isNull() | b.isNull() | (na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot / (na * nb))


def jaro_winkler_py(s: str | None, t: str | None) -> float | None:
    """Textbook Jaro-Winkler; match window max(len)/2 - 1; empty -> 0.0."""
    if s is None or t is None:
        return None
    ls, lt = len(s), len(t)
    if ls == 0 or lt == 0:
        return 0.0
    window = max(max(ls, lt) // 2 - 1, 0)
    s_match = [False] * ls
    t_match = [False] * lt
    m = 0
    for i, ch in enumerate(s):
        lo, hi = max(0, i - window), min(lt, i + window + 1)
        for j in range(lo, hi):
            if not t_match[j] and t[j] == ch:
                s_match[i] = t_match[j] = True
                m += 1
                break
    if m == 0:
        return 0.0
    k = trans = 0
    for i in range(ls):
        if s_match[i]:
            while not t_match[k]:
                k += 1
            if s[i] != t[k]:
                trans += 1
            k += 1
    # half the out-of-order matches, rounded down (the common library convention)
    jaro = (m / ls + m / lt + (m - trans // 2) / m) / 3
    if jaro <= JW_BOOST_THRESHOLD:
        return jaro
    prefix = 0
    for a, b in zip(s[:JW_PREFIX_MAX], t[:JW_PREFIX_MAX]):
        if a != b:
            break
        prefix += 1
    return jaro + prefix * JW_PREFIX_SCALE * (1 - jaro)


def code_points(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Matrix of code points (one row per string, zeros behind its end) and the lengths."""
    size = np.fromiter(map(len, values), np.int64, len(values))
    out = np.zeros((len(values), max(int(size.max(initial=0)), 1)), np.uint32)
    out[np.arange(out.shape[1]) < size[:, None]] = np.frombuffer("".join(values).encode("utf-32-le"), np.uint32)
    return out, size


def jaro_winkler_rows(a: list[str], b: list[str]) -> np.ndarray:
    """:func:`jaro_winkler_py` of many pairs of strings: the greedy matching walks the characters of all left sides at once."""
    (s, ls), (t, lt) = code_points(a), code_points(b)
    n, rows = len(ls), np.arange(len(ls))
    reach = np.maximum(np.maximum(ls, lt) // 2 - 1, 0)
    s_hit, t_hit = np.zeros(s.shape, bool), np.zeros(t.shape, bool)
    at = np.arange(t.shape[1])
    for i in range(s.shape[1]):
        free = (t == s[:, i:i + 1]) & ~t_hit & (at < lt[:, None]) & (i < ls)[:, None] & (np.abs(at - i) <= reach[:, None])
        j = free.argmax(axis=1)
        s_hit[:, i] = free[rows, j]
        t_hit[rows[s_hit[:, i]], j[s_hit[:, i]]] = True
    m = s_hit.sum(axis=1)
    # matched characters of both sides, in order, to the front
    width = min(s.shape[1], t.shape[1])
    x = np.take_along_axis(s, np.argsort(~s_hit, axis=1, kind="stable"), axis=1)[:, :width]
    y = np.take_along_axis(t, np.argsort(~t_hit, axis=1, kind="stable"), axis=1)[:, :width]
    swapped = ((x != y) & (np.arange(width) < m[:, None])).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = np.where(m > 0, (m / ls + m / lt + (m - swapped // 2) / m) / 3, 0.0)
    prefix, going = np.zeros(n, np.int64), np.ones(n, bool)
    for k in range(min(JW_PREFIX_MAX, width)):
        going &= (s[:, k] == t[:, k]) & (k < ls) & (k < lt)
        prefix += going
    return np.where(jaro <= JW_BOOST_THRESHOLD, jaro, jaro + prefix * JW_PREFIX_SCALE * (1 - jaro))


_JW_CELLS = 1 << 21


@pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro-Winkler over Arrow batches (D2), NULL when either side is. Spark has no built-in; callers score
    distinct value pairs only and join the scores back. Pairs are taken by length, so a long string widens few others."""
    out = np.full(len(a), np.nan)
    both = np.flatnonzero((a.notna() & b.notna()).to_numpy())
    size = np.maximum(a.iloc[both].str.len().to_numpy(), b.iloc[both].str.len().to_numpy())
    both = both[np.argsort(size, kind="stable")]
    size = np.sort(size)
    lo = 0
    while lo < len(both):
        hi = lo + 1 + int(np.searchsorted(size[lo + 1:] * np.arange(2, len(both) - lo + 1), _JW_CELLS, "right"))
        out[both[lo:hi]] = jaro_winkler_rows(a.iloc[both[lo:hi]].tolist(), b.iloc[both[lo:hi]].tolist())
        lo = hi
    return pd.Series(out).astype("Float64").mask(np.isnan(out)) if np.isnan(out).any() else pd.Series(out)
