"""Text column expressions: white space, case, tagged lines, code fences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Leading/trailing Unicode white space (Java's (?U) makes \s Unicode-aware;
# Spark's trim() strips only U+0020).
UNICODE_STRIP_RE = "(?U)^\\s+|\\s+$"


def strip_unicode(c: Column) -> Column:
    """Strip leading/trailing white space of any Unicode kind."""
    return F.regexp_replace(c, UNICODE_STRIP_RE, "")


def normalize_ws(c: Column, lower: bool = True) -> Column:
    """Strip, collapse inner runs of white space to one blank, optionally lower-case."""
    out = F.regexp_replace(strip_unicode(c), "(?U)\\s+", " ")
    return F.lower(out) if lower else out


def extract_tagged(text: Column, tag: str = "TASK") -> Column:
    """Values of lines that start (after white space) with ``<tag>:``, lower-cased
    and stripped, in line order (B13)."""
    found = F.regexp_extract_all(text, F.lit(f"(?m)^[ \\t]*{tag}:([^\\n]*)"), 1)
    return F.transform(found, lambda s: F.lower(strip_unicode(s)))


def keyword_fallback(text: Column, vocab: list[str]) -> Column:
    """Vocabulary words contained in lower(text), in vocabulary order (B13 fallback)."""
    words = F.array(*[F.lit(w) for w in vocab])
    low = F.lower(text)
    return F.filter(words, lambda w: F.contains(low, w))


def strip_code_fence(text: Column) -> Column:
    """Remove a leading fence line and, when present, a trailing bare fence line.

    Text is stripped first; text that does not start with a fence is
    returned stripped and otherwise unchanged. Only the
    first line and a final line consisting of a bare fence are dropped.
    """
    stripped = strip_unicode(text)
    starts = F.startswith(stripped, F.lit("```"))
    lines = F.split(stripped, "\n")
    n = F.size(lines)
    last = F.element_at(lines, -1)
    last_is_fence = strip_unicode(last) == F.lit("```")
    body_end = F.when((n > 1) & last_is_fence, n - 2).otherwise(n - 1)
    body = F.array_join(F.slice(lines, 2, F.greatest(body_end, F.lit(0))), "\n")
    return F.when(starts, F.when(n > 1, body).otherwise(F.lit(""))).otherwise(stripped)
