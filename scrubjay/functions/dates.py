"""strptime-style format strings translated to Spark datetime patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Strptime directive -> Spark pattern letters (strict widths, for output).
STRPTIME_TO_SPARK = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss",
    "%f": "SSSSSS", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%p": "a", "%j": "DDD",
    "%z": "Z", "%Z": "z", "%%": "%",
}
# Lenient widths used for parsing when a numeric field stands between separators.
_LENIENT = {"%m": "M", "%d": "d", "%H": "H", "%I": "h", "%M": "m", "%S": "s"}

_TOKEN = re.compile(r"%[A-Za-z%]")

# Shape of each directive's text, used to skip parses that cannot succeed
# (a failed datetime parse is far more expensive than a regex test).
_SHAPE = {
    "%Y": r"\d{4}", "%y": r"\d{2}", "%m": r"\d{1,2}", "%d": r"\d{1,2}", "%H": r"\d{1,2}", "%I": r"\d{1,2}",
    "%M": r"\d{1,2}", "%S": r"\d{1,2}", "%f": r"\d{1,9}", "%b": r"[A-Za-z]{3,4}", "%B": r"[A-Za-z]+",
    "%a": r"[A-Za-z]+", "%A": r"[A-Za-z]+", "%p": r"[AaPp][Mm]", "%j": r"\d{1,3}", "%z": r"[+-]\d{4}",
    "%Z": r"[A-Za-z/_+-]+", "%%": "%",
}


def to_spark_pattern(fmt: str, lenient: bool = False) -> str:
    """Translate ``fmt``; literal text is quoted. With ``lenient``, one-or-two
    digit fields are accepted unless two directives touch (``%Y%m%d``)."""
    adjacent = re.search(r"%[A-Za-z](?=%[A-Za-z])", fmt) is not None
    out, pos = [], 0
    for m in _TOKEN.finditer(fmt):
        lit = fmt[pos:m.start()]
        if lit:
            out.append(_quote(lit))
        code = m.group(0)
        if code not in STRPTIME_TO_SPARK:
            raise ValueError(f"unsupported directive {code} in {fmt}")
        if lenient and not adjacent and code in _LENIENT:
            out.append(_LENIENT[code])
        else:
            out.append(STRPTIME_TO_SPARK[code])
        pos = m.end()
    if fmt[pos:]:
        out.append(_quote(fmt[pos:]))
    return "".join(out)


def _quote(lit: str) -> str:
    if re.fullmatch(r"[^A-Za-z']*", lit):
        return lit
    return "'" + lit.replace("'", "''") + "'"


def shape_regex(fmt: str) -> str:
    """Anchored regex a string must match before parsing with ``fmt`` is tried."""
    out, pos = ["^"], 0
    for m in _TOKEN.finditer(fmt):
        out.append(re.escape(fmt[pos:m.start()]))
        out.append(_SHAPE.get(m.group(0), ".+"))
        pos = m.end()
    out.append(re.escape(fmt[pos:]) + "$")
    return "".join(out)


def try_parse(c: Column, fmt: str) -> Column:
    """``try_to_timestamp`` guarded by the format's shape regex."""
    return F.when(c.rlike(shape_regex(fmt)), F.try_to_timestamp(c, F.lit(to_spark_pattern(fmt, lenient=True))))


def parse_any(c: Column, formats: list[str]) -> Column:
    """First successful parse over ``formats`` in list order (NULL if none)."""
    return F.coalesce(*[try_parse(c, f) for f in formats])


def format_as(ts: Column, fmt: str) -> Column:
    return F.date_format(ts, to_spark_pattern(fmt))
