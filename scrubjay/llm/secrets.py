"""Secrets in texts: fixed patterns, and sliding-window Shannon entropy over candidate strings.

Kinds: ``assign`` (a name such as password or token, a sign and a value of 8 characters or more), ``access`` (AKIA keys),
``hex`` (32 or more hex digits) and ``entropy``.

Entropy. Candidates are runs of 20 or more of ``[A-Za-z0-9+/_=-]``. A candidate's character class is hex, alnum or
base64; each class has a threshold for the entropy of a window of ``WINDOW`` characters. The window slides one
character at a time; the sum of c*log2(c) over its character counts is kept up by the counts of the
character that leaves and the one that enters, and the entropy is log2(window) - sum/window. The span found runs
from the first window at the threshold to the last one.

Allow-list. A candidate is no secret when it has no digit or no letter, is a UUID, holds a date stamp only, is a path of plain words, or
equals an entry of ``allow``. Spans of fixed patterns are blanked out first, so each part of a candidate outside them, of
``WINDOW`` characters or more, is a candidate of its own. Nothing else in a text has a say in whether a candidate is looked at.

Positions are code points. Spark has no regular-expression positions; they follow from splitting the text at the
pattern: the pieces between matches and the matches tile the text. Texts without the pattern's key letters
skip it. Only DataFrame functions, one scan, no shuffle.

Defined cases: null and empty texts have no span; ids may be null or repeat (each row is scanned); an empty table gives an empty
table; extra columns stay in ``redact`` and are ignored by ``scan_secrets``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the patterns and their order
KINDS = ["assign", "access", "hex", "entropy"]
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
NAMES = ["password", "passwd", "secret", "token", "api_key", "apikey"]
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
UUID = r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$"
STAMP = r"^[0-9T_:+-]+Z?$"
PLAIN_PATH = r"^/?(?:[A-Za-z]++[0-9]{0,4}+[/_=-])++[A-Za-z]*+[0-9]{0,4}+$"  # possessive: matched in a loop, whatever the length
WINDOW = 20
CHUNK = 128
THRESHOLDS = {"hex": 2.9, "alnum": 3.7, "base64": 3.8}

_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _running(items: Column, step, piece_type: str) -> Column:
    """Array of the pieces that ``step(at, item) -> (at, piece)`` makes of ``items`` in order, ``at`` beginning with 0.

    Pieces are gathered ``CHUNK`` at a time, so a text with many of them is not copied once for each.
    """
    none = F.array().cast(f"array<{piece_type}>")

    def one(acc, x):
        at, piece = step(acc["at"], x)
        return F.struct(at.alias("at"), F.concat(acc["out"], F.array(piece)).alias("out"))

    def many(acc, part):
        got = F.aggregate(part, F.struct(acc["at"].alias("at"), none.alias("out")), one)
        return _bind(got, lambda g: F.struct(g["at"].alias("at"), F.concat(acc["out"], g["out"]).alias("out")))

    n = F.size(items)
    parts = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int")), lambda k: F.slice(items, k * CHUNK + 1, CHUNK)))
    return F.coalesce(F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("out")), many, lambda acc: acc["out"]), none)


def _tiles(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """``start, kind, end, value`` of all matches of ``pattern``; value: the match or a group of it.

    The pieces of the text between matches and the matches themselves give the positions.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))

    def step(at, t):
        begin = at + F.length(t["0"])
        end = begin + F.length(t["1"])
        return end, F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), t["2"].alias("value"))

    return _bind(F.arrays_zip(gaps, found, value), lambda tiles: _running(tiles, step, "struct<start:int,kind:int,end:int,value:string>"))


def _spans(tiles: Column) -> Column:
    return F.transform(tiles, lambda t: F.struct(t["start"].alias("start"), t["kind"].alias("kind"), t["end"].alias("end")))


def _bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once (as the variable of a one-element transform)."""
    return F.get(F.transform(F.array(value), body), 0)


def _none() -> Column:
    return F.array().cast(_SPAN)


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, sorted by start, then kind."""
    lower = F.lower(text)
    named = F.lit(False)
    for n in NAMES:
        named = named | lower.contains(n)
    assign = F.when(named, _spans(F.filter(_tiles(text, ASSIGN, 0, 2), lambda t: F.length(t["value"]) >= 8))).otherwise(_none())
    access = F.when(text.contains("AKIA"), _spans(_tiles(text, ACCESS, 1))).otherwise(_none())
    hexes = F.when(text.rlike(HEX), _spans(_tiles(text, HEX, 2))).otherwise(_none())
    return F.array_sort(F.concat(assign, access, hexes))


def _clogc(c: Column) -> Column:
    return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(0.0)


def entropy_window(text: Column, window: int = WINDOW, threshold: Column | float = 3.7) -> Column:
    """``struct(first, last)``: places (from 0) of the first and the last window of the string whose entropy is at least the
    threshold; -1 without one. The sum of c*log2(c) is updated by the two counts that change."""
    return _bind(F.split(text, ""), lambda chars: _slide(chars, window, threshold))


def _slide(chars: Column, window: int, threshold: Column | float) -> Column:
    need = (F.lit(math.log2(window)) - threshold) * window + F.lit(1e-9)  # entropy >= threshold  <=>  sum <= need
    at = lambda i, x: F.size(F.filter(F.slice(chars, i + 1, window), lambda y: y == x))
    first = F.slice(chars, 1, window)
    s0 = F.aggregate(F.array_distinct(first), F.lit(0.0), lambda acc, x: acc + _clogc(F.size(F.filter(first, lambda y: y == x))))
    begin = F.struct(s0.alias("s"), F.when(s0 <= need, 0).otherwise(-1).alias("first"), F.when(s0 <= need, 0).otherwise(-1).alias("last"))

    def slide(acc, i):  # from the window at i - 1 to the one at i
        out, into = chars[i - 1], chars[i + window - 1]
        k = at(i - 1, out)
        m = at(i - 1, into) - F.when(into == out, 1).otherwise(0)
        s = acc["s"] + _clogc(k - 1) - _clogc(k) + _clogc(m + 1) - _clogc(m)
        ok = s <= need
        return F.struct(s.alias("s"), F.when(ok & (acc["first"] < 0), i).otherwise(acc["first"]).alias("first"),
                        F.when(ok, i).otherwise(acc["last"]).alias("last"))

    slides = F.when(F.size(chars) > window, F.sequence(F.lit(1), F.size(chars) - window)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(slides, begin, slide, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def _cut_out(text: Column, spans: Column, put) -> Column:
    """``text`` with ``put(length)`` in place of each stretch that ``spans`` (sorted by start, perhaps overlapping) add to those before."""
    def body(chars):
        def step(at, s):
            gap = F.array_join(F.slice(chars, at + 1, F.greatest(s["start"] - at, F.lit(0))), "")
            fresh = s["end"] - F.greatest(at, s["start"])
            return F.greatest(at, s["end"]), F.when(fresh > 0, F.concat(gap, put(fresh, s["start"] >= at))).otherwise(F.lit(""))

        rest = F.coalesce(F.array_max(F.transform(spans, lambda s: s["end"])), F.lit(0))
        return F.concat(F.array_join(_running(spans, step, "string"), ""), F.array_join(F.slice(chars, rest + 1, F.size(chars)), ""))

    return _bind(F.split(text, ""), body)


def entropy_spans(text: Column, base: Column, allow: tuple[str, ...] = ()) -> Column:
    """Entropy spans of the text outside the spans of ``base``, which are blanked out first: what is left of a candidate are candidates."""
    blank = F.when(F.size(base) > 0, _cut_out(text, base, lambda n, new: F.repeat(F.lit(" "), n))).otherwise(text)

    def judge(tile):
        word = tile["value"]
        open_ = (word.rlike("[0-9]") & word.rlike("[A-Za-z]") & ~word.rlike(UUID) & ~word.rlike(STAMP) & ~word.rlike(PLAIN_PATH))
        if allow:
            open_ = open_ & ~word.isin(*allow)
        limit = (F.when(word.rlike("^[0-9A-Fa-f]+$"), THRESHOLDS["hex"]).when(word.rlike("^[A-Za-z0-9]+$"), THRESHOLDS["alnum"])
                 .otherwise(THRESHOLDS["base64"]))
        found = lambda hit: F.when(hit["first"] >= 0, F.struct((tile["start"] + hit["first"]).alias("start"), F.lit(3).alias("kind"),
                                                               (tile["start"] + hit["last"] + WINDOW).alias("end")))
        return F.when(open_, _bind(limit, lambda x: _bind(entropy_window(word, WINDOW, x), found)))

    spans = _bind(blank, lambda t: F.filter(F.transform(_tiles(t, CANDIDATE, 3), judge), lambda s: s.isNotNull()))
    return F.when(text.rlike(CANDIDATE), spans).otherwise(_none())


def with_spans(docs: DataFrame, text_col: str = "text", allow: tuple[str, ...] = (), base_col: str = "__base", all_col: str = "__all") -> DataFrame:
    """``docs`` with two span columns: those of the fixed patterns, and all."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.withColumn(base_col, base_spans(text))
    return d.withColumn(all_col, F.array_sort(F.concat(F.col(base_col), entropy_spans(text, F.col(base_col), allow))))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allow: tuple[str, ...] = ()) -> DataFrame:
    """``<id>, base_spans, all_spans`` per row (arrays of start, kind number, end)."""
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return with_spans(d, "text", allow, "base_spans", "all_spans").select(F.col("id").alias(id_col), "base_spans", "all_spans")


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", mark: str = "[SECRET]", allow: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mark``; all rows and columns stay."""
    d = with_spans(docs, text_col, allow)

    clean = _cut_out(F.col(text_col), F.col("__all"), lambda n, new: F.when(new, F.lit(mark)).otherwise(F.lit("")))
    d = d.withColumn(text_col, F.when(F.size("__all") > 0, clean).otherwise(F.col(text_col))).drop("__base", "__all")
    if length_col and length_col in docs.columns:
        d = d.withColumn(length_col, F.length(F.coalesce(F.col(text_col), F.lit(""))).cast(docs.schema[length_col].dataType))
    return d.select(*docs.columns)
