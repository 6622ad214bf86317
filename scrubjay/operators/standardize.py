"""Format standardisation.

All rules are column expressions inside one projection (whole-stage
codegen); rule inference is one aggregation over the candidate parsers.
Per-row locales come from a small fixed rule table joined by broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubjay.functions.dates import format_as, parse_any, try_parse
from scrubjay.functions.flags import add_flags
from scrubjay.functions.text import normalize_ws, strip_unicode

DEFAULT_LOCALE = "zh_CN"
# Locale rules (calling code, national number length, subscriber
# digits, postal-code length, date layout). One row per supported locale.
LOCALE_RULES = [
    ("zh_CN", "86", 10, 8, 6, "%Y-%m-%d"),
    ("en_US", "1", 10, 7, 5, "%m/%d/%Y"),
    ("en_GB", "44", 10, 6, 7, "%d/%m/%Y"),
    ("de_DE", "49", 10, 7, 5, "%d.%m.%Y"),
    ("fr_FR", "33", 9, 8, 5, "%d/%m/%Y"),
    ("es_ES", "34", 9, 6, 5, "%d/%m/%Y"),
]
LOCALE_SCHEMA = ("locale string, calling_code string, national_len int, subscriber_len int, "
                 "postal_len int, date_format string")
# Candidate date layouts tried by rule inference, in order.
CANDIDATE_DATE_FORMATS = ["%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y", "%d-%b-%Y", "%Y%m%d", "%d.%m.%Y", "%Y/%m/%d",
                          "%b %d, %Y", "%d %b %Y"]
CURRENCY_CHARS = "[$€£¥,\\s]"
MONEY_RE = r"^-?\d+(\.\d+)?$"
DEFAULT_MIN_CONFIDENCE = 0.70


def locale_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LOCALE_RULES, LOCALE_SCHEMA)


def _rule(locale: str) -> tuple:
    for r in LOCALE_RULES:
        if r[0] == locale:
            return r
    raise ValueError(f"unknown locale {locale}")


# ---------- E1 dates ----------

def standardize_dates(df: DataFrame, column: str, formats: list[str], target_format: str = "%Y-%m-%d",
                      out: str | None = None) -> DataFrame:
    """Parse with the first matching layout, re-emit in ``target_format``.

    Blank -> NULL without flag; non-blank failure -> NULL + ``format:<col>`` flag.
    """
    out = out or column
    s = strip_unicode(F.col(column))
    ts = parse_any(s, formats)
    blank = F.col(column).isNull() | (s == "")
    df = add_flags(df, [(~blank & ts.isNull(), f"format:{column}")])
    return df.withColumn(out, F.when(~blank, format_as(ts, target_format)))


# ---------- E2 phones ----------

def phone_parts(c: Column, calling_code: Column, national_len: Column, subscriber_len: Column):
    """(area, number) of a phone number, NULLs when too short."""
    d = F.regexp_replace(c, "[^0-9]", "")
    n = F.length(d)
    cc_len = F.length(calling_code)
    d = (F.when(F.startswith(d, calling_code) & (n - cc_len >= national_len), F.substr(d, cc_len + 1, n))
         .when(F.startswith(d, F.lit("0")) & (n - 1 >= national_len), F.substr(d, F.lit(2), n))
         .otherwise(d))
    n = F.length(d)
    ok = n >= national_len
    area = F.when(ok, F.substring(d, 1, n - subscriber_len))
    number = F.when(ok, F.substring(d, n - subscriber_len + 1, subscriber_len))
    return area, number


def standardize_phone(df: DataFrame, column: str, locale: str = DEFAULT_LOCALE,
                      template: str = "+{cc}-{area}-{number}", out: str | None = None) -> DataFrame:
    """Phone text -> ``+86-{area}-{number}`` style (E2); too few digits -> NULL + flag."""
    _, cc, nat, sub, _, _ = _rule(locale)
    area, number = phone_parts(F.col(column), F.lit(cc), F.lit(nat), F.lit(sub))
    df = add_flags(df, [(F.col(column).isNotNull() & area.isNull(), f"format:{column}")])
    return df.withColumn(out or column, _fill_template(template, F.lit(cc), area, number))


def _fill_template(template: str, cc: Column, area: Column, number: Column) -> Column:
    pieces, rest = [], template
    while rest:
        i = rest.find("{")
        if i < 0:
            pieces.append(F.lit(rest))
            break
        if i > 0:
            pieces.append(F.lit(rest[:i]))
        j = rest.index("}", i)
        pieces.append({"cc": cc, "area": area, "number": number}[rest[i + 1:j]])
        rest = rest[j + 1:]
    return F.when(area.isNotNull(), F.concat(*pieces))


# ---------- E3 postal codes ----------

def postal_expr(c: Column, length: Column) -> Column:
    d = F.regexp_replace(c, "[^0-9]", "")
    return F.when((F.length(d) > 0) & (F.length(d) <= length), F.lpad(d, length, "0"))


def standardize_postal(df: DataFrame, column: str, locale: str = DEFAULT_LOCALE, out: str | None = None) -> DataFrame:
    """Digits only, left-padded to the locale length (zh_CN: 6); else NULL + flag."""
    length = F.lit(_rule(locale)[4])
    v = postal_expr(F.col(column), length)
    df = add_flags(df, [(F.col(column).isNotNull() & v.isNull(), f"format:{column}")])
    return df.withColumn(out or column, v)


# ---------- E4 money ----------

def money_expr(c: Column, precision: int = 18, scale: int = 2) -> Column:
    s = F.regexp_replace(strip_unicode(c), CURRENCY_CHARS, "")
    neg = F.regexp_extract(s, r"^\((.*)\)$", 1)
    s = F.when(neg != "", F.concat(F.lit("-"), neg)).otherwise(s)
    return F.when(s.rlike(MONEY_RE), s.try_cast(f"decimal({precision},{scale})"))


def standardize_money(df: DataFrame, column: str, out: str | None = None, precision: int = 18,
                      scale: int = 2) -> DataFrame:
    """Currency text -> DECIMAL; ``(x)`` is negative; junk -> NULL + flag."""
    v = money_expr(F.col(column), precision, scale)
    df = add_flags(df, [(F.col(column).isNotNull() & v.isNull(), f"format:{column}")])
    return df.withColumn(out or column, v)


# ---------- E5 rule inference ----------

def infer_format_rules(df: DataFrame, columns: list[str], locale: str = DEFAULT_LOCALE,
                       min_confidence: float = DEFAULT_MIN_CONFIDENCE,
                       date_formats: list[str] | None = None) -> DataFrame:
    """Pick a rule family per column from the share of values each parser accepts (E5).

    One aggregation. Families in order: date, money, phone, postal; the first
    with the highest share >= ``min_confidence`` wins. For dates, the layouts
    kept are those that parse at least one value, in candidate order.
    ``(name, rule, share, formats)``; rule NULL = leave unchanged.
    """
    date_formats = date_formats or CANDIDATE_DATE_FORMATS
    _, cc, nat, sub, plen, _ = _rule(locale)
    fams = ["date", "money", "phone", "postal"]
    # one projection computes every test once per row (stripped text shared),
    # then one aggregation counts them
    stripped = df.select(*[strip_unicode(F.col(c).cast("string")).alias(f"s{i}") for i, c in enumerate(columns)])
    tests, aggs = [], []
    for i, _c in enumerate(columns):
        s_ = F.col(f"s{i}")
        present = s_.isNotNull() & (s_ != "")
        tests.append(present.alias(f"p{i}"))
        for j, f in enumerate(date_formats):
            tests.append((present & try_parse(s_, f).isNotNull()).alias(f"d{i}_{j}"))
        tests.append((present & money_expr(s_).isNotNull() & s_.rlike(r"[$€£¥().,]")).alias(f"t{i}_1"))
        tests.append((present & phone_parts(s_, F.lit(cc), F.lit(nat), F.lit(sub))[0].isNotNull()).alias(f"t{i}_2"))
        tests.append((present & postal_expr(s_, F.lit(plen)).isNotNull()).alias(f"t{i}_3"))
    flags = stripped.select(*tests)
    for i, _c in enumerate(columns):
        any_date = F.col(f"d{i}_0")
        for j in range(1, len(date_formats)):
            any_date = any_date | F.col(f"d{i}_{j}")
        aggs.append(F.count_if(F.col(f"p{i}")).alias(f"n{i}"))
        aggs.append(F.count_if(any_date).alias(f"k{i}_0"))
        for j in (1, 2, 3):
            aggs.append(F.count_if(F.col(f"t{i}_{j}")).alias(f"k{i}_{j}"))
        for j in range(len(date_formats)):
            aggs.append(F.count_if(F.col(f"d{i}_{j}")).alias(f"f{i}_{j}"))
    df = flags
    one = df.agg(*aggs)
    rows = []
    for i, c in enumerate(columns):
        n = F.col(f"n{i}")
        cands = F.array(*[F.struct((F.col(f"k{i}_{j}") / n).alias("share"), F.lit(-j).alias("neg"),
                                   F.lit(fam).alias("rule")) for j, fam in enumerate(fams)])
        best = F.array_max(cands)
        fmts = F.array_compact(F.array(*[F.when(F.col(f"f{i}_{j}") > 0, F.lit(f)) for j, f in enumerate(date_formats)]))
        ok = (n > 0) & (best["share"] >= min_confidence)
        rows.append(F.struct(F.lit(c).alias("name"), F.when(ok, best["rule"]).alias("rule"),
                             F.when(n > 0, best["share"]).otherwise(F.lit(0.0)).alias("share"),
                             F.when(ok & (best["rule"] == "date"), fmts).alias("formats")))
    return one.select(F.inline(F.array(*rows)))


def apply_format_rules(df: DataFrame, rules: list[dict], locale: str = DEFAULT_LOCALE,
                       target_date_format: str = "%Y-%m-%d") -> DataFrame:
    """Apply inferred rules (the collected rows of :func:`infer_format_rules`)."""
    for r in rules:
        if r["rule"] == "date":
            df = standardize_dates(df, r["name"], list(r["formats"]), target_date_format)
        elif r["rule"] == "money":
            df = standardize_money(df, r["name"])
        elif r["rule"] == "phone":
            df = standardize_phone(df, r["name"], locale)
        elif r["rule"] == "postal":
            df = standardize_postal(df, r["name"], locale)
    return df


# ---------- E6 per-row locale ----------

def standardize_phone_by_locale(df: DataFrame, column: str, locale_col: str,
                                template: str = "+{cc}-{area}-{number}", out: str | None = None) -> DataFrame:
    """Phones standardised with each row's own locale rules.

    The rule table is a fixed handful of rows, so it is broadcast; rows with
    an unknown locale fall back to the default locale's rules.
    """
    rules = F.broadcast(locale_table(df.sparkSession).select(
        F.col("locale").alias("__loc"), "calling_code", "national_len", "subscriber_len"))
    j = df.join(rules, F.col(locale_col) == F.col("__loc"), "left")
    _, dcc, dnat, dsub, _, _ = _rule(DEFAULT_LOCALE)
    cc = F.coalesce(F.col("calling_code"), F.lit(dcc))
    area, number = phone_parts(F.col(column), cc, F.coalesce(F.col("national_len"), F.lit(dnat)),
                               F.coalesce(F.col("subscriber_len"), F.lit(dsub)))
    j = add_flags(j, [(F.col(column).isNotNull() & area.isNull(), f"format:{column}")])
    j = j.withColumn(out or column, _fill_template(template, cc, area, number))
    return j.drop("__loc", "calling_code", "national_len", "subscriber_len")


# ---------- E7 compliance ----------

def compliance_rate(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Share of non-NULL values matching ``pattern`` (E7); 0.0 with no values."""
    c = F.col(column).cast("string")
    return df.agg(F.coalesce(F.avg(F.when(c.isNotNull(), c.rlike(pattern).cast("double"))), F.lit(0.0))
                  .alias("format_compliance_rate"))


# ---------- E8 white space / case ----------

def normalize_text(df: DataFrame, columns: list[str], lower: bool = False) -> DataFrame:
    """Strip, collapse inner white space, optionally lower-case."""
    return df.select(*[(normalize_ws(F.col(c), lower).alias(c) if c in columns else F.col(c)) for c in df.columns])
