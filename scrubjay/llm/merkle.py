"""Document fingerprints: a Merkle tree over sections, paragraphs and sentences.

A text is cut into sections at empty lines, a section into paragraphs at line breaks, a paragraph into sentences that tile
it (a run up to and with its ``.``, ``!`` or ``?``). A sentence's hash is the SHA-256 of its text, a paragraph is told
by its sentences' hashes, a section's hash is the SHA-256 of its paragraphs, and the root that of all below it and of the
text's own hash, so equal roots mean equal texts.

The fingerprint is text: ``root|section;section``, a section ``hash:paragraph,paragraph``, a paragraph its sentence hashes joined
by ``.`` (sentence and section hashes shortened to 12 hex digits, the root whole). ``likeness`` compares the sentence hashes
of two fingerprints (shared / all distinct ones; 1 for equal roots); ``diff_branches`` goes down only where section hashes
differ and names the sections and paragraphs that changed.

Only DataFrame functions. Fingerprints need one scan and no shuffle. ``with_next`` brings each document its
follower in descending id order: a bounded set of quantiles cuts the ids into ranges, a window runs inside each
range, and the first document of a range also goes to the end of the range above it, so no range waits for another.

Defined cases: null and empty texts have one empty sentence; ids may repeat (ties are ordered by text) or be null (last); the only document follows
itself; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SENTENCE = r"[^.!?]+[.!?]*|[.!?]+"
SHORT = 12


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def fingerprint(text: Column) -> Column:
    """Fingerprint of a text column (see the module text)."""

    def paragraph(p: Column) -> Column:
        return F.array_join(F.transform(F.regexp_extract_all(p, F.lit(SENTENCE), F.lit(0)), lambda s: F.substring(_sha(s), 1, SHORT)), ".")

    def section(s: Column) -> Column:
        inner = F.array_join(F.transform(F.split(s, "\n"), paragraph), ",")
        return F.concat(F.substring(_sha(inner), 1, SHORT), F.lit(":"), inner)

    body = F.array_join(F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n"), section), ";")
    # the root covers the section hashes and, so that short hashes cannot make two texts equal, the text itself
    return F.concat(_sha(F.concat(_sha(F.coalesce(text, F.lit(""))), body)), F.lit("|"), body)


def sentence_hashes(fp: Column) -> Column:
    """Distinct sentence hashes of a fingerprint."""
    body = F.substring_index(fp, "|", -1)
    return F.array_distinct(F.filter(F.split(F.regexp_replace(body, r"(^|;)[0-9a-f]*:", ","), "[,.]"), lambda x: x != ""))


def root(fp: Column) -> Column:
    return F.substring_index(fp, "|", 1)


def likeness(a: Column, b: Column) -> Column:
    """Share of common sentence hashes among all of both fingerprints; 1 for equal roots."""
    x, y = sentence_hashes(a), sentence_hashes(b)
    both = F.size(F.array_intersect(x, y))
    return F.when(root(a) == root(b), 1.0).otherwise(F.coalesce(both / F.nullif(F.size(x) + F.size(y) - both, F.lit(0)), F.lit(0.0)))


def diff_branches(a: Column, b: Column) -> Column:
    """``array<struct<section, paragraphs>>`` (places from 0): sections of ``a`` whose hash is not that of the section in the same place of
    ``b`` and, within them, the paragraphs that differ. Equal branches are not entered."""
    part = lambda fp: F.split(F.substring_index(fp, "|", -1), ";")

    def section(x: Column, y: Column, i: Column) -> Column:
        px, py = F.split(F.substring_index(x, ":", -1), ","), F.split(F.substring_index(F.coalesce(y, F.lit("")), ":", -1), ",")
        differ = F.filter(F.transform(px, lambda p, k: F.when(~p.eqNullSafe(F.get(py, k)), k)), lambda k: k.isNotNull())
        return F.when(~x.eqNullSafe(y), F.struct(i.alias("section"), differ.alias("paragraphs")))

    return F.filter(F.transform(part(a), lambda x, i: section(x, F.get(part(b), i), i)), lambda s: s.isNotNull())


def with_next(docs: DataFrame, id_col: str, range_rows: int = 4000, max_ranges: int = 4096) -> DataFrame:
    """``docs`` with ``next``: a struct of all columns of the document that follows in descending id order
    (the first again after the last).

    Quantiles of the ids cut the rows into ranges of about ``range_rows`` (larger ones beyond ``max_ranges``, which bounds the list of
    quantiles); a range's rows are sorted with spill, not held.
    """
    cols = docs.columns
    ranges = min(max_ranges, docs.select(id_col).count() // range_rows + 1)
    cuts = [k / ranges for k in range(1, ranges)] or [1.0]
    bounds = docs.agg(F.percentile_approx(id_col, cuts, max(10_000, 4 * ranges)).alias("b")).first()["b"] or []
    bounds = sorted(set(bounds))
    low = F.lit(0)
    if bounds:  # ranges are counted from the highest ids
        low = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: F.col(id_col) <= b))
    d = docs.withColumn("__range", F.when(F.col(id_col).isNull(), len(bounds) + 1).otherwise(low))
    # the highest id of each range: at most ranges + 1 rows
    heads = sorted((r["__range"], r["head"]) for r in d.groupBy("__range").agg(F.max(id_col).alias("head")).collect())
    # the first document of a range also goes to the end of the range above; the last range is above the first one
    n = (heads[-1][0] if heads else 0) + 1
    head, above = [None] * n, [None] * n
    for k, (r, first) in enumerate(heads):
        head[r], above[r] = first, heads[k - 1][0]
    key = docs.schema[id_col].dataType
    of = lambda values, kind: F.array(*[F.lit(v).cast(kind) for v in values])[F.col("__range")]
    also = F.when(F.col(id_col).eqNullSafe(of(head, key)), of(above, "int"))
    here = F.struct(F.col("__range").alias("range"), F.lit(0).alias("guest"))
    guest = F.struct(also.alias("range"), F.lit(1).alias("guest"))
    d = d.withColumn("__at", F.explode(F.when(also.isNull(), F.array(here)).otherwise(F.array(here, guest))))
    ties = [F.col(c) for c in cols if c != id_col]
    w = W.partitionBy("__at.range").orderBy("__at.guest", F.col(id_col).desc_nulls_last(), *ties)
    return d.withColumn("next", F.lead(F.struct(*cols)).over(w)).filter("__at.guest = 0").select(*cols, "next")


def edit_text(text: Column, follower: Column) -> Column:
    """The text whose last floor(n/2) code points are replaced by the first as many (or all) of the follower."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(follower, F.lit(1), half))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id>, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` per row."""
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = with_next(d, "id")
    edited = edit_text(F.col("text"), F.col("next.text"))
    d = d.select("id", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "text", F.col("next.text").alias("follower"))
    d = d.select("id", "n_chars", _sha(F.col("edited")).alias("edited_sha256"), fingerprint(F.col("text")).alias("fingerprint"),
                 fingerprint(F.col("edited")).alias("edited_fingerprint"), fingerprint(F.col("follower")).alias("next_fingerprint"))
    return d.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                    likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                    likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
