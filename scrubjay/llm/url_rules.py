"""URL verdicts by a sort-merge range join of canonical keys with prefix rules.

A rule (host, path, verdict) fits a url whose host is the rule's host or a subdomain of it and whose path starts
with the rule's path; of several fitting rules the longest (host and path together) wins, then the greater one.

* Canonical key: the host's labels reversed and joined (``org.example.blog``), so that a host covers its subdomains as a
  prefix, and then the path. A url has one key per leading part of its reversed host, down to
  the deepest rule; a rule is the interval of keys that start with its own.
* Sweep: rules and urls of one reversed host are sorted by path. At a url, the last rule that began is the top of the
  stack of nested intervals; each rule carries that stack (itself and the rules around it), so
  the active ones are those whose path still leads the url's path.
* Work per distinct (host, path) only. A host part with very many urls is salted: its urls go to as many
  windows as its count asks for, and its rules to each of them. Parts without rules are dropped before the sort.

Only DataFrame functions. Defined cases: a null url or one without ``://`` has an empty host and path and gets the default
verdict with a null rule; page ids may be null or repeat (each row is judged); an empty rule table gives the default verdict; repeated rules count
once, and of equal rules with unequal verdicts ``block`` wins; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SALT_ROWS = 5_000


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``host, path, verdict`` rows."""
    rows = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules]
    if not rows:
        return spark.range(0).select(F.lit("").alias("host"), F.lit("").alias("path"), F.lit("").alias("verdict"))
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url column."""
    pattern = r"^[\s\S]*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, pattern, i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def _reversed(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def _stacks(rules: DataFrame) -> DataFrame:
    """``rk, path, stack``: each rule with itself and the rules around it, the longest first."""
    r = (rules.filter("host is not null and path is not null")
         .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
         .select(F.array_join(_reversed(F.col("host")), ".").alias("rk"), "path", F.concat("host", "path").alias("rule"), "verdict"))
    lead = r.select("rk", "path", F.explode(F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.substring("path", F.lit(1), n))).alias("around"))
    around = r.select("rk", F.col("path").alias("around"), F.struct(F.length("path").alias("n"), F.col("path").alias("path"), "rule", "verdict").alias("s"))
    return lead.join(around, ["rk", "around"]).groupBy("rk", "path").agg(F.sort_array(F.collect_list("s"), asc=False).alias("stack"))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow",
               salt_rows: int = SALT_ROWS) -> DataFrame:
    """``<id>, host, path, rule, verdict`` per row of ``pages``."""
    host, path = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias(id_col), host.alias("host"), path.alias("path"))
    urls = rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")).drop("n")
    stacks = _stacks(rules)
    depth = rules.agg(F.max(F.size(F.split("host", r"\."))).alias("d")).first()["d"] or 0

    # one key per leading part of the reversed host, as deep as any rule
    labels = urls.filter("host <> ''").select("host", "path", _reversed(F.col("host")).alias("labels"))
    if not depth:
        labels = labels.limit(0)
    parts = F.transform(F.sequence(F.lit(1), F.least(F.size("labels"), F.lit(max(depth, 1)))), lambda k: F.array_join(F.slice("labels", 1, k), "."))
    keys = labels.select("host", "path", F.explode(parts).alias("rk"))
    ruled = stacks.select("rk").distinct()
    salts = (keys.groupBy("rk").agg(F.count(F.lit(1)).alias("n")).join(ruled, "rk")
             .select("rk", F.ceil(F.col("n") / salt_rows).cast("int").alias("salts")))
    points = keys.join(salts, "rk").select(
        "rk", F.pmod(F.xxhash64("host", "path"), F.col("salts")).cast("int").alias("salt"), "path", F.lit(1).alias("kind"), "host",
        F.lit(None).cast(stacks.schema["stack"].dataType).alias("stack"))
    starts = stacks.join(salts, "rk").select(
        "rk", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "path", F.lit(0).alias("kind"), F.lit("").alias("host"), "stack")
    sweep = W.partitionBy("rk", "salt").orderBy("path", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    swept = starts.unionByName(points).withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).filter("kind = 1")
    top = F.get(F.filter("stack", lambda s: F.startswith(F.col("path"), s["path"])), 0)
    found = (swept.select("host", "path", top.alias("t")).filter("t is not null")
             .groupBy("host", "path").agg(F.max(F.struct(F.length("t.rule").alias("n"), F.col("t.rule").alias("rule"), F.col("t.verdict").alias("verdict"))).alias("best")))
    return rows.join(found, ["host", "path"], "left").select(
        id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
