"""Exact quantiles of many columns and groups at once, without a group in one task.

Values are counted first, so a value of a third of all rows is one row. The counts are range-partitioned by (column, group, value), each
partition sums its own, and the sums of the partitions (a few rows each) give every partition the rank it begins at. The values at the wanted ranks are then
picked by comparing ranks: no task holds the values of a column, and the number of jobs does not depend on how many columns there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrubjay.session import cut_lineage


def exact_quantiles(counts: DataFrame, keys: list[str], value: str, count: str, probabilities: list[float]) -> DataFrame:
    """``keys, q (array), lo, hi, nn`` from rows ``keys, value, count``; a value may come in several rows.

    A quantile at position p * (nn - 1) is interpolated between its two neighbours, as in ``percentile``. NULL values are ignored, keys may be NULL.
    """
    c = counts.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(F.sum(count).alias("__n"))
    c = c.repartitionByRange(*keys, "__v").withColumn("__part", F.spark_partition_id())
    c = cut_lineage(c)
    sums = c.groupBy("__part", *keys).agg(F.sum("__n").alias("__s"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each partition that holds some of a column and group
    sums = sums.select("__part", *keys, F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__start"), F.sum("__s").over(Window.partitionBy(*keys)).alias("__total"))
    run = Window.partitionBy("__part", *keys).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    local = c.withColumn("__upto", F.sum("__n").over(run)).alias("l")
    same = F.col("l.__part") == F.col("s.__part")
    for k in keys:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"s.{k}"))
    r = local.join(sums.alias("s"), same).select(*[F.col(f"l.{k}").alias(k) for k in keys], "__v", "__n", (F.col("__start") + F.col("__upto")).alias("__end"), "__total")
    at, aggs = (lambda p: F.lit(float(p)) * (F.col("__total") - 1)), []
    for i, p in enumerate(probabilities):
        for name, rank in (("a", F.floor(at(p))), ("b", F.ceil(at(p)))):
            hit = (rank < F.col("__end")) & (rank >= F.col("__end") - F.col("__n"))
            aggs.append(F.max(F.when(hit, F.col("__v"))).alias(f"__{name}{i}"))
    g = r.groupBy(*keys).agg(F.min("__v").alias("lo"), F.max("__v").alias("hi"), F.max("__total").alias("nn"), *aggs)
    q = []
    for i, p in enumerate(probabilities):
        pos, a, b = F.lit(float(p)) * (F.col("nn") - 1), F.col(f"__a{i}"), F.col(f"__b{i}")
        q.append(F.when(a == b, a).otherwise((F.ceil(pos) - pos) * a + (pos - F.floor(pos)) * b))
    return g.select(*keys, F.array(*q).alias("q"), "lo", "hi", "nn")
