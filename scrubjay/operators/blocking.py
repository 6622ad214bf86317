"""Candidate pairs from several block keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubjay.session import cut_lineage

MAX_BLOCK = 1000
TILE = 256


def candidate_pairs(df: DataFrame, id_col: str, block_exprs: list[Column], refine: Column | None = None,
                    max_block: int = MAX_BLOCK, tile: int = TILE) -> DataFrame:
    """``a, b, block``: pairs of records (a < b) that share a block key, each once, from the first key they share (from 1).

    A key held by more than ``max_block`` records is refined: its records pair only where they also agree on ``refine``
    (without ``refine`` it stays as it is). A block that is still large is dealt into tiles of about ``tile`` records, and each pair of
    tiles is a join key of its own: every pair is found, and no task holds more than two tiles of a block.

    Defined cases: a NULL key blocks nothing, nor does a NULL ``refine`` in a refined block; NULL ids take no part; of rows that
    repeat an id the one with the smallest keys counts; an empty table gives none.
    """
    keys = F.array(*[b.cast("string") for b in block_exprs])
    second = (refine if refine is not None else F.lit("")).cast("string")
    x = (df.select(F.col(id_col).alias("id"), F.struct(keys.alias("keys"), second.alias("refine")).alias("k")).filter(F.col("id").isNotNull())
         .groupBy("id").agg(F.min("k").alias("k")))
    rows = x.select("id", "k.refine", F.posexplode("k.keys").alias("i", "key")).filter(F.col("key").isNotNull())
    large = rows.groupBy("i", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_block).select("i", "key", F.lit(True).alias("large"))
    rows = rows.join(large, ["i", "key"], "left")
    rows = rows.filter(F.col("large").isNull() | F.col("refine").isNotNull()).select(
        "id", "i", F.struct("i", "key", F.when(F.col("large"), F.col("refine")).alias("refine")).alias("g"))
    rows = cut_lineage(rows.groupBy("id").agg(F.sort_array(F.collect_list("g")).alias("all")))  # one entry a key
    held = rows.select("id", "all", F.explode("all").alias("g"))
    tiles = held.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("g", "tiles")
    held = held.join(tiles, "g").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    held = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    held = held.select("g", F.least("tile", "other").alias("t0"), F.greatest("tile", "other").alias("t1"), "tile", "id", "all")
    x, y = (held.filter(f"tile = t{s}").select("g", "t0", "t1", F.col("id").alias(f"id{s}"), F.col("all").alias(f"all{s}")) for s in (0, 1))
    once = ((F.col("t0") < F.col("t1")) | (F.col("id0") < F.col("id1"))) & (F.array_intersect("all0", "all1")[0] == F.col("g"))
    return x.join(y, ["g", "t0", "t1"]).filter(once).select(F.least("id0", "id1").alias("a"), F.greatest("id0", "id1").alias("b"), (F.col("g.i") + 1).alias("block"))
