"""Exact ranks in a pseudorandom or a given order, without one task per group.

A seeded order sorts by ``md5(seed:id)``, which any SQL engine can compute.  The first
three hex digits split a stratum into 4096 buckets: ranks are counted within a
bucket and shifted by the counts of the buckets before, so a stratum that holds a
third of all rows is spread over thousands of groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_DIGITS = 3


def shuffle_key(seed: int, *ids: str | Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(i).cast("string") if isinstance(i, str) else i.cast("string") for i in ids]))


def shuffled_rank(df: DataFrame, strata: list[str], ids: list[str], seed: int, name: str = "rank") -> DataFrame:
    """``df`` plus a rank from 1 in seeded order within each stratum (nulls are a stratum).

    ``ids`` should tell the rows of a stratum apart.
    """
    keyed = df.withColumn("__rank_key", shuffle_key(seed, *ids)).withColumn("__rank_bucket", F.substring("__rank_key", 1, BUCKET_DIGITS))
    inner = Window.partitionBy(*strata, "__rank_bucket").orderBy("__rank_key", *ids)
    counts = keyed.groupBy(*strata, "__rank_bucket").agg(F.count(F.lit(1)).alias("__rank_n"))
    before = Window.partitionBy(*strata).orderBy("__rank_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*[F.col(s).alias(f"__rank_s{i}") for i, s in enumerate(strata)], F.col("__rank_bucket").alias("__rank_b"), F.coalesce(F.sum("__rank_n").over(before), F.lit(0)).alias("__rank_base"))
    same = F.col("__rank_bucket") == F.col("__rank_b")
    for i, s in enumerate(strata):
        same &= F.col(s).eqNullSafe(F.col(f"__rank_s{i}"))
    ranked = keyed.withColumn("__rank_r", F.row_number().over(inner)).join(bases, same)
    return ranked.withColumn(name, F.col("__rank_base") + F.col("__rank_r")).drop("__rank_key", "__rank_bucket", "__rank_b", "__rank_base", "__rank_r", *[f"__rank_s{i}" for i in range(len(strata))])


def totals(df: DataFrame, strata: list[str], name: str = "n") -> DataFrame:
    return df.groupBy(*strata).agg(F.count(F.lit(1)).alias(name))


def largest_remainder(weights: DataFrame, weight: str, total: int, tie: list[str], name: str = "quota") -> DataFrame:
    """``weights`` (one row per stratum) plus whole quotas that add up to ``total``.

    Floors first, then one more by descending fraction; ties by the ``tie`` columns.
    """
    everything = Window.partitionBy(F.lit(0))
    share = F.col(weight) * F.lit(total) / F.sum(weight).over(everything)
    rows = weights.withColumn("_share", share).withColumn("_floor", F.floor("_share").cast("long"))
    order = everything.orderBy(F.desc(F.round(F.col("_share") - F.col("_floor"), 9)), *tie)
    left = F.lit(total) - F.sum("_floor").over(everything)
    rows = rows.withColumn("_left", left).withColumn("_nth", F.row_number().over(order))
    return rows.withColumn(name, F.col("_floor") + (F.col("_nth") <= F.col("_left")).cast("long")).drop("_share", "_floor", "_left", "_nth")
