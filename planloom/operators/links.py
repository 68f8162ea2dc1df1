"""Schema links from scores: the best pair among valid ones, with its confidence.

Scores come as rows, one per record and name, from whatever model made them.  Only
declared joins and columns that a chosen table has are candidates, so a decoded link
always exists.  A group holds the pairs of one schema, so it is small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STAR = "*"


def best_of(candidates: DataFrame, by: list[str], choice: list[str], score: str = "score") -> DataFrame:
    """The candidate of the highest score of every group, and its share by softmax: (by, choice, score, confidence).

    Ties go to the least choice, nulls first; candidates without a score are none.
    """
    group = Window.partitionBy(*by)
    known = candidates.where(F.col(score).isNotNull()).withColumn("__peak", F.max(score).over(group))
    shares = known.withColumn("confidence", 1 / F.sum(F.exp(F.col(score) - F.col("__peak"))).over(group))
    order = group.orderBy(F.desc(score), *[F.asc_nulls_first(c) for c in choice])
    return shares.withColumn("__nth", F.row_number().over(order)).where("__nth = 1").select(*by, *choice, score, "confidence")


def best_tables(tables: DataFrame, joins: DataFrame) -> DataFrame:
    """(record, base, joined, score, confidence) from ``tables`` (record, table, base_score, join_score) and
    declared ``joins`` (record, base, joined; each in the directions that may be read).

    The row of a null table holds the score of no join; ``joined`` is null then.
    """
    bases = tables.where("table IS NOT NULL").select("record", F.col("table").alias("base"), "base_score")
    alone = tables.where("table IS NULL").select("record", F.col("table").alias("joined"), "join_score")
    other = tables.where("table IS NOT NULL").select("record", F.col("table").alias("joined"), "join_score")
    single = bases.join(alone, "record")
    double = joins.where("base <> joined").select("record", "base", "joined").distinct().join(bases, ["record", "base"]).join(other, ["record", "joined"])
    return best_of(single.unionByName(double).withColumn("score", F.col("base_score") + F.col("join_score")), ["record"], ["base", "joined"])


def best_columns(chosen: DataFrame, owners: DataFrame, columns: DataFrame, pairs: DataFrame) -> DataFrame:
    """(record, role, owner, column, score, confidence): per role the best column of a chosen table.

    ``chosen`` is of ``best_tables``, ``owners`` (record, role, owner, score), ``columns``
    (record, role, column, score), ``pairs`` (record, owner, column) the columns there are.
    A role may be ``*`` if ``columns`` has a score for it.
    """
    live = chosen.select("record", F.explode(F.array_compact(F.array("base", "joined"))).alias("owner"))
    there = pairs.select("record", "owner", "column").unionByName(live.withColumn("column", F.lit(STAR))).distinct().join(live, ["record", "owner"], "left_semi")
    scored = there.join(owners.withColumnRenamed("score", "owner_score"), ["record", "owner"]).join(columns.withColumnRenamed("score", "column_score"), ["record", "role", "column"])
    return best_of(scored.withColumn("score", F.col("owner_score") + F.col("column_score")), ["record", "role"], ["owner", "column"])
