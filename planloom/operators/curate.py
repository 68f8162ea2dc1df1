"""Deduplication, conflicts, contamination and rejection logs over record tables.

Keys are hashed before a shuffle, and the first row of a key is found by a grouped
minimum, which combines before the shuffle: a key that a third of all rows share
costs one row per task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom.plans.errors import Rejected


#: Rows of a frozen set, counted beforehand, up to which its keys are broadcast.
BROADCAST_ROWS = 500_000


def key_of(*columns: str | Column) -> Column:
    """A 256-bit hash of the columns that tells null from empty and one column from the next."""
    parts = [F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n")) for c in (F.col(x) if isinstance(x, str) else x for x in columns)]
    return F.sha2(F.concat_ws("\x1f", *[F.sha2(p, 256) for p in parts]), 256)


def keep_first(df: DataFrame, keys: list[str | Column], pos: str) -> DataFrame:
    """The row with the least ``pos`` of every key.  ``pos`` must tell rows apart."""
    first = df.groupBy(key_of(*keys).alias("__own_k")).agg(F.min(pos).alias("__own_first")).select("__own_first")
    return df.join(first, F.col(pos) == F.col("__own_first"), "left_semi")


def duplicate_count(df: DataFrame, keys: list[str | Column]) -> DataFrame:
    """One row: rows, distinct_keys, duplicates."""
    per_key = df.groupBy(key_of(*keys).alias("__own_k")).agg(F.count(F.lit(1)).alias("__own_n"))
    return per_key.agg(F.coalesce(F.sum("__own_n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("distinct_keys")).withColumn("duplicates", F.col("rows") - F.col("distinct_keys"))


def conflict_audit(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys with more than one value: the keys and how many values."""
    return df.select(*keys, value).where(F.col(value).isNotNull()).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n_values")).where("n_values > 1")


def exclude_conflicts(df: DataFrame, keys: list[str | Column], value: str, pos: str) -> DataFrame:
    """Drop rows whose value differs from the first of their key; equal repeats stay."""
    narrow = df.select(key_of(*keys).alias("k"), F.col(pos).alias("__own_at"), F.col(value).alias("own"))
    first = narrow.groupBy("k").agg(F.min(F.struct("__own_at", "own")).alias("m")).select("k", F.col("m.own").alias("value"))
    agreed = narrow.join(first, "k").where(F.col("own").eqNullSafe(F.col("value"))).select("__own_at")
    return df.join(agreed, F.col(pos) == F.col("__own_at"), "left_semi")


def pair_keys(columns: dict[str, Column]) -> list[tuple[str, Column]]:
    """Every pair of the named columns as one key: by default schema, question and SQL give three."""
    names = list(columns)
    return [(f"{a}_{b}", key_of(columns[a], columns[b])) for i, a in enumerate(names) for b in names[i + 1 :]]


def contamination(df: DataFrame, frozen: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` plus ``matches``: the sorted names of pair keys that the frozen set also has."""
    keys = dict(pair_keys(columns))
    names = sorted(keys)
    seen = {n: frozen.select(keys[n].alias(f"__k_{n}")).distinct().withColumn(f"__in_{n}", F.lit(True)) for n in names}
    # frozen sets are small as a rule: then no row of df moves
    few = frozen.count() <= BROADCAST_ROWS
    out = df
    for n in names:
        out = out.withColumn(f"__k_{n}", keys[n]).join(F.broadcast(seen[n]) if few else seen[n], f"__k_{n}", "left")
    matches = F.filter(F.array(*[F.when(F.col(f"__in_{n}"), F.lit(n)) for n in names]), lambda x: x.isNotNull())
    return out.withColumn("matches", matches).select(*df.columns, "matches")


def decontaminate(df: DataFrame, frozen: DataFrame, columns: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(kept rows, log of reasons with counts)."""
    found = contamination(df, frozen, columns)
    log = found.where(F.size("matches") > 0).groupBy(F.concat(F.lit("training_contamination:"), F.array_join("matches", ",")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return found.where(F.size("matches") == 0).drop("matches"), log


def remove_matching(df: DataFrame, frozen: DataFrame, keys: list[Column]) -> DataFrame:
    """Rows whose key is not in the frozen set."""
    seen = frozen.select(key_of(*keys).alias("__own_seen")).distinct()
    return df.join(seen, key_of(*keys) == F.col("__own_seen"), "left_anti")


def overlap_counts(df: DataFrame, frozen: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Per key: how many rows the frozen set matches."""
    parts = []
    for name, key in [*((n, key_of(c)) for n, c in columns.items()), *pair_keys(columns)]:
        seen = frozen.select(key.alias("__own_seen")).distinct()
        parts.append(df.join(seen, key == F.col("__own_seen"), "left_semi").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("key"), "n"))
    return reduce(DataFrame.unionByName, parts)


def overlapping(splits: DataFrame, split: str, id_col: str) -> DataFrame:
    """Ids in more than one split."""
    return splits.select(id_col, split).distinct().groupBy(id_col).agg(F.count(F.lit(1)).alias("n_splits")).where("n_splits > 1")


def assert_isolated(splits: DataFrame, split: str, id_col: str) -> DataFrame:
    if not overlapping(splits, split, id_col).isEmpty():
        raise Rejected("splits_overlap", id_col)
    return splits


def assert_permitted(df: DataFrame, allowed: Column) -> DataFrame:
    """The rows, unless one is not allowed for training (null counts as not allowed)."""
    if not df.where(~F.coalesce(allowed, F.lit(False))).isEmpty():
        raise Rejected("training_use_not_allowed")
    return df


def curate(df: DataFrame, reason: Column, keys: list[str | Column], pos: str, duplicate: str = "duplicate_schema_question") -> tuple[DataFrame, DataFrame]:
    """(accepted rows, reasons with counts): rejects by ``reason``, then all but the first of a key."""
    judged = df.withColumn("__own_reason", reason)
    sound = judged.where(F.col("__own_reason").isNull()).drop("__own_reason")
    kept = keep_first(sound, keys, pos)
    log = judged.where(F.col("__own_reason").isNotNull()).groupBy(F.col("__own_reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    repeats = sound.agg(F.count(F.lit(1)).alias("n")).crossJoin(kept.agg(F.count(F.lit(1)).alias("k"))).select(F.lit(duplicate).alias("reason"), (F.col("n") - F.col("k")).alias("n")).where("n > 0")
    return kept, log.unionByName(repeats)


def within_capacity(df: DataFrame, tables: Column, columns: Column, most_tables: int, most_columns: int) -> DataFrame:
    return df.where((tables <= most_tables) & (columns <= most_columns))
