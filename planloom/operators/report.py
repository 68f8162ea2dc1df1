"""Quality reports, novelty, overlap, length audits, classifications and manifests over record tables."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom.functions.text import token_overlap, words
from planloom.operators.curate import key_of
from planloom.plans.errors import Rejected


def split_report(df: DataFrame, split: str, keys: list[str | Column], family: str) -> DataFrame:
    """Per split: rows, distinct keys, duplicates, families."""
    per_key = df.groupBy(F.col(split).alias("split"), key_of(*keys).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    sums = per_key.groupBy("split").agg(F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("distinct_keys"))
    families = df.select(F.col(split).alias("split"), family).distinct().groupBy("split").agg(F.count(family).alias("families"))
    return sums.join(families, "split").withColumn("duplicates", F.col("rows") - F.col("distinct_keys"))


def counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def overlap_matrix(df: DataFrame, split: str, key: Column) -> DataFrame:
    """For every two splits: how many keys both have."""
    held = df.select(F.col(split).alias("s"), key.alias("k")).distinct()
    by_key = held.groupBy("k").agg(F.sort_array(F.collect_set("s")).alias("ss")).where("size(ss) > 1")  # one value per split at most
    pairs = by_key.select(F.explode("ss").alias("left_split"), "ss").select("left_split", F.explode("ss").alias("right_split")).where("left_split < right_split")
    return pairs.groupBy("left_split", "right_split").agg(F.count(F.lit(1)).alias("n"))


def novelty(df: DataFrame, reference: DataFrame, tokens: Column) -> DataFrame:
    """One row: distinct tokens, those the reference lacks, and their rate."""
    own = df.select(F.explode(tokens).alias("t")).distinct()
    known = reference.select(F.explode(tokens).alias("r")).distinct().withColumn("_known", F.lit(1))
    met = own.join(known, F.col("t") == F.col("r"), "left")
    out = met.agg(F.count(F.lit(1)).alias("tokens"), F.count_if(F.col("_known").isNull()).alias("novel"))
    return out.withColumn("rate", F.col("novel") / F.greatest("tokens", F.lit(1)))


def mean_overlap(df: DataFrame, left: str, right: str, by: str) -> DataFrame:
    """Mean share of the right text's words that the left has, by group."""
    share = token_overlap(words(left), words(right))
    return df.groupBy(by).agg(F.round(F.avg(share), 9).alias("overlap"), F.count(share).alias("n"))


def length_audit(df: DataFrame, length: str, limit: int, complete: Column) -> DataFrame:
    """Counts of complete, partial, empty and over-long sequences, and the longest."""
    long = F.col(length) > limit
    none = F.coalesce(F.col(length), F.lit(0)) == 0
    whole = F.coalesce(complete, F.lit(False)) & ~long & ~none
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(whole).alias("complete"), F.count_if(~whole & ~none & ~F.coalesce(long, F.lit(False))).alias("partial"), F.count_if(none).alias("zero"),
        F.count_if(long).alias("over_limit"), F.max(length).alias("longest"),
    )


def require_complete(audit: DataFrame) -> None:
    row = audit.first()
    bad = {k: row[k] for k in ("partial", "zero", "over_limit") if row[k]}
    if bad:
        raise Rejected("incomplete_sequences", json.dumps(bad))


# --- classifications of a column of plans (struct, see plans.logical.PLAN_STRUCT) ---


def _has(plan: str, name: str) -> Column:
    return F.col(f"{plan}.{name}").isNotNull()


def _many(plan: str, name: str) -> Column:
    return F.coalesce(F.size(f"{plan}.{name}"), F.lit(0))


def family_of(plan: str) -> Column:
    return (
        F.when(_has(plan, "join_table"), "join").when(_many(plan, "group_by") > 0, "group").when(_has(plan, "aggregate"), "aggregate").when(F.col(f"{plan}.distinct"), "distinct")
        .when(_many(plan, "filters") > 0, "filter").when(_has(plan, "order_by") | _has(plan, "limit"), "order_limit").otherwise("select")
    )


def linking_family_of(plan: str) -> Column:
    return F.when(_has(plan, "join_table") & _has(plan, "aggregate"), "joined_aggregate").when(_has(plan, "join_table"), "join").when(_many(plan, "group_by") > 0, "group").when(_many(plan, "filters") > 0, "filter").otherwise("replay")


def signature_of(plan: str) -> Column:
    operation = F.when(_many(plan, "group_by") > 0, "group_count").when(F.col(f"{plan}.distinct"), "distinct").when(_has(plan, "aggregate"), F.lower(f"{plan}.aggregate")).otherwise("select")
    filters = F.when(_many(plan, "filters") > 0, F.concat(F.lit("filter"), _many(plan, "filters").cast("string"), F.lit("_"), F.lower(f"{plan}.filter_connector")))
    return F.concat_ws("_", F.lit("compose"), F.when(_has(plan, "join_table"), "join").otherwise("single"), operation, filters, F.when(_has(plan, "order_by"), "order"), F.when(_has(plan, "limit"), "limit"))


def tier_of(plan: str) -> Column:
    traits = (_has(plan, "join_table"), _many(plan, "filters") > 0, _many(plan, "filters") > 1, _many(plan, "group_by") > 0, _has(plan, "order_by"), _has(plan, "limit"))
    n = sum((t.cast("int") for t in traits), F.lit(0))
    return F.when(n == 0, "atomic").when(n == 1, "pair").otherwise("multi")


def distribution(df: DataFrame, plan: str) -> DataFrame:
    """Counts of aggregates, predicate operators and connectors of several predicates: (kind, value, n)."""
    aggregate = df.select(F.lit("aggregate").alias("kind"), F.coalesce(F.col(f"{plan}.aggregate"), F.lit("none")).alias("value"))
    operators = df.select(F.explode(f"{plan}.filters").alias("f")).select(F.lit("operator").alias("kind"), F.col("f.operator").alias("value"))
    connectors = df.where(_many(plan, "filters") > 1).select(F.lit("connector").alias("kind"), F.col(f"{plan}.filter_connector").alias("value"))
    return counts(aggregate.unionByName(operators).unionByName(connectors), "kind", "value")


def formatted(schema: Column, question: Column, target: Column) -> Column:
    """A record as tagged text."""
    return F.concat(F.lit("<schema>\n"), schema, F.lit("\n<question>\n"), question, F.lit("\n<target>\n"), target)


def manifest(df: DataFrame, id_col: str, content: Column) -> tuple[str, int]:
    """A hash that freezes a set of rows, however they are partitioned, and their number.

    Rows are dealt to 4096 buckets by the hash of their id and folded in order within
    a bucket, as a stream; only one hash per bucket reaches the driver.
    """
    rows = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.sha2(content, 256).alias("h")).withColumn("b", F.substring(F.sha2("i", 256), 1, 3))

    def fold(batches):
        import pyarrow as pa

        held, digest, n = None, None, 0

        def done():
            return pa.RecordBatch.from_arrays([pa.array([held]), pa.array([digest.hexdigest()]), pa.array([n])], names=["b", "digest", "n"])

        for batch in batches:
            for b, i, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != held:
                    if n:
                        yield done()
                    held, digest, n = b, hashlib.sha256(), 0
                digest.update(f"{i}\t{h}\n".encode())
                n += 1
        if n:
            yield done()

    sorted_rows = rows.repartition("b").sortWithinPartitions("b", "i", "h").select("b", "i", "h")
    parts = sorted(map(tuple, sorted_rows.mapInArrow(fold, "b string, digest string, n bigint").collect()))  # at most 4096
    return hashlib.sha256(json.dumps([p[1] for p in parts]).encode()).hexdigest(), sum(p[2] for p in parts)
