"""Corpora put together from the operators: curricula, gates and replay mixtures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planloom.operators import curate, generate, report, sample
from planloom.plans.errors import Rejected


@dataclass(frozen=True)
class Built:
    """A corpus, its log of rejections and its report by name."""

    records: DataFrame
    log: DataFrame
    report: dict[str, DataFrame]


def record_keys() -> dict[str, Column]:
    """What contamination compares: schema text without blanks, question and SQL, all folded."""
    from planloom.functions.text import folded, normalized_sql

    return {"schema": F.regexp_replace(F.lower("schema_sql"), r"\s+", ""), "question": folded("question"), "sql": normalized_sql("sql")}


def curriculum(sources: dict[str, DataFrame], weights: dict[str, int], total: int, frozen: DataFrame, seed: int, allowed: Column | None = None) -> Built:
    """Sources (records with a unique ``pos``) to one weighted mixture.

    Each source loses repeats, rows in conflict with an earlier one and rows that share a
    pair key with the frozen records; then exact quotas are drawn.  A source that
    may not be used for training, or is too small, is an error.
    """
    clean, logs = {}, []
    for name, df in sources.items():
        if allowed is not None:
            curate.assert_permitted(df, allowed)
        first = curate.keep_first(df, ["schema_id", F.lower("question"), "sql"], "pos")
        agreed = curate.exclude_conflicts(first, ["schema_id", F.lower("question")], "sql", "pos")
        kept, log = curate.decontaminate(agreed, frozen, record_keys())
        clean[name] = kept
        logs.append(log.withColumn("mix_source", F.lit(name)))
    mixed = sample.mix_sources(clean, weights, total, ["pos"], seed, "id")
    log = logs[0]
    for x in logs[1:]:
        log = log.unionByName(x)
    if not curate.contamination(mixed, frozen, record_keys()).where("size(matches) > 0").isEmpty():
        raise Rejected("mixture_is_contaminated")
    return Built(mixed, log, {"sources": report.counts(mixed, "mix_source"), "duplicates": curate.duplicate_count(mixed, ["schema_id", F.lower("question")])})


def replay(new: DataFrame, old: DataFrame, per_new: int, seed: int) -> Built:
    """New records with ``per_new`` old ones each; old rows that contradict a new one go, the rest cycle."""
    n = new.count()
    keys = ["schema_id", "question"]
    marked = new.withColumn("_rank", F.lit(0)).unionByName(old.withColumn("_rank", F.lit(1)))
    ordered = marked.withColumn("_at", F.struct("_rank", "pos"))
    agreed = curate.exclude_conflicts(ordered, keys, "sql", "_at").where("_rank = 1").drop("_rank", "_at")
    drawn = sample.cycle_sample(agreed, n * per_new, ["pos"], seed).withColumn("id", F.concat_ws(":", F.lit("replay"), F.col("cycle").cast("string"), "id")).drop("cycle")
    both = new.withColumn("mix_source", F.lit("new")).unionByName(drawn.withColumn("mix_source", F.lit("replay")))
    dropped = old.agg(F.count(F.lit(1)).alias("n")).crossJoin(agreed.agg(F.count(F.lit(1)).alias("k"))).select(F.lit("conflict").alias("reason"), (F.col("n") - F.col("k")).alias("n"))
    return Built(both, dropped, {"sources": report.counts(both, "mix_source"), "conflicts": curate.conflict_audit(both, keys, "sql")})


#: Gates: how their corpora are made.
GATES = {
    "challenge": {"mode": "composed"}, "opaque": {"mode": "families", "opaque": True}, "casual": {"mode": "families", "tone": "casual"},
    "held_out_wording": {"mode": "families", "tone": "held_out"}, "cross_product": {"mode": "cross"},
}


def gate(spark: SparkSession, name: str, schemas: int, per_schema: int, seed: int, against: DataFrame | None = None) -> DataFrame:
    """A frozen evaluation corpus in the order of its ids, tagged with its name; schemas seen in ``against`` are left out."""
    if name not in GATES:
        raise Rejected("unknown_gate", name)
    df = generate.corpus(spark, schemas, per_schema, seed, **GATES[name]).withColumn("evaluation_track", F.lit(name))
    if against is not None:
        df = df.join(against.select("schema_id").distinct(), "schema_id", "left_anti")
    return df.orderBy("id")


def contrast_gate(spark: SparkSession, schemas: int, seed: int) -> DataFrame:
    """Minimal pairs of many schemas, made by the executors."""
    import pandas as pd

    fields = ["id", "counterfactual_group", "counterfactual_change", "schema_sql", "database_sql", "sql", "question"]

    def make(parts):
        for part in parts:
            rows = [{k: r[k] for k in fields} for n in part["id"] for r in generate.contrast_corpus(seed, int(n))]
            if rows:
                yield pd.DataFrame(rows, columns=fields)

    return spark.range(schemas).mapInPandas(make, ", ".join(f"{f} string" for f in fields))
