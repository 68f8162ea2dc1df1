"""The corpus pipeline: language ID, near duplicates, decontamination, secrets, mixing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next stage's documents.  All stages but the last
return the columns of ``documents``.

* ``language_id`` learns from the labelled training fold of its own documents, drops
  documents without a language (null texts, texts without a letter) or in none that it learned and keeps
  the rest as they are.
* ``near_dedup`` keeps the document with the least id of each group.
* ``decontaminate`` drops documents that hold a benchmark item.
* ``secret_scan`` replaces every secret by a mark and keeps the document.
* ``mix_sources`` returns the documents of the mix with the words it takes from each.

Columns beyond those of ``documents`` are passed through by the filtering stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planloom.llm import decontaminate as decontamination
from planloom.llm import language_id as languages
from planloom.llm import secret_scan as secrets
from planloom.llm import simhash_dedup
from planloom.llm.mixing import mix
from planloom.llm.tables import shared_folder, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = languages.fit(docs.where(~languages.held_out()))
    return languages.keep_identified(docs, model, only_known=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.keep_first(docs).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_leaks(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return clean.select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    taken = mix(docs).taken().where("taken > 0")
    return taken.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "taken")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
]

#: Mixture inference and the drawn mix are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; results between stages are Parquet in the shared folder."""
    folder = shared_folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = f"{folder}/{i}_{name}"
            docs.write.mode("overwrite").parquet(path)
            docs = spark.read.parquet(path)
    return docs
