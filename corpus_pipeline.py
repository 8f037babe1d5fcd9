"""The pipeline over ``documents``: toxicity, language, near-duplicates, packing. Each stage works on what is left."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quirewise.llm import langid, near, queries, toxicity
from quirewise.sources.sinks import drop_staged, stage_table


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out toxic documents; the model learns from the labelled ones of ``docs``."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out documents whose language is unknown or ambiguous; the model learns from ``docs``."""
    return langid.with_known_language(docs)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: near fingerprints, or five-word shingles that are 0.8 alike."""
    return near.one_of_each(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where the tokens of each piece of each document lie in which training sequence."""
    return queries.packed_tokens(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", clean),
    ("language", in_a_language),
    ("near_duplicates", unlike),
    ("packing", packed),
]

#: The stages learn models and follow links of any length, which SQL doesn't express; the operators have tests by brute
#: force, and the pipeline is held against its stages one by one.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table; what a stage returns is written to the shared folder, read by the next and removed
    when that one is done."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = stage_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            drop_staged(before)
        before = docs
    return docs
