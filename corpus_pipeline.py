"""Documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), with docs as the stage before it wrote them, and returns documents with the
columns that it was given; the last returns the pieces of packed sequences. Documents that the quality rules reject go, one
document of each near-duplicate group stays, passages that occur earlier go from texts, and secrets are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadloom.llm import near_dedup, packing, quality, secrets, substrings
from threadloom.sources.tables import removed, settled, table, written

#: Near duplicates share 0.8 of their shingles of five words.
SHINGLE, PERCENT = 5, 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_rules(docs, table(spark, sf_dir, "labels"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs, PERCENT, SHINGLE)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substrings.remove_repeated(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.cost_balanced_packing(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("near_dedup", near_stage),
    ("substring_dedup", substring_stage),
    ("secret_scans", secret_stage),
    ("packing", packing_stage),
]

#: The last stage's ids are those of a tokenizer library, which SQL can't express; tests hold it against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences. When a stage's result has been written, what the stages before wrote on the way is removed; the last stage's tables stay, as the result reads them."""
    docs, old = table(spark, sf_dir, "documents"), []
    for k, (name, stage) in enumerate(STAGES):
        with written() as paths:
            docs = stage(spark, docs, sf_dir)
            if k + 1 < len(STAGES):
                docs = settled(docs, f"pipeline-{name}")
        if k + 1 < len(STAGES):
            removed(spark, old + paths[:-1])
            old = paths[-1:]
    return docs
