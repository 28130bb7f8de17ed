"""A corpus pipeline: quality, near-duplicates, decontamination, mixture, shards.

``STAGES`` lists ``(name, function)``; each function takes ``(spark, docs,
sf_dir)`` and returns what it keeps of ``docs``.  Between two stages the
documents are written as Parquet and read again, so that a lost executor costs
a stage at most.  All stages but the last return the columns of ``documents``;
the last adds ``shard`` and ``slot``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxelframe.llm import decontamination, mixing, near_dup, quality, sharding
from voxelframe.llm.common import Scratch, table

N_SHARDS = 16


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose perplexity lies above the threshold of their language.

    Null and empty texts have no words and stay, as everything does without labels; null keys and languages are like
    any others, whole texts count however long, repeated rows stay or go together, and other columns pass through.
    """
    return quality.score(docs, table(spark, sf_dir, "labels")).where("keep").select(*docs.columns)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest id, of each group of near-duplicates (five words, similarity 0.8).

    Null, empty and blank texts are linked with nothing and stay.  Rows without a key take part, after those with one;
    of rows that repeat key and text one stays.  Other columns pass through, whatever their names.
    """
    return near_dup.drop_near_duplicates(docs, size=5, threshold=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item; null and empty texts hold none, and an empty benchmark drops nothing."""
    return decontamination.remove(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source up to its target; a document taken twice is there twice.

    Documents without words (null, empty, blank) cannot count towards a target and stay out.  Null is a source like any
    other; null and repeated keys are dealt by their texts.
    """
    return mixing.mix(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ``shard`` and ``slot``: every shard has the mixture of the whole.  No row is left out; columns of these names are replaced."""
    return sharding.shard(docs, N_SHARDS)


STAGES = [
    ("quality classifier", quality_stage),
    ("near-duplicates", near_dup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("source mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: The quality model and MinHash have no form in SQL; tests/llm compares the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.keep(docs, f"stage{i}")
    return docs
