"""A training corpus from raw documents: filter, deduplicate, decontaminate, clean, mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.llm import decontaminate, jaccard, mixing, quality, secrets
from voxmill.llm.frames import table
from voxmill.session import discard, store


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling does not draw go; columns named like its own stay as they are."""
    others = [c for c in docs.columns if c.lower() not in ("doc_id", "text")]
    row = F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in others)).alias("_row")
    kept = quality.resample(docs.select("doc_id", "text", row), table(spark, sf_dir, "labels")).where("kept")
    return kept.select(*(F.col(f"_row.`{c}`").alias(c) if c in others else F.col(c).alias(c) for c in docs.columns))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the least doc_id."""
    return jaccard.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret values are masked in the texts."""
    return secrets.mask(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: one row per copy of a document."""
    return mixing.emit(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secret_stage),
    ("mixing sources to target weights", mixing_stage),
]

#: SQL cannot express the first two stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's result is stored and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, docs = docs, store(stage(spark, docs, sf_dir), "stage")
        discard(before)
    return docs
