"""From raw documents to a training mixture: filter, deduplicate, decontaminate, redact, mix.

Each stage takes (spark, docs, sf_dir) and gives the rows and columns of documents that it keeps; the
last adds ``rate`` and ``copies``. Stages are written as Parquet and read again by the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusworks.llm import decontam, mixing, nearcopies, quality, secrets
from corpusworks.llm.common import materialise, table
from corpusworks.llm.queries import domain_labels


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores 0.7 or more."""
    return quality.accept(docs, quality.fit(docs, table(spark, sf_dir, "labels")), 0.7)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of smallest id, of each group linked by SimHash fingerprints that differ in three bits or fewer.

    Texts that these leave apart are linked where their five-word Jaccard similarity is 0.8 or more.
    """
    return nearcopies.keep_one(docs, nearcopies.near_copies(docs, bits=True))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return decontam.without(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked in their texts."""
    return secrets.redact(docs, secrets.learn(docs)).withColumn("n_chars", F.length("text").cast("long"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents taken once or more so that languages have equal expected tokens, with rate and copies."""
    return mixing.mixed(docs, domain_labels(docs, table(spark, sf_dir, "labels")))


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("mixing to target weights", mixing_stage),
]

#: Trained models decide in the stages, which SQL cannot state; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
