"""The corpus pipeline, part of subpackage ``llm``: each stage takes all documents that the one before kept.

The classifier drops documents that it rejects, the rules drop those that they reject, near-duplicates leave one document of
each group, decontamination drops documents beyond the coverage limit and cuts shorter test passages out of the
others, and the last stage encodes what is left. All stages but the last return the columns of ``documents``.
"""

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import queries
from tidemark.session import materialize


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return queries.good_by_classifier(spark, docs, sf_dir)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return queries.good_by_rules(spark, docs, sf_dir)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return queries.without_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return queries.without_test_items(spark, docs, sf_dir)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return queries.bpe_digests(docs, queries.bpe.SHARED_WORDS)


STAGES = [("quality_classifier", quality_classifier), ("quality_rules", quality_rules), ("near_dedup", near_dedup),
          ("decontamination", decontamination), ("bpe", bpe)]

# A learnt classifier, hashed sketches and a tokenizer are beyond SQL; tests/llm holds the stages against models.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each one's result written and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
