"""A corpus from documents to packed sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on every row that the one before kept. ``run`` writes
each stage's rows as Parquet in the shared folder and reads them again for the next; the last but one is then deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattica.llm.common import discard, materialize
from lattica.llm.exact_dedup import drop_exact_copies
from lattica.llm.jaccard_join import one_of_each_component
from lattica.llm.mixing import mixed_documents
from lattica.llm.packing import pack
from lattica.llm.quality_classifier import keep_good


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return keep_good(docs, _labels(spark, sf_dir))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the largest doc_id."""
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 0.8 of its 5-word shingles, the one with the smallest doc_id."""
    return one_of_each_component(docs, width=5, num=80, den=100)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the fitted rates say."""
    return mixed_documents(docs, _labels(spark, sf_dir))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 2048."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2048)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mixing", mixing), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
