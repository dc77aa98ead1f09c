"""A corpus pipeline of five stages, each an operator of ``marginalia.llm``.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept,
and returns a DataFrame; all but the last return the columns of ``documents``.
A stage's result is written as Parquet and read again before the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marginalia.llm import bpe, jaccard, lines, packing, quality, toxicity
from marginalia.llm import common as C


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest-neighbour vote rejects go."""
    return quality.keep_good(docs, quality.fit(docs, C.table(spark, sf_dir, "labels")))


def toxicity_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string-kernel machine calls toxic go."""
    return toxicity.keep_civil(docs, toxicity.fit(docs, C.table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines spread over many sites leave the texts."""
    return lines.rewritten(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: five words a shingle, similarity 0.8 or more."""
    return jaccard.one_of_each(docs, 5, 80)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all that is left, in sequences of 2048 tokens."""
    return packing.pack(docs, bpe.default_path())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("toxicity", toxicity_classifier),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", near_duplicates),
    ("packing", packing_stage),
]

#: Trained models and token ids have no SQL: the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, in order."""
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = C.staged(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
