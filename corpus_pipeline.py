"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept, and returns the documents it
keeps with their columns; the last returns the mix. Nulls, empty tables, repeated rows and further columns: see the
stages themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronolith.llm import stages
from chronolith.llm.common import stored, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.known_language(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.not_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.not_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.mixed(docs)


STAGES = [("language", language), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing)]

#: Trained classifiers decide in two stages, which SQL cannot express; tests/llm/test_pipeline.py holds run()
#: against a brute-force version of all five stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
