"""Corpus preparation in five stages, each written as Parquet before the next one reads it.

Documents that quality rules reject go, repeated lines go, one document of each
group of near duplicates stays, sources are mixed to target weights, and what is left
is packed into sequences of 2,048 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from featureflow.llm import line_dedup, mixing, packing, quality_rules, simhash
from featureflow.llm.common import documents
from featureflow.session import stage, tidy


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.without_repeats(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_rows(docs, mixing.PIPELINE, whole_rows=True)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("mixing", mixture),
    ("packing", packed),
]

#: SimHash and token ids are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


@tidy
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, fn in STAGES[:-1]:
        docs = stage(fn(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
