"""A training corpus from raw documents: five stages, each over all that the one before kept.

Quality rules and toxicity drop documents, SimHash keeps one document of each group
of near copies, substring dedup drops repeated passages of 35 words or more, packing
cuts what is left into sequences. Each stage's result is written and read again, so
a lost executor costs at most that stage. Rows without doc_id pass like others, and
repeated rows are near copies of each other, so one stays; an empty table gives an
empty result; a null text is an empty one and fails the first stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from turnwise.llm import op1_quality, op6_substring, op8_simhash, op9_toxicity, op10_packing
from turnwise.llm.common import table, written
from turnwise.session import ship_package


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op1_quality.kept(docs, op1_quality.fit(docs, table(spark, sf_dir, "labels")))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return op9_toxicity.kept(docs, op9_toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return op8_simhash.one_of_each(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return op6_substring.deduplicated(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    path = public_tokenizers.path
    return op10_packing.pack(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("packing", packing),
]

#: Learned stages and fingerprints have no SQL form; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
