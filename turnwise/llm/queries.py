"""The queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from turnwise.llm import op1_quality, op2_langid, op3_urls, op4_lm, op5_sentencepiece, op6_substring, op7_media, op8_simhash, op9_toxicity, op10_packing
from turnwise.llm.common import table
from turnwise.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, Query] = {}


def _query(f: Query) -> Query:
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return f(spark, sf_dir)

    _ALL[f.__name__] = run
    return run


def queries() -> dict[str, Query]:
    return dict(_ALL)


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filters": op3_urls.ORACLE}


@_query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return op1_quality.judge(docs, op1_quality.fit(docs, table(spark, sf_dir, "labels")))


@_query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_langid.language_id(table(spark, sf_dir, "documents"))


@_query
def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_urls.judge(table(spark, sf_dir, "pages"))


@_query
def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_lm.lm_scores(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@_query
def op5_sentencepiece_wfst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_sentencepiece.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@_query
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_substring.dedup(table(spark, sf_dir, "documents"))


@_query
def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_media.media_features(table(spark, sf_dir, "documents"))


@_query
def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_simhash.near_duplicates(table(spark, sf_dir, "documents"))


@_query
def op9_toxicity_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op10_packing_spfhp(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path
    return op10_packing.pack(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"))
