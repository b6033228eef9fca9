"""The end of every source: roles, blank turns, conversations without a user turn, turn numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnwise.functions import text as T

COLUMNS = ["source", "conversation_id", "title", "created_at", "updated_at", "conv_seq", "turn_idx", "role", "content", "ts"]


def identity(*ids: str) -> Column:
    """The first id that is neither null nor empty; else one from the file and the row's place in it, so that such conversations stay apart."""
    given = [F.when(F.col(i) != "", F.col(i)) for i in ids]
    return F.coalesce(*given, F.concat(F.lit("row-"), F.substring(F.sha2(F.concat_ws("#", F.input_file_name(), F.monotonically_increasing_id().cast("string")), 256), 1, 16)))


def finish(rows: DataFrame) -> DataFrame:
    """rows: source, conversation_id, title, created_at, updated_at, at (order), role, content, ts.

    ``conv_seq`` orders conversations as they were first seen; ``turn_idx`` counts the turns that stay, from 0.
    """
    kept = rows.withColumn("seq", F.monotonically_increasing_id()).withColumn("content", T.strip(F.col("content"))).where("role in ('user', 'assistant') and content <> ''")
    conv = Window.partitionBy("source", "conversation_id")
    out = kept.withColumns({"users": F.count_if(F.col("role") == "user").over(conv), "conv_seq": F.min("seq").over(conv)}).where("users > 0").withColumn("turn_idx", F.row_number().over(conv.orderBy("at", "seq")) - 1)
    return out.withColumn("title", F.when(F.col("title") != "", F.col("title"))).select(*COLUMNS)


def read_turns(spark: SparkSession, path: str) -> DataFrame:
    """The stored turn table; a filter on ``source`` reads that source's folder only."""
    kinds = {"created_at": "timestamp", "updated_at": "timestamp", "ts": "timestamp", "conv_seq": "long", "turn_idx": "int"}
    return spark.read.schema(", ".join(f"{c} {kinds.get(c, 'string')}" for c in COLUMNS)).parquet(path)


def as_turns(stored: DataFrame) -> DataFrame:
    """The form that analyses take: conversations by ``conv_id``."""
    return stored.withColumnRenamed("conversation_id", "conv_id")
