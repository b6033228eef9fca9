"""Parquet, JSON and Markdown sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_turns(turns: DataFrame, path: str) -> None:
    """One table, a folder a source."""
    turns.write.mode("overwrite").partitionBy("source").parquet(path)


def pruned(value, digits: int = 4):
    """As results are stored: raw distributions by size only, floats rounded. Other lists stay whole, as charts read them."""
    if isinstance(value, dict):
        return {k: f"<{len(v)} values>" if k == "distribution" and isinstance(v, list) else pruned(v, digits) for k, v in value.items()}
    if isinstance(value, list):
        return [pruned(v, digits) for v in value]
    return round(value, digits) if isinstance(value, float) else value


def to_json(results: dict[str, DataFrame]) -> str:
    """Small result tables as one JSON text."""
    return json.dumps({k: [pruned(r.asDict(True)) for r in df.collect()] for k, df in results.items()}, indent=2, default=str)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text through the file system that Spark uses."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    try:
        stream.write(text.encode())
    finally:
        stream.close()


def parse_summary(turns: DataFrame) -> DataFrame:
    """Conversations, turns by role and dates of each source and of all."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    n = turns.rollup("source").agg(F.count_distinct("source", "conv_id").alias("conversations"), F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("user_turns"), F.count_if(F.col("role") == "assistant").alias("assistant_turns"), day(F.min("created_at")).alias("first"), day(F.max("created_at")).alias("last"))
    return n.withColumn("source", F.coalesce("source", F.lit("all")))
