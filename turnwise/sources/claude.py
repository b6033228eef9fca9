"""Exports that are an array of conversations with chat_messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.functions import text as T
from turnwise.sources.json_files import only_arrays, records
from turnwise.sources.turns import finish, identity

SCHEMA = "uuid string, name string, created_at string, updated_at string, chat_messages array<struct<sender:string,text:string,created_at:string,content:array<struct<type:string,text:string>>>>"


def instant(x: Column) -> Column:
    """ISO 8601; null where it is none."""
    return F.try_to_timestamp(x)


def parse(raw: DataFrame) -> DataFrame:
    own = raw.withColumn("own_id", identity("uuid"))  # before messages become rows of their own
    rows = own.select(F.lit("claude").alias("source"), F.col("own_id").alias("conversation_id"), F.col("name").alias("title"), instant(F.col("created_at")).alias("created_at"), instant(F.col("updated_at")).alias("updated_at"), F.posexplode("chat_messages").alias("at", "m"))
    role = F.when(F.col("m.sender") == "human", "user").when(F.col("m.sender") == "assistant", "assistant")
    blocks = F.filter(F.transform(F.filter("m.content", lambda b: b["type"] == "text"), lambda b: b["text"]), lambda t: t.isNotNull() & (t != ""))
    joined = F.array_join(blocks, "\n\n")
    content = F.when(F.coalesce(T.strip(joined), F.lit("")) != "", joined).otherwise(F.coalesce("m.text", F.lit("")))
    return finish(rows.select("source", "conversation_id", "title", "created_at", "updated_at", "at", role.alias("role"), content.alias("content"), instant(F.col("m.created_at")).alias("ts")))


def read(spark: SparkSession, path: str) -> DataFrame:
    """``path`` may be a glob; each file holds a JSON array. Files that are no JSON give no turns, see ``json_files.broken``."""
    only_arrays(spark, path)
    return parse(records(spark, path, SCHEMA))
