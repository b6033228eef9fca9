"""Exports whose conversations are trees of nodes under a map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.functions import text as T
from turnwise.sources.json_files import only_arrays, records
from turnwise.sources.turns import finish, identity

NODE = "struct<parent:string,message:struct<author:struct<role:string>,create_time:double,content:struct<content_type:string,parts:array<variant>>>>"
SCHEMA = f"conversation_id string, id string, title string, create_time double, update_time double, current_node string, mapping map<string,{NODE}>"


def main_thread(mapping: Column, leaf: Column) -> Column:
    """Node ids from the root to ``leaf``: parents are followed to a missing node or a cycle."""
    start = F.struct(leaf.alias("at"), F.array().cast("array<string>").alias("path"))
    steps = F.when(F.size(mapping) > 0, F.sequence(F.lit(1), F.size(mapping))).otherwise(F.array().cast("array<int>"))

    def step(s: Column, _: Column) -> Column:
        stop = s["at"].isNull() | ~F.coalesce(F.map_contains_key(mapping, F.coalesce(s["at"], F.lit(""))), F.lit(False)) | F.array_contains(s["path"], F.coalesce(s["at"], F.lit("")))
        return F.when(stop, F.struct(F.lit(None).cast("string").alias("at"), s["path"].alias("path"))).otherwise(F.struct(F.element_at(mapping, s["at"])["parent"].alias("at"), F.concat(s["path"], F.array(s["at"])).alias("path")))

    return F.reverse(F.aggregate(steps, start, step)["path"])


def epoch(x: Column) -> Column:
    """Seconds, or milliseconds from 4102444800 on."""
    return F.timestamp_seconds(F.when(x > 4102444800, x / 1000).otherwise(x))


def parse(raw: DataFrame) -> DataFrame:
    """Turns from rows of SCHEMA; conversations without current node, turns or user turn go."""
    rows = raw.withColumn("own_id", identity("conversation_id", "id")).where("mapping is not null and current_node is not null and size(mapping) > 0")
    nodes = rows.select(F.col("own_id").alias("conversation_id"), "title", epoch(F.col("create_time")).alias("created_at"), epoch(F.col("update_time")).alias("updated_at"), "mapping", F.posexplode(main_thread(F.col("mapping"), F.col("current_node"))).alias("at", "node"))
    m = F.element_at("mapping", F.col("node"))["message"]
    strings = F.filter(F.transform(m["content"]["parts"], lambda p: F.when(F.schema_of_variant(p) == "STRING", F.try_variant_get(p, "$", "string"))), lambda p: p.isNotNull() & (T.strip(p) != ""))
    content = F.when(m["content"]["content_type"].isin("text", "multimodal_text"), F.array_join(strings, "\n\n"))
    return finish(nodes.select(F.lit("chatgpt").alias("source"), "conversation_id", "title", "created_at", "updated_at", "at", m["author"]["role"].alias("role"), content.alias("content"), epoch(m["create_time"]).alias("ts")))


def read(spark: SparkSession, path: str) -> DataFrame:
    """``path`` may be a glob of export files; each holds a JSON array."""
    only_arrays(spark, path)
    return parse(records(spark, path, SCHEMA))
