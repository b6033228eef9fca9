"""The turn table over the driver's ``conversations``; source and times are synthetic, from conv_id.

The driver's texts are invented prose in which no phrase of the word lists occurs. So that
these lists are tested by more than zeros, most turns get one line of ``LINES`` before or
after their text, or instead of it, by a rule on conversation and turn. The twin queries
in SQL apply the same rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINES = {
    "user": [
        "Please explain this step by step, thanks",
        "can you show me an example, just a short one?",
        "Write a list of all the names below",
        "here is the context: a long letter to my bank",
        "it's not what i want :) don't change it",
        "Fix the second part and be concise",
        "What is the best way to say this?",
        "Actually, I meant the other one. Sorry!",
        "I'm happy, that works \U0001F600 <3",
        "act as a teacher and make sure it is in simple terms",
        "ok thanks",
        "no punctuation in this one at all",
        "Would you mind if we do it again? I appreciate the detail",
        "how do i keep it short without losing the point",
    ],
    "assistant": [
        "I think it depends, however it might be likely.",
        "Sure! Here is what you asked for: a good and helpful answer.",
        "As an AI, I don't have personal views, but perhaps you could consult a professional.",
        "Here are three points:\n- **first** one\n- *second* one\n1. third one\n# Heading\n```code```",
        "Yes, we can do that. What would you like to see first? And why?",
        "I believe this is not a good idea; in general it tends to be a problem.",
        "The answer is clear and it is never wrong, however difficult.",
        "I'm not sure, but generally speaking it's worth noting that this may be useful.",
        "To be fair, on the other hand it seems possibly great.",
        "No. That said, you and I could find a better way?",
    ],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where("role in ('user', 'assistant')")
    idx = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    source = F.when(F.col("conv_id") % 3 == 0, "chatgpt").when(F.col("conv_id") % 3 == 1, "claude").otherwise("gemini")
    created = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * (3 * 86400))
    which = F.col("conv_id") * 5 + F.col("turn") * 3
    pick = lambda who: F.element_at(F.array(*map(F.lit, LINES[who])), (which % len(LINES[who])).cast("int") + 1)
    line, place = F.when(F.col("role") == "user", pick("user")).otherwise(pick("assistant")), F.col("conv_id") + F.col("turn")
    content = F.when((F.col("role") == "user") & (place % 7 == 3), line).when(place % 3 == 0, F.concat(line, F.lit("\n"), "text")).when(place % 3 == 1, F.concat("text", F.lit("\n"), line)).otherwise(F.col("text"))
    return rows.select(source.alias("source"), "conv_id", idx.alias("turn_idx"), "role", content.alias("content"), created.alias("created_at"), F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * (3 * 86400) + F.col("turn") * 60).alias("ts"))


def _pick(who: str) -> str:
    lines = ", ".join("'" + x.replace("'", "''") + "'" for x in LINES[who])
    return f"list_extract([{lines}], ((conv_id * 5 + turn * 3) % {len(LINES[who])})::INT + 1)"


TURNS_SQL = f"""WITH lined AS (SELECT *, CASE WHEN role = 'user' THEN {_pick("user")} ELSE {_pick("assistant")} END AS line FROM conversations WHERE role IN ('user', 'assistant')),
  turns AS (SELECT CASE conv_id % 3 WHEN 0 THEN 'chatgpt' WHEN 1 THEN 'claude' ELSE 'gemini' END AS source, conv_id,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn_idx, role,
  CASE WHEN role = 'user' AND (conv_id + turn) % 7 = 3 THEN line WHEN (conv_id + turn) % 3 = 0 THEN line || chr(10) || text WHEN (conv_id + turn) % 3 = 1 THEN text || chr(10) || line ELSE text END AS content,
  TIMESTAMP '2024-01-01' + to_seconds(conv_id * 259200) AS created_at, TIMESTAMP '2024-01-01' + to_seconds(conv_id * 259200 + turn * 60) AS ts
  FROM lined)"""
