"""Monthly activity, trends, inflection points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnwise.functions import lexicons as L
from turnwise.functions import text as T
from turnwise.operators.lexical import marks_per_text
from turnwise.operators.stats import expanding_z, mattr, per_1k, rounded
from turnwise.operators.turns import CONV, MIN_CHARS, positioned


def monthly(turns: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Filtered turns with the month of their conversation: its creation, else its first time stamp."""
    first = F.min_by("ts", F.when(F.col("ts").isNotNull(), F.col("turn_idx"))).over(Window.partitionBy(*CONV))
    at = F.coalesce("created_at", first)
    return turns.withColumn("month", F.date_format(at, "yyyy-MM")).where(F.col("month").isNotNull() & (F.length("content") >= min_chars))


def grid(rows: DataFrame) -> DataFrame:
    """Every month seen with every source: a few rows."""
    return rows.select("month").distinct().join(F.broadcast(rows.select("source").distinct()), F.lit(True))


def activity(turns: DataFrame, low: int = 20) -> DataFrame:
    m = monthly(turns)
    n = m.groupBy("month", "source").agg(F.count_distinct("conv_id").alias("convs"), F.count("*").alias("turns"), F.sum(F.when(F.col("role") == "assistant", T.word_count(F.col("content"))).otherwise(0)).alias("words"))
    return grid(m).join(n, ["month", "source"], "left").na.fill(0).select("month", "source", "convs", "turns", "words", (F.col("turns") < low).alias("low_confidence"))


def ranges(turns: DataFrame) -> DataFrame:
    """First and last month of each source, and of what all share."""
    own = monthly(turns).groupBy("source").agg(F.min("month").alias("first_month"), F.max("month").alias("last_month"))
    both = own.agg(F.max("first_month").alias("a"), F.min("last_month").alias("b"), F.count("*").alias("n")).where("n > 1")
    return own.union(both.select(F.lit("overlap"), "a", "b"))


def bot_trends(turns: DataFrame, window: int = 500) -> DataFrame:
    """Assistant metrics by month; null where a month has no text."""
    m = monthly(turns)
    bot, t = m.where("role = 'assistant'"), F.col("content")
    hedges = sum((T.count_phrase(F.lower(t), p) for ps in L.HEDGES.values() for p in ps), F.lit(0))
    n = bot.groupBy("month", "source").agg(F.avg(T.word_count(t)).alias("mean_words"), per_1k(F.sum(hedges), F.sum(T.word_count(t))).alias("hedges_per_1k"), per_1k(F.sum(marks_per_text()), F.sum(T.word_count(t))).alias("marks_per_1k"), F.avg(T.count_text(t, "?")).alias("questions"), F.avg(F.when(T.word_count(t) >= 5, T.flesch_kincaid(t))).alias("fk"))
    tokens = F.filter(T.words(F.lower(t)), lambda w: w.rlike(r"^\p{L}+$") & (F.length(w) > 1))
    v = mattr(positioned(bot, tokens, ["month", "source"]), ["month", "source"], window, "null")
    return grid(m).join(n, ["month", "source"], "left").join(v.select("month", "source", "mattr"), ["month", "source"], "left").select("month", "source", rounded("mean_words", 1).alias("mean_words"), rounded("mattr", 4).alias("mattr"), "hedges_per_1k", "marks_per_1k", rounded("questions", 4).alias("questions"), rounded("fk", 4).alias("fk"))


def user_trends(turns: DataFrame) -> DataFrame:
    m = monthly(turns)
    n = m.where("role = 'user'").groupBy("month", "source").agg(F.round(F.avg(T.word_count(F.col("content"))), 1).alias("mean_words"), F.round(F.count("*") / F.count_distinct("conv_id"), 2).alias("per_conv"), F.round(F.avg(F.col("content").contains("?").cast("int")), 4).alias("question_share"))
    return grid(m).join(n, ["month", "source"], "left")


def topic_shifts(labelled: DataFrame, k: int = 10) -> DataFrame:
    """month, topic, n, share of the month's turns, for the ``k`` largest topics. labelled: filtered turns with ``topic``."""
    rows = monthly(labelled).where("topic <> -1")
    top = rows.groupBy("topic").count().orderBy(F.desc("count"), "topic").limit(k).select("topic")
    n = rows.groupBy("month", "topic").agg(F.count("*").alias("n"))
    shared = n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("month")), 4))
    return shared.join(F.broadcast(top), "topic", "left_semi").select("month", "topic", "n", "share")


def all_inflections(trends: DataFrame, metrics: list[str], threshold: float = 1.5) -> DataFrame:
    """rank, source, metric, month, value, z of every metric's inflections, the strongest first."""
    long = trends.select("month", "source", *(F.col(m).cast("double").alias(m) for m in metrics)).unpivot(["month", "source"], metrics, "metric", "value")
    z = expanding_z(long, ["source", "metric"], "month", "value", threshold).withColumn("z", rounded("z", 2))
    order = Window.orderBy(F.desc(F.abs("z")), "source", "metric", "month")  # a row a month, source and metric at most
    return z.select(F.row_number().over(order).alias("rank"), "source", "metric", "month", "value", "z")


def inflections(trends: DataFrame, metric: str, threshold: float = 1.5) -> DataFrame:
    z = expanding_z(trends.select("month", "source", F.col(metric).alias("value")), ["source"], "month", "value", threshold)
    return z.select("source", "month", "value", F.round("z", 2).alias("z"))
