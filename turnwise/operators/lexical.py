"""Vocabulary, frequency, distinctive words, lengths, readability, formatting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnwise.functions import lexicons as L
from turnwise.functions import text as T
from turnwise.operators.stats import describe, mattr, per_1k, top_k
from turnwise.operators.turns import positioned, said_by


def content_tokens():
    """Alphabetic tokens of two letters or more that are no stop words."""
    return F.filter(T.alpha_tokens(F.col("content")), lambda w: (F.length(w) > 1) & ~w.isin(L.STOPWORDS))


def vocabulary(turns: DataFrame, role: str = "assistant", window: int = 500) -> DataFrame:
    rows = positioned(said_by(turns, role), content_tokens(), ["source"])
    return mattr(rows, ["source"], window).select("source", F.col("n").alias("tokens"), "types", F.round(F.col("types") / F.col("n"), 4).alias("ttr"), F.round("mattr", 4).alias("mattr"))


def top_words(turns: DataFrame, role: str = "assistant", k: int = 50) -> DataFrame:
    rows = said_by(turns, role).select("source", "conv_id", "turn_idx", F.posexplode(content_tokens()).alias("i", "word"))
    return top_k(rows, ["source"], "word", [F.col("conv_id"), F.col("turn_idx"), F.col("i")], k)


def distinctive(turns: DataFrame, role: str = "assistant", k: int = 30, features: int = 10_000) -> DataFrame:
    """TF-IDF of each source as one document: 1 + ln tf, smooth idf, unit length, over the most frequent words."""
    tf = said_by(turns, role).select("source", F.explode(content_tokens()).alias("word")).groupBy("source", "word").agg(F.count("*").alias("tf"))
    vocab = tf.groupBy("word").agg(F.sum("tf").alias("all"), F.count("*").alias("df")).orderBy(F.desc("all"), "word").limit(features)
    n = tf.agg(F.count_distinct("source").alias("n_sources"))
    score = (1 + F.log(F.col("tf"))) * (F.log((1 + F.col("n_sources")) / (1 + F.col("df"))) + 1)
    rows = tf.join(F.broadcast(vocab), "word").join(F.broadcast(n), F.lit(True)).withColumn("raw", score)  # at most ``features`` words
    w = rows.withColumn("score", F.col("raw") / F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("source"))))
    order = Window.partitionBy("source").orderBy(F.desc(F.round("score", 9)), F.desc("word"))
    return w.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("source", "word", F.round("score", 4).alias("score"), "rank")


def sentence_lengths(turns: DataFrame, role: str = "assistant") -> DataFrame:
    rows = said_by(turns, role).select("source", F.explode(T.sentences(F.col("content"))).alias("s"))
    return rows.groupBy("source").agg(*describe(T.word_count(F.col("s"))))


def response_lengths(turns: DataFrame, role: str = "assistant") -> DataFrame:
    return said_by(turns, role).groupBy("source").agg(*describe(T.word_count(F.col("content"))))


def readability(turns: DataFrame, role: str = "assistant", min_words: int = 5) -> DataFrame:
    rows = said_by(turns, role).where(T.word_count(F.col("content")) >= min_words).select("source", T.flesch_kincaid(F.col("content")).alias("fk"), T.gunning_fog(F.col("content")).alias("fog"))
    return rows.groupBy("source").agg(*(g for c in ("fk", "fog") for g in (F.round(F.avg(c), 4).alias(f"{c}_mean"), F.round(F.stddev_pop(c), 4).alias(f"{c}_std"), F.count(c).alias(f"{c}_count"))))


def formatting(turns: DataFrame, role: str = "assistant") -> DataFrame:
    """Marks of each kind and per 1k words; fences are halved after the sum over the source."""
    t = F.col("content")
    wide = said_by(turns, role).groupBy("source").agg(F.sum(T.word_count(t)).alias("w"), *(F.sum(F.regexp_count(t, F.lit(p))).alias(k) for k, p in L.FORMATS.items()))
    count = {k: F.floor(F.col(k) / 2) if k == "code_blocks" else F.col(k) for k in L.FORMATS}
    rows = F.array(*(F.struct(F.lit(k).alias("kind"), c.cast("long").alias("n")) for k, c in count.items()))
    return wide.select("source", "w", F.explode(rows).alias("r")).select("source", "r.kind", "r.n", per_1k(F.col("r.n"), F.col("w")).alias("per_1k"))


def marks_per_text():
    """All marks of one text, its fences halved by themselves (the monthly rule)."""
    n = {k: F.regexp_count("content", F.lit(f"(?d){p}")) for k, p in L.FORMATS.items()}  # (?d): lines end at \n only
    return sum((F.floor(c / 2) if k == "code_blocks" else c for k, c in n.items()), F.lit(0)).cast("long")
