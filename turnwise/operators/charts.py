"""The data of each chart as rows (series, x, y): x a category or a place as text, y a number."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.functions import lexicons as L
from turnwise.functions import text as T
from turnwise.operators import comparative, lexical, pragmatic, semantic, structure, temporal, user
from turnwise.operators import stats as S
from turnwise.operators.turns import said_by

CHARTS: dict[str, Callable[[DataFrame], DataFrame]] = {}
BOT_SERIES = ["mean_words", "mattr", "fk", "hedges_per_1k", "marks_per_1k", "questions"]


def chart(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    CHARTS[f.__name__] = f
    return f


def xy(df: DataFrame, series: Column | str, x: Column | str, y: Column | str) -> DataFrame:
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(as_col(series).cast("string").alias("series"), as_col(x).cast("string").alias("x"), F.round(as_col(y).cast("double"), 4).alias("y"))


def wide(df: DataFrame, columns: list[str]) -> DataFrame:
    """A source's columns as bars."""
    return xy(df.select("source", *(F.col(c).cast("double").alias(c) for c in columns)).unpivot(["source"], columns, "x", "y"), "source", "x", "y")


def binned(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Share of a source's values in each of equal bins from the least to the greatest of all; x is the bin's lower end."""
    ends = df.agg(F.min(value).cast("double").alias("low"), F.max(value).cast("double").alias("high"))
    rows = df.where(F.col(value).isNotNull()).join(F.broadcast(ends), F.lit(True))
    width = (F.col("high") - F.col("low")) / bins
    b = F.coalesce(F.least(F.floor(F.try_divide(F.col(value) - F.col("low"), width)), F.lit(bins - 1)), F.lit(0))
    n = rows.groupBy("source", F.round(F.col("low") + b * width, 6).cast("decimal(18,6)").alias("x")).agg(F.count("*").alias("n"))
    return xy(n, "source", "x", F.col("n") / F.sum("n").over(Window.partitionBy("source")))


def months(df: DataFrame, columns: list[str]) -> DataFrame:
    """A line for each source and column; months without a value are left out."""
    long = df.select("month", "source", *(F.col(c).cast("double").alias(c) for c in columns)).unpivot(["month", "source"], columns, "metric", "value").where("value is not null")
    return xy(long, F.concat_ws(" ", "source", "metric"), "month", "value")


@chart
def vocabulary_comparison(turns: DataFrame) -> DataFrame:
    return wide(lexical.vocabulary(turns), ["mattr", "ttr", "types"])


@chart
def distinctive_words(turns: DataFrame) -> DataFrame:
    return xy(lexical.distinctive(turns, k=15), "source", "word", "score")


@chart
def response_length_distributions(turns: DataFrame) -> DataFrame:
    """Histogram of 60 bins up to the 95th percentile."""
    w = said_by(turns, "assistant").select("source", T.word_count(F.col("content")).alias("w"))
    return binned(w.join(F.broadcast(w.agg(F.percentile("w", 0.95).alias("most"))), F.lit(True)).where("w <= most"), "w", 60)


@chart
def formatting_habits(turns: DataFrame) -> DataFrame:
    return xy(lexical.formatting(turns), "source", "kind", "per_1k")


@chart
def topic_distribution(turns: DataFrame) -> DataFrame:
    """The ten largest topics. ``turns`` may bring their own ``topic``."""
    labelled = turns if "topic" in turns.columns else semantic.topics(said_by(turns, "assistant"))
    return xy(semantic.topic_shares(labelled, 10), "source", "topic", "share")


@chart
def hedging_comparison(turns: DataFrame) -> DataFrame:
    """The ten phrases with the greatest rate in any source."""
    rows = pragmatic.phrases(turns, "assistant", L.HEDGES)
    top = rows.groupBy("phrase").agg(F.max("per_1k").alias("most")).orderBy(F.desc("most"), "phrase").limit(10).select("phrase")
    return xy(rows.join(F.broadcast(top), "phrase", "left_semi"), "source", "phrase", "per_1k")


@chart
def style_fingerprint(turns: DataFrame, encode=semantic.encode) -> DataFrame:
    return xy(comparative.fingerprint(turns, encode), "source", "metric", "scaled")


@chart
def verbosity_ratio(turns: DataFrame) -> DataFrame:
    return binned(comparative.verbosity_points(turns), "ratio", 60)


@chart
def user_language_comparison(turns: DataFrame) -> DataFrame:
    words = user.complexity(turns).select("source", F.col("words_mean").alias("message_words"))
    rich = user.vocabulary(turns).select("source", "mattr")
    asks = pragmatic.question_rate(turns, "user").select("source", F.col("mean_per_turn").alias("questions"))
    polite = pragmatic.phrases(turns, "user", {"politeness": L.POLITENESS_SUBSTRINGS}, plain=True).groupBy("source").agg(F.sum("per_1k").alias("politeness"))
    return wide(words.join(rich, "source").join(asks, "source").join(polite, "source"), ["message_words", "mattr", "questions", "politeness"])


@chart
def opening_patterns(turns: DataFrame) -> DataFrame:
    """Percent of a source's turns that open with each of its first words."""
    n = said_by(turns, "assistant").groupBy("source").agg(F.count("*").alias("all"))
    return xy(pragmatic.openings(turns).join(F.broadcast(n), "source"), "source", "opening", F.col("n") * 100 / F.col("all"))


@chart
def activity_over_time(turns: DataFrame) -> DataFrame:
    return months(temporal.activity(turns), ["turns", "convs"])


@chart
def bot_metrics_trends(turns: DataFrame) -> DataFrame:
    return months(temporal.bot_trends(turns), BOT_SERIES)


@chart
def user_metrics_trends(turns: DataFrame) -> DataFrame:
    return months(temporal.user_trends(turns), ["mean_words", "per_conv", "question_share"])


@chart
def inflection_points(turns: DataFrame) -> DataFrame:
    rows = temporal.all_inflections(temporal.bot_trends(turns), BOT_SERIES)
    return xy(rows, F.concat_ws(" ", "source", "metric"), "month", "z")


@chart
def depth_distribution(turns: DataFrame) -> DataFrame:
    d = structure.depths(turns)
    return xy(d, "source", "depth", F.coalesce(F.try_divide(F.col("n") * 100, F.sum("n").over(Window.partitionBy("source"))), F.lit(0.0)))


def user_vectors(turns: DataFrame) -> DataFrame:
    """Filtered user turns with their vectors; such that have one keep it."""
    own = said_by(turns, "user")
    return own if "vector" in own.columns else semantic.encode(own)


@chart
def rephrasing_rate(turns: DataFrame) -> DataFrame:
    """Rephrasings per 100 user turns, and percent of conversations with one."""
    r = structure.rephrase_report(turns, user_vectors(turns))
    return wide(r.withColumn("conversations_pct", F.col("conversations") * 100 / F.greatest("n_conversations", F.lit(1))), ["per_100_turns", "conversations_pct"])


@chart
def resolution_patterns(turns: DataFrame) -> DataFrame:
    return xy(structure.resolution(turns), "source", "kind", "share")


@chart
def verbosity_trajectory(turns: DataFrame) -> DataFrame:
    """Histogram of 30 bins of the conversations' correlations, for either role."""
    r = structure.pearson_trajectories(turns).where("r is not null")
    return binned(r.select(F.concat_ws(" ", "source", "role").alias("source"), F.round("r", 6).alias("r")), "r", 30)


@chart
def prompt_engineering_patterns(turns: DataFrame) -> DataFrame:
    return xy(pragmatic.categories(turns, "user", user.PROMPTING), "source", "category", "per_1k")


@chart
def user_formality(turns: DataFrame) -> DataFrame:
    polite = pragmatic.phrases(turns, "user", {"politeness": L.POLITENESS_WORDS}).groupBy("source").agg(F.sum("per_1k").alias("politeness"))
    c = user.casual(turns).select("source", F.col("contractions_per_1k").alias("contractions"), (F.col("lowercase_only") * 100 / F.greatest("turns", F.lit(1))).alias("lowercase_pct"), (F.col("no_punctuation") * 100 / F.greatest("turns", F.lit(1))).alias("no_punctuation_pct"))
    return wide(polite.join(c, "source").join(user.capitals(turns).select("source", "rate"), "source"), ["politeness", "contractions", "lowercase_pct", "no_punctuation_pct", "rate"])


@chart
def user_rephrasing_rate(turns: DataFrame) -> DataFrame:
    return wide(user.rephrase_rates(turns, user_vectors(turns)), ["strict_per_100", "loose_per_100"])


def response_density(turns: DataFrame) -> DataFrame:
    """The curve over ``response_length_distributions``: kernel density at 300 points."""
    w = said_by(turns, "assistant").select("source", T.word_count(F.col("content")).alias("w"))
    return xy(S.density(w.join(F.broadcast(w.agg(F.percentile("w", 0.95).alias("most"))), F.lit(True)).where("w <= most"), ["source"], "w"), "source", F.round("x", 4).cast("decimal(18,4)"), F.col("y") * 1000)
