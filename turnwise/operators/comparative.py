"""Sources side by side: style fingerprint, summary table, topic-controlled metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.functions import text as T
from turnwise.operators import lexical, pragmatic, semantic
from turnwise.operators.features import hedges, profile, turn_features
from turnwise.operators.stats import per_1k, self_similarity, upper_median
from turnwise.operators.turns import answered, said_by

FINGERPRINT = ["mattr", "response_words", "formatting", "hedge_density", "questions", "fk", "verbosity", "first_person_i", "self_similarity"]
#: The table's rows: metric, name, and what the source with the most (or least) is noted for.
ROWS = [
    ("mattr", "Vocabulary (MATTR-500)", "most", "Richer vocabulary"),
    ("types", "Unique word types", None, None),
    ("response_words", "Mean response length (words)", "least", "More concise"),
    ("response_median", "Median response length (words)", None, None),
    ("sentence_words", "Mean sentence length (words)", None, None),
    ("fk", "Flesch-Kincaid grade", "fk", "More readable"),
    ("fog", "Gunning Fog index", None, None),
    ("formatting", "Formatting density (per 1k)", "most", "Heavy formatter"),
    ("bold", "Bold usage (per 1k)", None, None),
    ("code_blocks", "Code blocks (per 1k)", None, None),
    ("hedge_density", "Hedge density (per 1k)", "most", "Hedges more"),
    ("uncertainty", "Uncertainty hedges (per 1k)", "most", "More personally uncertain"),
    ("questions", "Questions per turn", "most", "More interactive"),
    ("question_share", "% turns with question", None, None),
    ("disclaimers", "Disclaimer density (per 1k)", None, None),
    ("verbosity", "Verbosity ratio (median)", "least", "More proportional"),
    ("verbosity_mean", "Verbosity ratio (mean)", None, None),
    ("first_person_i", "First-person 'I' (per 1k)", "most", "More personal"),
    ("you", "'you' usage (per 1k)", None, None),
    ("turns_median", "Turns per conv (median)", None, None),
    ("single_share", "Single-exchange fraction", None, None),
    ("self_similarity", "Self-similarity (cosine)", "least", "More varied responses"),
    ("sentiment", "Mean sentiment polarity", None, None),
]
CONTROLLED = {"response_length": "[Topic-ctrl] Response length", "hedge_density": "[Topic-ctrl] Hedge density", "verbosity_median": "[Topic-ctrl] Verbosity median"}


def scaled(value: Column, by: list[str]) -> Column:
    """Min-max over a window; 0.5 where all are the same."""
    w = Window.partitionBy(*by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.coalesce(F.try_divide(value - low, high - low), F.lit(0.5))


def metrics(turns: DataFrame, encode=semantic.encode) -> DataFrame:
    """One row a source, one column a metric; what a source lacks counts as 0.

    Four scans: the profile's, the vocabulary's, the vectors' and the sentiment's.
    ``encode`` adds the column ``vector``.
    """
    words = lexical.vocabulary(turns).select("source", "mattr", F.col("types").cast("double").alias("types"))
    alike = self_similarity(encode(said_by(turns, "assistant")), ["source"], "vector").select("source", F.col("mean").alias("self_similarity"))
    mood = semantic.sentiment_by_source(turns).select("source", F.col("mean").alias("sentiment"))
    out = profile(turn_features(turns))
    for part in (words, alike, mood):  # a row a source each
        out = out.join(F.broadcast(part), "source", "left")
    return out.na.fill(0.0)


def fingerprint(turns: DataFrame, encode=semantic.encode) -> DataFrame:
    """source, metric, raw, scaled."""
    long = metrics(turns, encode).select("source", *FINGERPRINT).unpivot(["source"], FINGERPRINT, "metric", "raw")
    return long.select("source", "metric", "raw", F.round(scaled(F.col("raw"), ["metric"]), 4).alias("scaled"))


def summary(turns: DataFrame, encode=semantic.encode, controlled: DataFrame | None = None) -> DataFrame:
    """nth, metric, source, value, delta (first source less second, if there are just two), note: the table in long form.

    ``controlled`` (source, metric, value; see ``topic_controlled``) adds its rows.
    """
    names = [k for k, *_ in ROWS]
    long = metrics(turns, encode).select("source", *(F.col(k).cast("double").alias(k) for k in names)).unpivot(["source"], names, "key", "value")
    about = F.array(*(F.struct(F.lit(i).alias("nth"), F.lit(k).alias("key"), F.lit(name).alias("metric"), F.lit(side).cast("string").alias("side"), F.lit(says).cast("string").alias("says")) for i, (k, name, side, says) in enumerate(ROWS)))
    table = turns.sparkSession.range(1).select(F.explode(about).alias("a")).select("a.*")
    rows = long.join(F.broadcast(table), "key").drop("key")
    if controlled is not None:
        nth, name = F.lit(None), F.lit(None)
        for i, (k, title) in enumerate(CONTROLLED.items()):
            nth, name = F.when(F.col("metric") == k, len(ROWS) + i).otherwise(nth), F.when(F.col("metric") == k, title).otherwise(name)
        none = F.lit(None).cast("string")
        rows = rows.unionByName(controlled.select("source", "value", nth.cast("int").alias("nth"), name.alias("metric"), none.alias("side"), none.alias("says")).where("nth is not null"))
    all_ = Window.partitionBy("nth", "metric")
    first, second = (F.min_by("value", "source").over(all_), F.max_by("value", "source").over(all_))
    delta = F.when(F.count("*").over(all_) == 2, F.round(first - second, 4))
    most, least = F.max_by("source", F.struct("value", "source")).over(all_), F.min_by("source", F.struct("value", "source")).over(all_)
    # of the readability two sources are compared by name, as the table's own rule has it
    near = (F.count("*").over(all_) >= 2) & (F.abs(first - F.element_at(F.sort_array(F.collect_list(F.struct("source", "value")).over(all_)), F.least(F.lit(2), F.count("*").over(all_)).cast("int"))["value"]) < 1)
    who = F.when(F.col("side") == "most", most).when(F.col("side").isin("least", "fk"), least)
    note = F.when((F.col("side") == "fk") & near, "Similar").otherwise(F.coalesce(F.concat(F.initcap(who), F.lit(": "), F.col("says")), F.lit("")))
    return rows.select("nth", "metric", "source", "value", delta.alias("delta"), note.alias("note"))


def about_topic(turns: DataFrame, topic: int, words: list[str], most: int = 500) -> tuple[DataFrame, DataFrame]:
    """Assistant turns and user-assistant pairs of a topic.

    Topic 0 is a catch-all: as many turns of each source, at most ``most``, those with the
    smallest hash of their key. Any other: turns that hold one of its first five words of
    over two letters.
    """
    bot = said_by(turns, "assistant")
    pairs = answered(turns).where((F.length("content2") >= 10) & (T.word_count(F.col("content")) >= 5))
    if topic == 0:
        least = bot.groupBy("source").count().agg(F.min("count")).first()[0] or 0
        n = min(most, least)
        return tuple(semantic.balanced_sample(x, "source", ["conv_id", "turn_idx"], n) for x in (bot, pairs))
    named = [w.lower() for w in words[:5] if len(w) > 2]
    holds = lambda c: sum((F.lower(c).contains(w).cast("int") for w in named), F.lit(0)) > 0
    return bot.where(holds("content")), pairs.where(holds("content2"))


def topic_controlled(turns: DataFrame, topic: int, words: list[str], encode=semantic.encode, most: int = 500) -> DataFrame:
    """source, metric, value over the turns of one topic: response_length, hedge_density, verbosity_mean, verbosity_median, self_similarity, n_turns.

    The median is the upper one, without averaging; under ten turns the similarity is 0.
    """
    bot, pairs = about_topic(turns, topic, words, most)
    w = T.word_count(F.col("content"))
    of_turns = bot.groupBy("source").agg(F.count("*").cast("double").alias("n_turns"), F.round(F.avg(w), 2).alias("response_length"), F.round(per_1k(F.sum(hedges(F.lower("content"))), F.sum(w)), 3).alias("hedge_density"))
    ratios = pairs.select("source", (T.word_count(F.col("content2")) / w).alias("ratio")).groupBy("source").agg(F.round(F.avg("ratio"), 2).alias("verbosity_mean"), F.round(upper_median("ratio"), 2).alias("verbosity_median"))
    alike = self_similarity(encode(bot), ["source"], "vector").select("source", F.when(F.col("n") >= 10, F.col("mean")).otherwise(0.0).alias("self_similarity"))
    wide = turns.select("source").distinct().join(F.broadcast(of_turns), "source", "left").join(F.broadcast(ratios), "source", "left").join(F.broadcast(alike), "source", "left").na.fill(0.0)
    return wide.unpivot(["source"], ["n_turns", "response_length", "hedge_density", "verbosity_mean", "verbosity_median", "self_similarity"], "metric", "value")


def verbosity_points(turns: DataFrame) -> DataFrame:
    """Ratios up to the 95th percentile of all, for a histogram."""
    ratios = pragmatic.verbosity(turns)
    return ratios.join(F.broadcast(ratios.agg(F.percentile("ratio", 0.95).alias("most"))), F.lit(True)).where("ratio <= most").select("source", "ratio")
