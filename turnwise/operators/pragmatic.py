"""Hedging, disclaimers, questions, verbosity, first person, dynamics, openings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnwise.functions import lexicons as L
from turnwise.functions import text as T
from turnwise.operators.stats import describe, per_1k, top_k
from turnwise.operators.turns import CONV, answered, phrase_counts, said_by


def phrases(turns: DataFrame, role: str, lists: dict[str, list[str]], plain: bool = False) -> DataFrame:
    """source, category, phrase, n, per_1k."""
    return phrase_counts(said_by(turns, role), lists, plain).select("source", "category", "phrase", "n", per_1k(F.col("n"), F.col("words")).alias("per_1k"))


def categories(turns: DataFrame, role: str, lists: dict[str, list[str]]) -> DataFrame:
    """source, category, n, per_1k, density (all categories per 1k words of the source)."""
    n = phrase_counts(said_by(turns, role), lists).groupBy("source", "category").agg(F.sum("n").alias("n"), F.first("words").alias("words"))
    total = F.sum("n").over(Window.partitionBy("source"))  # a few rows a source
    return n.select("source", "category", "n", per_1k(F.col("n"), F.col("words")).alias("per_1k"), per_1k(total, F.col("words")).alias("density"))


def question_rate(turns: DataFrame, role: str = "assistant") -> DataFrame:
    q = T.count_text(F.col("content"), "?")
    rows = said_by(turns, role).select("source", q.alias("q"), T.word_count(F.col("content")).alias("w"))
    return rows.groupBy("source").agg(F.round(F.avg("q"), 4).alias("mean_per_turn"), F.round(F.avg((F.col("q") > 0).cast("int")), 4).alias("share_of_turns"), F.sum("q").alias("total"), per_1k(F.sum("q"), F.sum("w")).alias("per_1k"))


def verbosity(turns: DataFrame, min_user_words: int = 5, min_chars: int = 10) -> DataFrame:
    """Assistant words per user word over adjacent pairs."""
    pairs = answered(turns).where((T.word_count(F.col("content")) >= min_user_words) & (F.length("content2") >= min_chars))
    return pairs.select("source", (T.word_count(F.col("content2")) / T.word_count(F.col("content"))).alias("ratio"))


def first_person(turns: DataFrame) -> DataFrame:
    t = F.col("content")
    rows = said_by(turns, "assistant").groupBy("source").agg(
        F.sum(F.regexp_count(t, F.lit(r"(?U)\bI\b"))).alias("i"), F.sum(F.regexp_count(t, F.lit(r"(?iU)\bwe\b"))).alias("we"), F.sum(F.regexp_count(t, F.lit(r"(?iU)\byou\b"))).alias("you"), F.sum(T.word_count(t)).alias("w")
    )
    return rows.select("source", "i", "we", "you", *(per_1k(F.col(c), F.col("w")).alias(f"{c}_per_1k") for c in ("i", "we", "you")))


def dynamics(turns: DataFrame) -> DataFrame:
    """Turns and user turns a conversation, conversations of one exchange. All turns count."""
    convs = turns.groupBy(*CONV).agg(F.count("*").alias("t"), F.count_if(F.col("role") == "user").alias("u"))
    return convs.groupBy("source").agg(*describe("t", "turns"), *describe("u", "user"), F.count_if(F.col("u") == 1).alias("single"), F.round(F.count_if(F.col("u") == 1) / F.count("*"), 4).alias("single_share"))


def openings(turns: DataFrame, role: str = "assistant", n_words: int = 1, k: int = 15, chars: str = T.DECORATION, lower: bool = False) -> DataFrame:
    """Top first words (or pairs) without decoration; of equal counts the first seen."""
    parts = [T.opener(F.col("content"), i, chars) for i in range(n_words)]
    item = F.concat_ws(" ", *parts)
    item = F.when(F.size(F.filter(F.array(*parts), lambda p: p.isNull())) == 0, F.lower(item) if lower else item)
    rows = said_by(turns, role).select("source", "conv_id", "turn_idx", item.alias("opening"))
    return top_k(rows, ["source"], "opening", [F.col("conv_id"), F.col("turn_idx")], k)


def tracked_openings(turns: DataFrame) -> DataFrame:
    own = said_by(turns, "assistant").select("source", T.opener(F.col("content"), 0).alias("w"))
    wide = own.groupBy("source").agg(F.count("*").alias("turns"), *(F.count_if(F.col("w") == w).alias(f"w{i}") for i, w in enumerate(L.TRACKED_OPENERS)))
    rows = F.array(*(F.struct(F.lit(w).alias("word"), F.col(f"w{i}").alias("n")) for i, w in enumerate(L.TRACKED_OPENERS)))
    return wide.select("source", "turns", F.explode(rows).alias("r")).select("source", "r.word", "r.n", F.round(F.col("r.n") / F.greatest("turns", F.lit(1)), 4).alias("rate"))
