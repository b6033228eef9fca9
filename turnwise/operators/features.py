"""Per-turn numbers that many metrics share, and the profile of a source from one scan of its texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.functions import lexicons as L
from turnwise.functions import text as T
from turnwise.operators.stats import per_1k
from turnwise.operators.turns import CONV, MIN_CHARS


def hedges(lower: Column, category: str | None = None) -> Column:
    lists = L.HEDGES.values() if category is None else [L.HEDGES[category]]
    return sum((T.count_phrase(lower, p) for ps in lists for p in ps), F.lit(0))


def turn_features(turns: DataFrame) -> DataFrame:
    """Numbers of every turn, without its text: one pass over the texts, no shuffle."""
    rows = turns.select(*CONV, "turn_idx", "role", "content", F.lower("content").alias("lower"))
    t, lower = F.col("content"), F.col("lower")
    marks = {f"f_{k}": F.regexp_count(t, F.lit(p)).cast("long") for k, p in L.FORMATS.items()}
    only = lambda c: F.when((F.col("role") == "assistant") & (F.length(t) >= MIN_CHARS), c)
    w = T.word_count(t)
    return rows.select(
        *CONV, "turn_idx", "role", F.length(t).alias("chars"), w.alias("words"),
        only(F.size(T.sentences(t))).cast("long").alias("sentences"),
        only(F.when(w >= 5, T.flesch_kincaid(t))).alias("fk"), only(F.when(w >= 5, T.gunning_fog(t))).alias("fog"),
        only(T.count_text(t, "?")).alias("questions"), only(hedges(lower)).cast("long").alias("hedges"), only(hedges(lower, "uncertainty")).cast("long").alias("uncertain"),
        only(sum((T.count_phrase(lower, p) for ps in L.DISCLAIMERS.values() for p in ps), F.lit(0))).cast("long").alias("disclaimers"),
        only(F.regexp_count(t, F.lit(r"(?U)\bI\b"))).cast("long").alias("i"), only(F.regexp_count(t, F.lit(r"(?iU)\byou\b"))).cast("long").alias("you"),
        *(only(c).alias(k) for k, c in marks.items()),
    )


def profile(features: DataFrame) -> DataFrame:
    """One row a source, one column a metric: one shuffle of numbers by conversation, one aggregate by source.

    A metric without any turn to measure is 0.
    """
    w = Window.partitionBy(*CONV).orderBy("turn_idx")
    whole = Window.partitionBy(*CONV)
    rows = features.withColumns({"role2": F.lead("role").over(w), "words2": F.lead("words").over(w), "chars2": F.lead("chars").over(w), "in_conv": F.count("*").over(whole), "users": F.count_if(F.col("role") == "user").over(whole), "nth": F.row_number().over(w)})
    bot, last = F.col("sentences").isNotNull(), F.col("nth") == 1
    pair = (F.col("role") == "user") & (F.col("role2") == "assistant") & (F.col("words") >= 5) & (F.col("chars2") >= MIN_CHARS)
    ratio = F.when(pair, F.col("words2") / F.col("words"))
    n, per_conv = F.when(bot, F.col("words")), F.when(last, F.col("in_conv"))
    total = F.sum(n)
    rate = lambda *cs: per_1k(sum((F.coalesce(F.sum(c), F.lit(0)) for c in cs), F.lit(0)), total)
    fences = F.floor(F.sum("f_code_blocks") / 2)
    r4 = lambda c: F.coalesce(F.round(c, 4), F.lit(0.0))
    plain = [f"f_{k}" for k in L.FORMATS if k != "code_blocks"]
    return rows.groupBy("source").agg(
        F.count(n).alias("assistant_turns"), F.coalesce(total, F.lit(0)).alias("assistant_words"), F.count_if(last).alias("conversations"),
        r4(F.avg(n)).alias("response_words"), r4(F.percentile(n, 0.5)).alias("response_median"),
        r4(F.try_divide(total, F.sum("sentences"))).alias("sentence_words"), r4(F.avg("fk")).alias("fk"), r4(F.avg("fog")).alias("fog"),
        F.round(per_1k(fences, total) + sum((rate(c) for c in plain), F.lit(0.0)), 4).alias("formatting"), rate("f_bold").alias("bold"), per_1k(fences, total).alias("code_blocks"),
        rate("hedges").alias("hedge_density"), rate("uncertain").alias("uncertainty"), r4(F.avg("questions")).alias("questions"), F.round(r4(F.avg(F.when(bot, (F.col("questions") > 0).cast("int")))) * 100, 1).alias("question_share"),
        rate("disclaimers").alias("disclaimers"), r4(F.percentile(ratio, 0.5)).alias("verbosity"), r4(F.avg(ratio)).alias("verbosity_mean"), rate("i").alias("first_person_i"), rate("you").alias("you"),
        r4(F.percentile(per_conv, 0.5)).alias("turns_median"), r4(F.count_if(last & (F.col("users") == 1)) / F.greatest(F.count_if(last), F.lit(1))).alias("single_share"),
    )
