"""Populations of the turn table that analyses draw on.

turns: source, conv_id, turn_idx (0-based), role (user or assistant), content,
created_at, ts. Filtered turns have ``MIN_CHARS`` characters or more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnwise.functions import text as T

MIN_CHARS = 10
CONV = ["source", "conv_id"]


def said_by(turns: DataFrame, role: str, min_chars: int = MIN_CHARS) -> DataFrame:
    return turns.where((F.col("role") == role) & (F.length("content") >= min_chars))


def next_turn(turns: DataFrame) -> DataFrame:
    """Each turn beside the next one of its conversation: role2, content2."""
    w = Window.partitionBy(*CONV).orderBy("turn_idx")
    return turns.withColumns({"role2": F.lead("role").over(w), "content2": F.lead("content").over(w)})


def answered(turns: DataFrame) -> DataFrame:
    """User turns directly followed by an assistant turn."""
    return next_turn(turns).where("role = 'user' and role2 = 'assistant'")


def starts(totals: DataFrame, by: list[str], key: str, n: str, most: int = 1_000_000) -> DataFrame:
    """(by..., key, before): sums of ``n`` over the smaller keys of each group. totals: a row for each key.

    Up to ``most`` keys a group is summed in one window. Beyond that keys fall into ranges
    whose bounds are a sample of some 300 keys, and only the sums of ranges meet.
    """
    keys = totals.count()
    own = Window.partitionBy(*by).orderBy(key)
    if keys <= most:
        return totals.select(*by, key, (F.sum(n).over(own) - F.col(n)).alias("before"))
    share = max(1, keys // 300)
    bounds = totals.where(F.pmod(F.xxhash64(key), F.lit(share)) == 0).agg(F.array_sort(F.collect_set(key)).alias("b")).first()["b"]
    ranged = totals.withColumn("range", F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(key))))
    sums = ranged.groupBy(*by, "range").agg(F.sum(n).alias("sum"))
    earlier = sums.select(*by, "range", (F.sum("sum").over(Window.partitionBy(*by).orderBy("range")) - F.col("sum")).alias("earlier"))
    within = F.sum(n).over(Window.partitionBy(*by, "range").orderBy(key)) - F.col(n)
    return ranged.withColumn("within", within).join(F.broadcast(earlier), [*by, "range"]).select(*by, key, (F.col("within") + F.col("earlier")).alias("before"))  # some 300 ranges a group


def positioned(turns: DataFrame, tokens, by: list[str], most: int = 1_000_000) -> DataFrame:
    """(by..., pos, token): tokens of all turns by conversation and turn, numbered from 0 in each group.

    Tokens are ordered within their conversation only; of conversations just the numbers of tokens are summed up.
    """
    rows = turns.select(*by, "conv_id", "turn_idx", tokens.alias("tokens"))
    first = starts(rows.groupBy(*by, "conv_id").agg(F.sum(F.size("tokens")).alias("n")), by, "conv_id", "n", most)
    within = F.sum(F.size("tokens")).over(Window.partitionBy(*by, "conv_id").orderBy("turn_idx")) - F.size("tokens")
    placed = rows.withColumn("within", within).join(first, [*by, "conv_id"])
    return placed.select(*by, (F.col("before") + F.col("within")).alias("at"), F.posexplode("tokens").alias("i", "token")).select(*by, (F.col("at") + F.col("i")).alias("pos"), "token")


def phrase_counts(turns: DataFrame, lists: dict[str, list[str]], plain: bool = False) -> DataFrame:
    """(source, words, category, phrase, n): words and occurrences in lower-cased turns, all in one aggregate."""
    rows = turns.select("source", "content", F.lower("content").alias("lower"))
    flat = [(c, p) for c, ps in lists.items() for p in ps]
    counted = rows.groupBy("source").agg(F.sum(T.word_count(F.col("content"))).alias("words"), *(F.sum((T.count_text if plain else T.count_phrase)(F.col("lower"), p)).alias(f"p{i}") for i, (_, p) in enumerate(flat)))
    each = F.array(*(F.struct(F.lit(c).alias("category"), F.lit(p).alias("phrase"), F.coalesce(f"p{i}", F.lit(0)).cast("long").alias("n")) for i, (c, p) in enumerate(flat)))
    return counted.select("source", "words", F.explode(each).alias("r")).select("source", "words", "r.*")
