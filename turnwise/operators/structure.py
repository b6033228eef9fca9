"""Shape, depth, resolution, trajectories, rephrasing, clustering of conversations."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.functions import lexicons as L
from turnwise.functions import text as T
from turnwise.operators.stats import describe, pearson, rounded, spearman
from turnwise.operators.turns import CONV, MIN_CHARS, next_turn

DEPTHS = [("quick_exchange", 2), ("short", 6), ("medium", 20), ("deep", 50), ("marathon", None)]
#: What conversations are clustered by.
FEATURES = ["turn_pairs", "duration_min", "verbosity_trajectory", "user_effort_trajectory", "mean_asst_length"]
#: The least silhouette, over squared distances as all pairs of plain ones don't scale: plain, 0.15 is an inner distance of 0.85 of the outer one.
GATE = 1 - 0.85**2


def shapes(turns: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row a conversation. User words count all turns, assistant words the filtered ones."""
    w, bot = T.word_count(F.col("content")), (F.col("role") == "assistant") & (F.length("content") >= min_chars)
    minutes = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 6e7
    return turns.groupBy(*CONV).agg(
        F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("user_turns"), F.count_if(F.col("role") == "assistant").alias("assistant_turns"),
        F.coalesce(F.sum(F.when(F.col("role") == "user", w)), F.lit(0)).alias("user_words"), F.coalesce(F.sum(F.when(bot, w)), F.lit(0)).alias("assistant_words"),
        F.avg(F.when(bot, w)).alias("mean_response"), F.when(F.count("ts") >= 2, minutes).alias("minutes"),
    )


def shape_metrics(turns: DataFrame) -> DataFrame:
    """Descriptors by source: turns, user and assistant turns and words, mean response, minutes, both trajectories."""
    rows = shapes(turns)
    for role, name in (("assistant", "verbosity_trajectory"), ("user", "effort_trajectory")):
        rows = rows.join(trajectories(turns, role).withColumnRenamed("rho", name), CONV, "left")
    names = ["turns", "user_turns", "assistant_turns", "user_words", "assistant_words", "mean_response", "minutes", "verbosity_trajectory", "effort_trajectory"]
    return rows.groupBy("source").agg(*(c for n in names for c in describe(n, n)))


def pearson_trajectories(turns: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """source, conv_id, role, r: of a turn's number among those of its role with its words, for three turns or more."""
    rows = turns.where(F.length("content") >= min_chars).select(*CONV, "role", "turn_idx", T.word_count(F.col("content")).alias("y"))
    nth = rows.withColumn("x", F.row_number().over(Window.partitionBy(*CONV, "role").orderBy("turn_idx")) - 1)
    return pearson(nth, [*CONV, "role"], "x", "y")


def trajectories(turns: DataFrame, role: str = "assistant", min_chars: int = MIN_CHARS) -> DataFrame:
    """Rank correlation of a turn's place with its length, by conversation."""
    rows = turns.where((F.col("role") == role) & (F.length("content") >= min_chars)).select(*CONV, F.col("turn_idx").cast("double").alias("x"), T.word_count(F.col("content")).alias("y"))
    return spearman(rows, CONV, "x", "y")


def exchanges(turns: DataFrame) -> DataFrame:
    """User-assistant adjacencies of each conversation; without any, half its turns, one at least."""
    pair = (F.col("role") == "user") & (F.col("role2") == "assistant")
    return next_turn(turns).groupBy(*CONV).agg(F.count_if(pair).alias("p"), F.count("*").alias("t")).select(*CONV, F.when(F.col("p") > 0, F.col("p")).otherwise(F.greatest(F.lit(1), F.floor(F.col("t") / 2))).cast("long").alias("pairs"))


def depth_of(pairs: Column) -> Column:
    out = None
    for name, most in DEPTHS:
        if most is None:
            return out.otherwise(name)
        out = (F if out is None else out).when(pairs <= most, name)
    return out


def depths(turns: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Conversations of each depth, and the mean of their mean response length."""
    mean = turns.where((F.col("role") == "assistant") & (F.length("content") >= min_chars)).groupBy(*CONV).agg(F.avg(T.word_count(F.col("content"))).alias("m"))
    rows = exchanges(turns).withColumn("depth", depth_of(F.col("pairs"))).join(mean, CONV, "left")
    every = rows.select("source").distinct().select("source", F.explode(F.array(*(F.lit(d) for d, _ in DEPTHS))).alias("depth"))
    return every.join(rows.groupBy("source", "depth").agg(F.count("*").alias("n"), F.avg("m").alias("m")), ["source", "depth"], "left").select("source", "depth", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("m", F.lit(0.0)), 4).alias("mean_response"))


def resolution(turns: DataFrame) -> DataFrame:
    """How the last user turn closes; corrections go before thanks, questions and short ones."""
    last = turns.groupBy(*CONV).agg(F.max_by(F.when(F.col("role") == "user", F.col("content")), F.when(F.col("role") == "user", F.col("turn_idx"))).alias("last"))
    t = F.lower("last")
    has = lambda ps: sum(((F.instr(t, p) > 0).cast("int") for p in ps), F.lit(0)) > 0
    kind = F.when(F.col("last").isNull(), "no_user_turns").when(has(L.CORRECTIONS), "correction").when(has(L.THANKS), "thank_you").when(T.strip(F.col("last")).endswith("?"), "question").when(T.word_count(F.col("last")) < 5, "short_close").otherwise("other")
    n = last.withColumn("kind", kind).groupBy("source", "kind").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("source")), 4))


def rephrasings(vectors: DataFrame, key: list[str], order: str, gap: int = 2, at_least: float = 0.6) -> DataFrame:
    """Adjacent vectors of a key, ``gap`` or more apart in order, as similar as that or more.

    Other columns are the later row's; ``at`` is the earlier one's place, ``content_before`` its text where there is one.
    """
    w = Window.partitionBy(*key).orderBy(order)
    before = {"before": F.lag("vector").over(w), "at": F.lag(order).over(w)} | ({"content_before": F.lag("content").over(w)} if "content" in vectors.columns else {})
    pairs = vectors.withColumns(before).where((F.col("before").isNotNull()) & (F.col(order) - F.col("at") >= gap))
    return pairs.withColumn("similarity", T.cosine(F.col("before"), F.col("vector"))).where(F.col("similarity") >= at_least).drop("before", "vector")


def rephrase_report(turns: DataFrame, vectors: DataFrame, at_least: float = 0.6) -> DataFrame:
    """source, total, per_100_turns, conversations, per_conversation, n_user_turns, n_conversations.

    vectors: the eligible user turns with ``vector``; turns: all turns, for the number of conversations.
    """
    found = rephrasings(vectors, CONV, "turn_idx", 2, at_least).groupBy("source").agg(F.count("*").alias("total"), F.count_distinct("conv_id").alias("conversations"))
    users = vectors.groupBy("source").agg(F.count("*").alias("n_user_turns"))
    convs = turns.groupBy("source").agg(F.count_distinct("conv_id").alias("n_conversations"))
    rows = users.join(convs, "source").join(found, "source", "left").na.fill(0, ["total", "conversations"])
    return rows.select("source", "total", rounded(F.col("total") * 100 / F.greatest("n_user_turns", F.lit(1)), 2).alias("per_100_turns"), "conversations", rounded(F.col("total") / F.greatest("n_conversations", F.lit(1)), 3).alias("per_conversation"), "n_user_turns", "n_conversations")


def rephrase_examples(vectors: DataFrame, k: int = 5, shown: int = 200, at_least: float = 0.6) -> DataFrame:
    """source, rank, conv_id, turn_idx, before, after, similarity: the clearest of each source, texts cut for display."""
    found = rephrasings(vectors, CONV, "turn_idx", 2, at_least)
    order = Window.partitionBy("source").orderBy(F.desc(F.round("similarity", 4)), "conv_id", "turn_idx")
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.select("source", "rank", "conv_id", "turn_idx", F.substring("content_before", 1, shown).alias("before"), F.substring("content", 1, shown).alias("after"), F.round("similarity", 4).alias("similarity"))


def cluster_features(turns: DataFrame) -> DataFrame:
    """The five features of each conversation; a trajectory of fewer than three turns and a missing duration count as 0."""
    rows = shapes(turns).select(*CONV, F.col("minutes").alias("duration_min"), F.col("mean_response").alias("mean_asst_length"))
    rows = rows.join(exchanges(turns).select(*CONV, F.col("pairs").cast("double").alias("turn_pairs")), CONV)
    for role, name in (("assistant", "verbosity_trajectory"), ("user", "user_effort_trajectory")):
        rows = rows.join(trajectories(turns, role).withColumnRenamed("rho", name), CONV, "left")
    return rows.select(*CONV, *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in FEATURES))


def cluster_label(pairs: float, duration: float, verbosity: float, effort: float, length: float) -> str:
    """A name for a cluster from its centroid, in the order of ``FEATURES``."""
    depth = "Quick" if pairs <= 2 else "Short" if pairs <= 6 else "Medium" if pairs <= 20 else "Deep"
    style = "verbose" if length > 500 else "concise" if length < 150 else "moderate"
    return f"{depth} {style} ({'escalating' if verbosity > 0.2 else 'tapering' if verbosity < -0.2 else 'steady'})"


def clusters(turns: DataFrame, ks: tuple[int, ...] = (4, 5, 6), seeds: int = 10) -> DataFrame:
    """k-means of five standardised features; of each k the closest of ten starts, of those the k of the best silhouette. Under ten conversations: none."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    rows = cluster_features(turns).persist()  # every start reads it
    s = rows.agg(F.count("*").alias("n"), *(f(c).alias(f"{c}_{k}") for c in FEATURES for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    if s["n"] < 10:
        return rows.select(*CONV, F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("string").alias("label"), F.lit("skipped").alias("status")).limit(0)
    parts = max(1, s["n"] // 50_000)  # a row is five numbers: few tasks for few conversations
    scaled = rows.coalesce(parts).select(*CONV, array_to_vector(F.array(*((F.col(c) - s[f"{c}_m"]) / (s[f"{c}_s"] or 1.0) for c in FEATURES))).alias("features")).persist()
    found = []
    for k in ks:
        with ThreadPoolExecutor(8) as pool:  # starts are small jobs: they run side by side
            starts = list(pool.map(lambda seed, k=k: KMeans(k=k, seed=seed, maxIter=300, initMode="random").fit(scaled), range(42, 42 + seeds)))
        model = min(starts, key=lambda m: m.summary.trainingCost)
        if sum(n > 0 for n in model.summary.clusterSizes) > 1:
            out = model.transform(scaled)
            found.append((ClusteringEvaluator(distanceMeasure="squaredEuclidean").evaluate(out), -k, model, out))
    if not found:
        return rows.select(*CONV, F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("string").alias("label"), F.lit("low_quality").alias("status"))
    score, _, model, best = max(found, key=lambda x: x[:2])
    names = [cluster_label(*(round(float(x) * (s[f"{c}_s"] or 1.0) + s[f"{c}_m"], 2) for x, c in zip(at, FEATURES, strict=True))) for at in model.clusterCenters()]
    label = F.element_at(F.array(*map(F.lit, names)), F.col("prediction") + 1)
    return best.select(*CONV, F.col("prediction").alias("cluster"), label.alias("label"), F.lit("low_quality" if score < GATE else "ok").alias("status"))
