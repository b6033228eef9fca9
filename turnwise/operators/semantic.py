"""Sentiment, topics over given vectors, and the offline encoder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from turnwise.functions import lexicons as L
from turnwise.functions import text as T
from turnwise.operators.turns import said_by


def sentiment(turns: DataFrame, role: str = "assistant", positive: list[str] | None = None, negative: list[str] | None = None, negators: list[str] | None = None) -> DataFrame:
    """source, conv_id, turn_idx, score: mean of +1 and -1 words, times -0.5 after a negator up to three words before.

    Higher-order functions over one text at a time: no shuffle.
    """
    pos, neg, nots = (F.array(*map(F.lit, x)) for x in (positive or L.POSITIVE, negative or L.NEGATIVE, negators or L.NEGATORS))
    w = T.words(F.lower("content"))
    marks = F.transform(w, lambda x: F.struct(T.stripped_of(x, ".,!?;:\"'()-[]{}#").alias("hit"), F.array_contains(nots, T.stripped_of(x, ".,!?;:'\"")).alias("no")))

    def values(ms):
        def at(x, i):
            turned = F.exists(F.slice(ms, F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3))), lambda m: m["no"])
            v = F.when(F.array_contains(pos, x["hit"]), 1.0).when(F.array_contains(neg, x["hit"]), -1.0)
            return F.when(turned, v * -0.5).otherwise(v)

        return F.filter(F.transform(ms, at), lambda v: v.isNotNull())

    found = F.element_at(F.transform(F.array(marks), values), 1)
    total = F.aggregate(found, F.lit(0.0), lambda s, v: s + v)
    score = F.coalesce(F.try_divide(total, F.size(found)), F.lit(0.0))
    return said_by(turns, role).select("source", "conv_id", "turn_idx", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score)).alias("score"))


def sentiment_by_source(turns: DataFrame, role: str = "assistant", **lists: list[str]) -> DataFrame:
    s = F.col("score")
    return sentiment(turns, role, **lists).groupBy("source").agg(F.round(F.avg(s), 4).alias("mean"), *(F.round(F.avg(c.cast("int")), 4).alias(k) for k, c in (("positive", s > 0.1), ("negative", s < -0.1), ("neutral", s.between(-0.1, 0.1)))))


def topic_shares(labelled: DataFrame, k: int = 20) -> DataFrame:
    """topic, source, n, share of the topic; the ``k`` largest topics but the outlier -1."""
    n = labelled.where("topic <> -1").groupBy("topic", "source").agg(F.count("*").alias("n"))
    sized = n.withColumn("size", F.sum("n").over(Window.partitionBy("topic")))
    top = sized.select("topic", "size").distinct().orderBy(F.desc("size"), "topic").limit(k).select("topic")
    return sized.join(F.broadcast(top), "topic", "left_semi").select("topic", "source", "n", F.round(F.col("n") / F.col("size"), 4).alias("share"))


def shared_topic(labelled: DataFrame, least: float = 0.10) -> DataFrame:
    """The topic that all sources share most evenly: count times smallest over largest share."""
    sources = labelled.agg(F.count_distinct("source").alias("all"))
    n = labelled.where("topic <> -1").groupBy("topic", "source").agg(F.count("*").alias("n"))
    s = n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("topic"))).groupBy("topic").agg(F.sum("n").alias("n"), F.min("share").alias("low"), F.max("share").alias("high"), F.count("*").alias("k"))
    ok = s.join(F.broadcast(sources), F.lit(True)).where((F.col("k") == F.col("all")) & (F.col("low") >= least))
    return ok.select("topic", "n", F.round(F.col("n") * F.col("low") / F.col("high"), 4).alias("score")).orderBy(F.desc("score"), "topic").limit(1)


def balanced_sample(turns: DataFrame, by: str, key: list[str], n: int = 500, seed: int = 42) -> DataFrame:
    """``n`` rows of each group, the same ones at every run: those with the smallest hash of their key."""
    w = Window.partitionBy(by).orderBy(F.xxhash64(*key, F.lit(seed)), *key)
    return turns.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n).drop("nth")


def encode(turns: DataFrame, dim: int = 64, col: str = "content") -> DataFrame:
    """Adds ``vector``: hashed word counts with signs, an offline stand-in for a sentence encoder.

    Words are hashed by Spark; an Arrow batch's counts are one numpy call. Any function
    that adds ``vector`` can take its place.
    """

    def count(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            words = b.column("h")
            h = words.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(words)), pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))
            sign = 1.0 - 2.0 * ((h >> 32) % 2)
            v = np.bincount(row * dim + h % dim, weights=sign, minlength=len(words) * dim).astype(float)
            vector = pa.ListArray.from_arrays(pa.array(np.arange(0, len(v) + 1, dim, dtype=np.int32)), pa.array(v))
            yield pa.RecordBatch.from_arrays([b.column("row"), vector], names=["row", "vector"])

    row = F.struct(*(F.col(f"`{c}`") for c in turns.columns)).alias("row")
    hashed = turns.select(row, F.transform(T.alpha_tokens(F.col(col)), lambda w: F.xxhash64(w)).alias("h"))
    schema = StructType([hashed.schema["row"], StructField("vector", ArrayType(DoubleType()))])
    return hashed.mapInArrow(count, schema).select("row.*", "vector")


def stored_vectors(turns: DataFrame, path: str, encode=encode) -> DataFrame:
    """``turns`` with ``vector``, from a parquet table keyed by turn and hash of its text; what it lacks is encoded and added.

    A changed text has another hash, so a stale vector is never used.
    """
    spark = turns.sparkSession
    keyed = turns.withColumn("text_hash", F.sha2("content", 256))
    key = ["source", "conv_id", "turn_idx", "text_hash"]
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    known = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    new = keyed.join(spark.read.parquet(path).select(*key), key, "left_anti") if known else keyed
    encode(new).select(*key, "vector").write.mode("append").parquet(path)
    return keyed.join(spark.read.parquet(path).dropDuplicates(key), key).drop("text_hash")


def topics(turns: DataFrame, k: int = 10, min_words: int = 20, seed: int = 42, outlier: float = 0.95, encode=encode) -> DataFrame:
    """Adds ``topic``: k-means over encoded turns of ``min_words`` words or more.

    Turns further from their centre than all but a share ``outlier`` of the turns are
    outliers, topic -1 (approximate quantile). Topics are numbered by size, the largest 0.
    """
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.functions import array_to_vector

    rows = encode(turns.where(T.word_count(F.col("content")) >= min_words)).withColumn("features", array_to_vector("vector")).persist()
    if not rows.head(1):
        return rows.drop("features").withColumn("topic", F.lit(0))
    model = BisectingKMeans(k=k, seed=seed).fit(rows)
    centres = F.array(*(F.array(*(F.lit(float(x)) for x in c)) for c in model.clusterCenters()))  # k times the vector's length
    own = F.element_at(centres, F.col("prediction") + 1)
    far = F.aggregate(F.zip_with("vector", own, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    found = model.transform(rows).withColumn("far", far)
    edge = found.approxQuantile("far", [outlier], 0.001)[0]
    named = found.withColumn("topic", F.when(F.col("far") > edge, -1).otherwise(F.col("prediction")))
    sizes = {r["topic"]: r["count"] for r in named.where("topic >= 0").groupBy("topic").count().collect()}  # at most k rows
    number = F.lit(-1)
    for i, t in enumerate(sorted(sizes, key=lambda t: (-sizes[t], t))):
        number = F.when(F.col("topic") == t, i).otherwise(number)
    return named.withColumn("topic", number).drop("features", "prediction", "far")


def topic_words(labelled: DataFrame, tokens, k: int = 10) -> DataFrame:
    """topic, word, score, rank: class TF-IDF, the ``k`` best of each topic but the outlier -1.

    Of a word: its share of the topic's words, times log(1 + mean words a topic / its count in all topics).
    """
    tf = labelled.where("topic <> -1").select("topic", F.explode(tokens).alias("word")).groupBy("topic", "word").agg(F.count("*").alias("tf"))
    sizes = tf.groupBy("topic").agg(F.sum("tf").alias("size"))
    mean = sizes.agg(F.avg("size").alias("mean"))
    rows = tf.join(F.broadcast(sizes), "topic").join(F.broadcast(mean), F.lit(True)).join(tf.groupBy("word").agg(F.sum("tf").alias("all")), "word")  # sizes: a row a topic
    scored = rows.select("topic", "word", (F.col("tf") / F.col("size") * F.log(1 + F.col("mean") / F.col("all"))).alias("score"))
    order = Window.partitionBy("topic").orderBy(F.desc(F.round("score", 9)), "word")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("topic", "word", F.round("score", 4).alias("score"), "rank")


def topic_table(labelled: DataFrame, words: DataFrame, k: int = 20) -> DataFrame:
    """topic, count, words (array, best first), shares (map of source to share) of the ``k`` largest topics."""
    shares = topic_shares(labelled, k)
    per = shares.groupBy("topic").agg(F.sum("n").alias("count"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "share")))).alias("shares"))
    best = words.groupBy("topic").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "word", "score"))), lambda x: x["word"]).alias("words"))
    return per.join(best, "topic", "left").select("topic", "count", "words", "shares")


def topic_distribution(labelled: DataFrame) -> DataFrame:
    """source, topic ('outlier' for -1), n, share of the source's turns."""
    n = labelled.groupBy("source", F.when(F.col("topic") == -1, "outlier").otherwise(F.col("topic").cast("string")).alias("topic")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("source")), 3))


def topic_counts(labelled: DataFrame) -> DataFrame:
    """n_topics, n_outliers, n_documents."""
    return labelled.agg(F.count_distinct(F.when(F.col("topic") != -1, F.col("topic"))).alias("n_topics"), F.count_if(F.col("topic") == -1).alias("n_outliers"), F.count("*").alias("n_documents"))
