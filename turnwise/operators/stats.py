"""Descriptors, densities, ranks and windows that several analyses share."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def describe(x: Column | str, name: str = "") -> list[Column]:
    """mean, interpolated median, population std, count."""
    x, p = (F.col(x) if isinstance(x, str) else x), f"{name}_" if name else ""
    return [F.coalesce(F.round(F.avg(x), 4), F.lit(0.0)).alias(f"{p}mean"), F.coalesce(F.round(F.percentile(x, 0.5), 4), F.lit(0.0)).alias(f"{p}median"), F.coalesce(F.round(F.stddev_pop(x), 4), F.lit(0.0)).alias(f"{p}std"), F.count(x).alias(f"{p}count")]


def rounded(x: Column | str, digits: int) -> Column:
    """As SQL rounds a double: scaled, rounded half away from zero, scaled back. F.round reads the shortest decimal, so 0.72025 goes up there and down in SQL."""
    scale = 10.0**digits
    return F.round((F.col(x) if isinstance(x, str) else x) * scale) / scale


def per_1k(n: Column, words: Column) -> Column:
    return rounded(F.coalesce(F.try_divide(n * 1000.0, words), F.lit(0.0)), 4)


def top_k(df: DataFrame, by: list[str], item: str, order: list[Column], k: int) -> DataFrame:
    """Most frequent items of each group; ``order`` says which of equal ones came first.

    Counts are summed before the window, so a hot group costs its distinct items.
    """
    counted = df.where(F.col(item).isNotNull()).groupBy(*by, item).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("first"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), "first", item)
    return counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(*by, item, "n", "rank")


def mattr(tokens: DataFrame, by: list[str], window: int, short: str = "ttr", chunk: int = 1_000_000) -> DataFrame:
    """Moving-average type-token ratio of each group; tokens have columns pos (0-based) and token.

    A token at p whose last occurrence was at q is new in every window that holds p and
    starts after q, so the mean over all windows is a sum over tokens instead of a slide.
    Last occurrences are found within ``chunk`` positions; of each token's chunks only
    their ends meet, so a frequent token is no single task's work. Groups shorter than the
    window have their type-token ratio, or null for ``short='null'``.
    """
    dealt = tokens.withColumn("chunk", F.floor(F.col("pos") / chunk))
    last = F.lag("pos").over(Window.partitionBy(*by, "token", "chunk").orderBy("pos"))
    ends = dealt.groupBy(*by, "token", "chunk").agg(F.min("pos").alias("pos"), F.max("pos").alias("end"), F.count("*").alias("n"))
    n = ends.groupBy(*by).agg(F.sum("n").alias("n"), F.count_distinct("token").alias("types"))
    first = ends.select(*by, "pos", F.coalesce(F.lag("end").over(Window.partitionBy(*by, "token").orderBy("chunk")), F.lit(-1)).alias("last"))
    every = dealt.withColumn("last", last).where("last is not null").select(*by, "pos", "last").union(first)
    first_start = F.greatest(F.col("pos") - (window - 1), F.col("last") + 1, F.lit(0))
    added = F.greatest(F.lit(0), F.least(F.col("pos"), F.col("n") - window) - first_start + 1)
    hits = every.join(F.broadcast(n) if by == ["source"] else n, by).where(F.col("n") >= window).groupBy(*by).agg(F.sum(added).alias("hits"))
    whole = F.lit(None) if short == "null" else F.col("types") / F.col("n")
    return n.join(hits, by, "left").select(*by, "n", "types", F.when(F.col("n") >= window, F.col("hits") / (F.lit(float(window)) * (F.col("n") - window + 1))).otherwise(whole).alias("mattr"))


def pearson(df: DataFrame, by: list[str], x: str, y: str, least: int = 3) -> DataFrame:
    """r of each group of ``least`` rows or more; null where a side doesn't vary."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))  # corr() fails on a side that doesn't vary
    return df.groupBy(*by).agg(F.when(F.count("*") >= least, r).alias("r"))


def upper_median(name: str) -> Column:
    """The value after the middle of a column's sorted values, not averaged."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {name} DESC)")


def density(df: DataFrame, by: list[str], value: str, points: int = 300, low: float | None = None, high: float | None = None) -> DataFrame:
    """(by..., x, y): Gaussian kernel density at equal points, Scott's bandwidth.

    Values are first counted (equal ones once), so the kernel sum is over distinct values.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    total = F.sum("n")
    mean = F.sum(F.col("v") * F.col("n")) / total
    spread = F.sqrt((F.sum(F.col("v") * F.col("v") * F.col("n")) - total * mean * mean) / (total - 1))
    ends = counted.groupBy(*by).agg(total.alias("total"), (spread * F.pow(total.cast("double"), F.lit(-0.2))).alias("h"), *(f("v").alias(k) if given is None else F.lit(float(given)).alias(k) for k, f, given in (("low", F.min, low), ("high", F.max, high)))).where("total > 1 and h > 0")
    grid = ends.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", F.col("low") + (F.col("high") - F.col("low")) * F.col("i") / (points - 1))
    z = (F.col("x") - F.col("v")) / F.col("h")
    kernel = F.sum(F.col("n") * F.exp(z * z * -0.5)) / (F.first("total") * F.first("h") * (2 * math.pi) ** 0.5)
    return counted.join(F.broadcast(grid), by).groupBy(*by, "i", "x").agg(kernel.alias("y")).drop("i")  # ``points`` rows a group


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """1 - 6 sum d^2 / (n (n^2 - 1)) of average-tie ranks; null for fewer than three rows."""

    def rank(c: str) -> Column:
        return F.rank().over(Window.partitionBy(*by).orderBy(c)) + (F.count("*").over(Window.partitionBy(*by, c)) - 1) / 2.0

    d = df.select(*by, (rank(x) - rank(y)).alias("d"))
    n = F.count("*")
    return d.groupBy(*by).agg(F.when(n >= 3, 1 - 6 * F.sum(F.col("d") * F.col("d")) / (n * (n * n - 1))).alias("rho"))


def self_similarity(vectors: DataFrame, by: list[str], col: str, held: int = 64) -> DataFrame:
    """Mean and std of the cosine of all pairs in a group, without forming a pair.

    With unit vectors v, the pairs' sum is |sum v|^2 - n and their square sum is the
    squared norm of the d x d matrix sum v v' less n. Tasks add up both by matrix
    products, ``held`` groups at a time; only these sums are shuffled. Null and zero
    vectors are left out; a group's vectors are of one length.
    """

    def sums(batches):
        import numpy as np
        import pyarrow as pa

        own: dict[tuple, np.ndarray] = {}

        def flush():
            keys = list(zip(*own, strict=True)) or [()] * len(by)
            columns = [pa.array(k, t) for k, t in zip(keys, kinds, strict=True)]
            out = pa.RecordBatch.from_arrays([*columns, pa.array([m.ravel() for m in own.values()], pa.list_(pa.float64()))], names=[*by, "m"])
            own.clear()
            return out

        kinds = None
        for batch in batches:
            kinds = [c.type for c in batch.columns[:-1]]
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*(c.to_pylist() for c in batch.columns[:-1]), strict=True)):
                groups.setdefault(key, []).append(i)
            values = batch.columns[-1]
            for key, at in groups.items():
                v = np.array([x for x in values.take(pa.array(at)).to_pylist() if x is not None], float)
                if not v.size:
                    continue
                norm = np.sqrt((v * v).sum(axis=1))
                v = v[norm > 0] / norm[norm > 0, None]
                v = np.concatenate((np.ones((len(v), 1)), v), axis=1)  # the matrix then holds n and the sum of vectors too
                own[key] = own.get(key, 0) + v.T @ v
                if len(own) >= held:
                    yield flush()
        if own:
            yield flush()

    names = ", ".join(f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in by)
    parts = vectors.select(*by, F.transform(col, lambda x: x.cast("double")).alias("v")).mapInArrow(sums, f"{names}, m array<double>")
    cells = parts.select(*by, F.sqrt(F.size("m").cast("double")).cast("long").alias("d"), F.posexplode("m").alias("at", "x")).groupBy(*by, "d", "at").agg(F.sum("x").alias("x"))
    square = F.col("x") * F.col("x")
    s = cells.groupBy(*by).agg(F.max(F.when(F.col("at") == 0, F.col("x"))).alias("n"), F.sum(F.when((F.col("at") > 0) & (F.col("at") < F.col("d")), square)).alias("a"), F.sum(F.when((F.col("at") >= F.col("d")) & (F.col("at") % F.col("d") > 0), square)).alias("b"))
    pairs = F.col("n") * (F.col("n") - 1)
    mean, second = F.try_divide(F.col("a") - F.col("n"), pairs), F.try_divide(F.col("b") - F.col("n"), pairs)
    return s.where("n > 0").select(*by, F.col("n").cast("long").alias("n"), F.round(F.coalesce(mean, F.lit(0.0)), 4).alias("mean"), F.round(F.coalesce(F.sqrt(F.greatest(F.lit(0.0), second - mean * mean)), F.lit(0.0)), 4).alias("std"))


def expanding_z(df: DataFrame, by: list[str], order: str, value: str, threshold: float = 1.5, least: int = 4) -> DataFrame:
    """Rows whose value is ``threshold`` deviations off the mean of the rows before (three at least)."""
    own = Window.partitionBy(*by).orderBy(order)
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    rows = df.where(F.col(value).isNotNull()).select("*", F.row_number().over(own).alias("_at"), F.count("*").over(Window.partitionBy(*by)).alias("_n"), F.avg(value).over(before).alias("_mean"), F.stddev_pop(value).over(before).alias("_std"))
    z = rows.where((F.col("_n") >= least) & (F.col("_at") > 3) & (F.col("_std") >= 1e-6)).withColumn("z", (F.col(value) - F.col("_mean")) / F.col("_std"))
    return z.where(F.abs("z") >= threshold).drop("_at", "_n", "_mean", "_std")


def histogram(df: DataFrame, by: list[str], value: str, bins: int, low: float, high: float) -> DataFrame:
    """Counts of equal bins from low to high; the last holds high."""
    b = F.least(F.floor((F.col(value) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("long")
    return df.where(F.col(value).between(low, high)).groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"))
