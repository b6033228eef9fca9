"""URL filters: Bloom filter cascades, built and asked with DataFrame functions only.

A cascade stands for a set of listed keys inside a universe of keys. Level 0 encodes
the listed keys; the other keys of the universe that it wrongly accepts are encoded
at level 1; listed keys that level 1 wrongly accepts at level 2, and so on until no
level errs. The first level that rejects a key decides by its parity, so that
membership is exact for every key of the universe, without a join.

A filter's size follows the listed keys, not the corpus. Where a level would be over
``MAX_BITS``, keys are shared out by hash to several cascades.

Defined results: a null url, or one without ``://``, has empty host and path and no
rule; a key outside the universe can't be asked, as the universe holds all keys of
all rows; repeated rows and rows without page_id are judged like others; equally long
rules go by text; a very long url is one key for each of its host's labels and rule
paths; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Host labels of unwanted sites: a host is listed if it or a parent starts with one.
UNWANTED = ["casino-win", "cheap-pills", "free-bets", "spam-farm", "ads-track", "adult-x"]
#: Bits of one level, 8 MB: what may go into a plan.
MAX_BITS = 1 << 26
MAX_LEVELS = 64


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def bits_for(n: int, rate: float) -> int:
    """Bits of a filter of n keys that wrongly accepts a share ``rate`` of others."""
    return max(64, math.ceil(n * -math.log(rate) / math.log(2) ** 2 / 64) * 64)


def first_rate(n: int, others: int) -> float:
    """How often the first level may err."""
    return min(0.5, max(1e-9, n / (math.sqrt(2) * others))) if others else 0.5


class Level:
    """One Bloom filter: its words of 64 bits are a constant of the plan."""

    def __init__(self, keys: DataFrame, n: int, rate: float, seed: int) -> None:
        self.hashes, self.seed = max(1, round(-math.log2(rate))), seed
        self.bits = bits_for(n, rate)
        at = keys.select(F.explode(F.array(*self._places(F.col("key")))).alias("at"))
        word = F.expr("at div 64").alias("word")
        rows = at.groupBy(word).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("at", F.lit(64)).cast("int"))).alias("bits")).collect()  # at most MAX_BITS / 64 rows
        words = [0] * (self.bits // 64)
        for r in rows:
            words[r["word"]] = r["bits"]
        self.words = F.expr(f"cast(split('{','.join(map(str, words))}', ',') as array<bigint>)")

    def _places(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.seed * 100 + j)), F.lit(self.bits)) for j in range(self.hashes)]

    def holds(self, key: Column) -> Column:
        out = F.lit(True)
        for at in self._places(key):
            word = F.element_at(self.words, F.floor(at / 64).cast("int") + 1)
            out = out & (F.getbit(word, F.pmod(at, F.lit(64)).cast("int")) == 1)
        return out


class Cascade:
    """Exact membership of ``listed`` keys within ``universe`` (a column ``key``, distinct)."""

    def __init__(self, universe: DataFrame, listed: Column, seed: int = 0) -> None:
        self.levels: list[Level] = []
        counts = universe.agg(F.count_if(listed).alias("r"), F.count_if(~listed).alias("s")).first()
        inside, outside = universe.where(listed), universe.where(~listed)
        n, others = counts["r"], counts["s"]
        while n:
            if len(self.levels) == MAX_LEVELS:
                raise RuntimeError("the cascade doesn't end: are the keys distinct?")
            rate = first_rate(n, others) if not self.levels else 0.5
            self.levels.append(level := Level(inside, n, rate, seed * MAX_LEVELS + len(self.levels)))
            wrong = outside.where(level.holds(F.col("key")))
            inside, outside, n = wrong, inside, wrong.count()

    def contains(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for i, level in reversed(list(enumerate(self.levels))):
            out = F.when(level.holds(key), out).otherwise(F.lit(i % 2 == 1))
        return out


class Filters:
    """A cascade, or, where its first level would be over ``most`` bits, one for each share of the keys by their hash.

    Each key is asked in its own share's cascade only, so membership stays exact; a
    level's words stay within ``most`` bits.
    """

    def __init__(self, universe: DataFrame, listed: Column, seed: int = 0, most: int = MAX_BITS) -> None:
        counts = universe.agg(F.count_if(listed).alias("r"), F.count_if(~listed).alias("s")).first()
        bits = bits_for(counts["r"], first_rate(counts["r"], counts["s"])) if counts["r"] else 0
        self.n = max(1, math.ceil(1.1 * bits / most))  # shares differ a little in size
        self.shares = [Cascade(universe.where(self._share(F.col("key")) == i) if self.n > 1 else universe, listed, seed) for i in range(self.n)]

    def _share(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit("share")), F.lit(self.n))

    def contains(self, key: Column) -> Column:
        out = self.shares[0].contains(key)
        for i, c in enumerate(self.shares[1:], 1):
            out = F.when(self._share(key) == i, c.contains(key)).otherwise(out)
        return out


def suffixes(host: Column) -> Column:
    """The host and its parents."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, unwanted: list[str] | None = None, listed_hosts: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of every row.

    Keys of a url are its host and parents (asked in the list of unwanted hosts) and
    each of them with each prefix of the path that is as long as some rule's path
    (asked in the block and allow rules). ``listed_hosts`` (column host) is a table of
    unwanted hosts of any size: it is joined to the universe when the filter is built,
    never to the pages.
    """
    rules, unwanted = RULES if rules is None else rules, UNWANTED if unwanted is None else unwanted
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    hosts = F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(suffixes(F.col("host")))
    sizes = sorted({len(p) for _, p, _ in rules})
    none = F.array().cast("array<string>")

    def begun(n: int) -> Column:
        return F.when(F.length("path") >= n, F.transform("hosts", lambda h: F.concat(h, F.substring("path", 1, n)))).otherwise(none)

    fits = F.flatten(F.array(*map(begun, sizes))) if sizes else none
    rows = rows.withColumn("hosts", hosts).withColumn("fits", fits)
    universe = written(rows.select(F.explode(F.concat("hosts", "fits")).alias("key")).distinct(), "keys")
    named = {v: [h + p for h, p, x in rules if x == v] for v in ("block", "allow")}
    label = F.substring_index("key", ".", 1)
    block = Filters(universe, F.col("key").isin(named["block"]), 1)
    allow = Filters(universe, F.col("key").isin(named["allow"]), 2)
    bad = ~F.col("key").contains("/") & label.isin(unwanted)
    if listed_hosts is not None:
        own = listed_hosts.select(F.translate("host", UPPER, LOWER).alias("key")).where("key is not null").distinct().withColumn("in_table", F.lit(True))
        universe = written(universe.join(own, "key", "left"), "listed")
        bad = bad | F.coalesce("in_table", F.lit(False))
    listed = Filters(universe, bad, 3)
    hits = F.transform(F.filter("fits", lambda k: block.contains(k) | allow.contains(k)), lambda k: F.struct((-F.length(k)).alias("n"), k.alias("rule"), F.when(allow.contains(k), "allow").otherwise("block").alias("verdict")))
    best = F.array_min(hits)
    other = F.when(F.exists("hosts", listed.contains), "block").otherwise("allow")
    return rows.withColumn("best", best).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", other).alias("verdict"))


#: The same in SQL: rules and unwanted labels spelled out.
ORACLE = r"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT page_id, host, p.path, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.v, length(r.h || r.p)) AS v
  FROM p LEFT JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p) GROUP BY page_id, host, p.path)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN regexp_matches(host, '(^|\.)(casino-win|cheap-pills|free-bets|spam-farm|ads-track|adult-x)(\.|$)') THEN 'block' ELSE 'allow' END) AS verdict FROM m
"""
