"""The charts' data as driver queries, with SQL twins that go on from those of the analyses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from turnwise.operators import charts
from turnwise.plans.conversation import BOT, ORACLES, PEARSON, TRENDS, by_rule, letters, wc, wc_of
from turnwise.plans.tables import TURNS_SQL, turns

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, str] = {}


def _chart(name: str, sql: str, prepare: Callable[[DataFrame], DataFrame] = lambda t: t, **given) -> None:
    f = charts.CHARTS.get(name) or getattr(charts, name)
    QUERIES[f"chart_{name}"] = lambda spark, sf_dir: f(prepare(turns(spark, sf_dir)), **given)
    TWINS[f"chart_{name}"] = sql


def _of(base: str, series: str, x: str, y: str, more: str = "") -> str:
    return f"WITH b AS ({ORACLES.get(base, base)}) SELECT {series} AS series, ({x})::VARCHAR AS x, round(({y})::DOUBLE, 4) AS y FROM b {more}"


def _bars(base: str, columns: dict[str, str]) -> str:
    return f"WITH b AS ({ORACLES.get(base, base)}) " + " UNION ALL ".join(f"SELECT source AS series, '{k}' AS x, round(({c})::DOUBLE, 4) AS y FROM b" for k, c in columns.items())


def _lines(base: str, columns: list[str]) -> str:
    return f"WITH b AS ({ORACLES.get(base, base)}) " + " UNION ALL ".join(f"SELECT source || ' {c}' AS series, month AS x, round(({c})::DOUBLE, 4) AS y FROM b WHERE {c} IS NOT NULL" for c in columns)


def _bins(values: str, bins: int) -> str:
    """values: CTEs that end in h (series, v)."""
    return f"{values}, ends AS (SELECT min(v)::DOUBLE AS low, max(v)::DOUBLE AS high FROM h), b AS (SELECT series, round(low + coalesce(least(floor((v - low) / nullif((high - low) / {bins}, 0)), {bins - 1}), 0) * ((high - low) / {bins}), 6) AS place FROM h, ends) SELECT series, place::DECIMAL(18,6)::VARCHAR AS x, round(count(*) / sum(count(*)) OVER (PARTITION BY series), 4) AS y FROM b GROUP BY series, place"


_RATIO = f"{TURNS_SQL}, p AS (SELECT *, lead(role) OVER w AS role2, lead(content) OVER w AS content2 FROM turns WINDOW w AS (PARTITION BY source, conv_id ORDER BY turn_idx)), r AS (SELECT source AS series, {wc_of('content2')} / {wc} AS v FROM p WHERE role = 'user' AND role2 = 'assistant' AND {wc} >= 5 AND length(content2) >= 10), h AS (SELECT * FROM r WHERE v <= (SELECT quantile_cont(v, 0.95) FROM r))"
_WORDS = f"{TURNS_SQL}, r AS (SELECT source AS series, {wc} AS v {BOT}), h AS (SELECT * FROM r WHERE v <= (SELECT quantile_cont(v, 0.95) FROM r))"
_TOPICS = f"{TURNS_SQL} SELECT topic, source, round(count(*) / sum(count(*)) OVER (PARTITION BY topic), 4) AS share FROM (SELECT conv_id % 5 - 1 AS topic, source {BOT}) WHERE topic <> -1 GROUP BY 1, 2"
_USERS = f"WITH c AS ({ORACLES['user_complexity']}), m AS ({ORACLES['user_vocabulary']}), q AS ({ORACLES['user_questions']}), p AS (SELECT source, sum(per_1k) AS politeness FROM ({ORACLES['politeness_substr']}) GROUP BY 1) SELECT c.source, words_mean, mattr, mean_per_turn, politeness FROM c JOIN m USING (source) JOIN q USING (source) JOIN p USING (source)"
_FORMAL = f"WITH p AS (SELECT source, sum(per_1k) AS politeness FROM ({ORACLES['politeness_boundary']}) GROUP BY 1), c AS ({ORACLES['casual_markers']}), k AS ({ORACLES['capitalization']}) SELECT p.source, politeness, contractions_per_1k, lowercase_only * 100 / turns AS lc, no_punctuation * 100 / turns AS np, rate FROM p JOIN c USING (source) JOIN k USING (source)"
_chart("vocabulary_comparison", _bars("vocabulary_mattr_500", {c: c for c in ("mattr", "ttr", "types")}))
_chart("distinctive_words", _of("tfidf_distinctive", "source", "word", "score", "WHERE rank <= 15"))
_chart("response_length_distributions", _bins(_WORDS, 60))
_chart("formatting_habits", _of("formatting_habits", "source", "kind", "per_1k"))
_chart("topic_distribution", _of(_TOPICS, "source", "topic", "share"), by_rule)
_chart("hedging_comparison", _of("hedging_by_phrase", "source", "phrase", "per_1k", "WHERE phrase IN (SELECT phrase FROM b GROUP BY 1 ORDER BY max(per_1k) DESC, phrase LIMIT 10)"))
_chart("style_fingerprint", _of("style_fingerprint", "source", "metric", "scaled"), encode=letters)
_chart("verbosity_ratio", _bins(_RATIO, 60))
_chart("user_language_comparison", _bars(_USERS, {"message_words": "words_mean", "mattr": "mattr", "questions": "mean_per_turn", "politeness": "politeness"}))
_chart("opening_patterns", f"WITH o AS ({ORACLES['opening_words']}), n AS ({TURNS_SQL} SELECT source, count(*) AS k {BOT} GROUP BY 1) SELECT source AS series, opening AS x, round(n * 100 / k, 4) AS y FROM o JOIN n USING (source)")
_chart("activity_over_time", _lines("month_activity", ["turns", "convs"]))
_chart("bot_metrics_trends", _lines(TRENDS, charts.BOT_SERIES))
_chart("user_metrics_trends", _lines("user_trends", ["mean_words", "per_conv", "question_share"]))
_chart("inflection_points", _of("all_inflections", "source || ' ' || metric", "month", "z"))
_chart("depth_distribution", _of("depth", "source", "depth", "n * 100 / sum(n) OVER (PARTITION BY source)"))
_chart("rephrasing_rate", _bars(ORACLES["rephrase_report"].replace(">= 0.9", ">= 0.6"), {"per_100_turns": "per_100_turns", "conversations_pct": "conversations * 100 / n_conversations"}), letters)
_chart("resolution_patterns", _of("resolution", "source", "kind", "share"))
_chart("verbosity_trajectory", _bins(f"{TURNS_SQL},{PEARSON}, h AS (SELECT source || ' ' || role AS series, round(r, 6) AS v FROM c WHERE r IS NOT NULL)", 30))
_chart("prompt_engineering_patterns", _of("prompt_patterns", "source", "category", "per_1k"))
_chart("user_formality", _bars(_FORMAL, {"politeness": "politeness", "contractions": "contractions_per_1k", "lowercase_pct": "lc", "no_punctuation_pct": "np", "rate": "rate"}))
_chart("user_rephrasing_rate", _bars("rephrase_rates", {"strict_per_100": "strict_per_100", "loose_per_100": "loose_per_100"}), letters)
_chart("response_density", f"{_WORDS}, e AS (SELECT series, count(*) AS n, stddev_samp(v) * pow(count(*), -0.2) AS bw, min(v)::DOUBLE AS low, max(v)::DOUBLE AS high FROM h GROUP BY 1 HAVING count(*) > 1), g AS (SELECT *, i, low + (high - low) * i / 299 AS place FROM e, range(300) t(i)) SELECT series, round(place, 4)::DECIMAL(18,4)::VARCHAR AS x, round(1000 * (SELECT sum(exp(-0.5 * pow((place - h.v) / bw, 2))) FROM h WHERE h.series = g.series) / (n * bw * sqrt(2 * pi())), 4) AS y FROM g")
