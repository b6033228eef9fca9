"""The analyses by module: name -> function of the turn table. Each gives a small table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.functions import lexicons as L
from turnwise.operators import charts, comparative, lexical, pragmatic, semantic, structure, temporal, user
from turnwise.operators.features import profile, turn_features
from turnwise.operators.stats import describe, self_similarity
from turnwise.operators.turns import said_by

Analysis = Callable[[DataFrame], DataFrame]


def _labelled(turns: DataFrame) -> DataFrame:
    return semantic.topics(said_by(turns, "assistant"))


def _topic_controlled(turns: DataFrame) -> DataFrame:
    """Over the topic that sources share most evenly; without one, over the catch-all."""
    labelled = _labelled(turns)
    best = semantic.shared_topic(labelled).first()
    topic = int(best["topic"]) if best else 0
    words = [r["word"] for r in semantic.topic_words(labelled, lexical.content_tokens()).where(F.col("topic") == topic).orderBy("rank").collect()]  # ten rows
    return comparative.topic_controlled(turns, topic, words)


MODULES: dict[str, dict[str, Analysis]] = {
    "lexical": {
        "vocabulary": lexical.vocabulary, "top_words": lexical.top_words, "distinctive_words": lexical.distinctive, "sentence_lengths": lexical.sentence_lengths,
        "response_lengths": lexical.response_lengths, "readability": lexical.readability, "formatting": lexical.formatting,
    },
    "semantic": {
        "topics": lambda t: (lambda x: semantic.topic_table(x, semantic.topic_words(x, lexical.content_tokens())))(_labelled(t)),
        "topic_distribution": lambda t: semantic.topic_distribution(_labelled(t)), "topic_counts": lambda t: semantic.topic_counts(_labelled(t)),
        "self_similarity": lambda t: self_similarity(semantic.encode(said_by(t, "assistant")), ["source"], "vector"), "sentiment": semantic.sentiment_by_source,
    },
    "pragmatic": {
        "hedging": lambda t: pragmatic.phrases(t, "assistant", L.HEDGES), "hedging_categories": lambda t: pragmatic.categories(t, "assistant", L.HEDGES),
        "disclaimers": lambda t: pragmatic.categories(t, "assistant", L.DISCLAIMERS), "questions": pragmatic.question_rate,
        "verbosity": lambda t: pragmatic.verbosity(t).groupBy("source").agg(*describe("ratio")), "first_person": pragmatic.first_person, "dynamics": pragmatic.dynamics,
        "openings": pragmatic.openings, "opening_pairs": lambda t: pragmatic.openings(t, n_words=2), "tracked_openings": pragmatic.tracked_openings,
    },
    "comparative": {
        "profile": lambda t: profile(turn_features(t)), "fingerprint": comparative.fingerprint, "topic_controlled": _topic_controlled,
        "summary": lambda t: comparative.summary(t, controlled=_topic_controlled(t)),
        "user_words": lambda t: lexical.top_words(t, "user", 20), "user_distinctive": lambda t: lexical.distinctive(t, "user", 20), "user_questions": lambda t: pragmatic.question_rate(t, "user"),
        "user_sentences": lambda t: lexical.sentence_lengths(t, "user"), "user_politeness": lambda t: pragmatic.phrases(t, "user", {"politeness": L.POLITENESS_SUBSTRINGS}, plain=True),
    },
    "temporal": {
        "activity": temporal.activity, "ranges": temporal.ranges, "bot_trends": temporal.bot_trends, "user_trends": temporal.user_trends,
        "inflections": lambda t: temporal.all_inflections(temporal.bot_trends(t), charts.BOT_SERIES), "topic_shifts": lambda t: temporal.topic_shifts(_labelled(t)),
    },
    "structure": {
        "shape": structure.shape_metrics, "depths": structure.depths, "resolution": structure.resolution, "clusters": structure.clusters,
        "rephrasings": lambda t: structure.rephrase_report(t, charts.user_vectors(t)), "rephrase_examples": lambda t: structure.rephrase_examples(charts.user_vectors(t)),
    },
    "user": {
        "complexity": user.complexity, "vocabulary": user.vocabulary, "prompting": lambda t: pragmatic.categories(t, "user", user.PROMPTING),
        "politeness": lambda t: pragmatic.phrases(t, "user", {"politeness": L.POLITENESS_WORDS}), "casual": user.casual, "framing": user.framing, "capitals": user.capitals,
        "first_messages": user.first_message_kinds, "rephrase_rates": lambda t: user.rephrase_rates(t, charts.user_vectors(t)), "most_rephrased": lambda t: user.most_rephrased(charts.user_vectors(t)),
        "routing": lambda t: user.routing(_labelled(t)),
    },
}


def run(turns: DataFrame, module: str | None = None) -> dict[str, DataFrame]:
    """Results of one module, or of all."""
    names = [module] if module else list(MODULES)
    return {f"{m}.{k}": f(turns) for m in names for k, f in MODULES[m].items()}
