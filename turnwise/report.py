"""A Markdown report in eight sections, from small result tables; as many sources as there are, no canned conclusions."""

from __future__ import annotations

from pyspark.sql import DataFrame

from turnwise.analyses import MODULES
from turnwise.operators import charts

#: Title, result tables (module, name), charts, and the columns to show first.
SECTIONS: list[tuple[str, list[tuple[str, str]], list[str]]] = [
    ("1. Dataset Overview", [("comparative", "profile"), ("temporal", "ranges")], ["activity_over_time"]),
    ("2. How You Use Each Platform", [("semantic", "topics"), ("semantic", "topic_counts"), ("user", "routing")], ["topic_distribution"]),
    ("3. How They Write", [("lexical", "response_lengths"), ("lexical", "vocabulary"), ("lexical", "readability"), ("lexical", "formatting")], ["response_length_distributions", "vocabulary_comparison", "formatting_habits"]),
    ("4. How They Talk", [("pragmatic", "hedging_categories"), ("pragmatic", "questions"), ("pragmatic", "verbosity"), ("pragmatic", "openings"), ("pragmatic", "first_person"), ("pragmatic", "disclaimers")], ["hedging_comparison", "verbosity_ratio", "opening_patterns"]),
    ("5. Style Fingerprints", [("comparative", "fingerprint"), ("comparative", "summary")], ["style_fingerprint"]),
    ("6. How You Adapt", [("user", "complexity"), ("user", "vocabulary"), ("comparative", "user_questions"), ("comparative", "user_politeness")], ["user_language_comparison"]),
]
METHOD = [
    "Text figures are over assistant turns of ten characters or more unless a table says otherwise; words are white-space tokens.",
    "Conversations of activity logs are sessions: a gap of over 60 minutes starts a new one. Months are cut in UTC.",
    "Topics are k-means clusters of hashed word counts; turns far from their centre are outliers, topic -1; topic 0 is the largest.",
    "Self-similarity is the exact mean over all pairs. Sentiment is a word list with negation, positive above 0.1, negative below -0.1.",
]
NEXT = [f"`{name}`: {f.__doc__.splitlines()[0] if f.__doc__ else 'chart data'}" for name, f in charts.CHARTS.items() if name in ("bot_metrics_trends", "inflection_points", "depth_distribution", "verbosity_trajectory", "user_rephrasing_rate")]


def table(df: DataFrame, rows: int) -> list[str]:
    """A Markdown table of the first rows, by the first column."""
    head = "| " + " | ".join(df.columns) + " |"
    shown = df.orderBy(*df.columns[:2]).limit(rows).collect()
    cell = lambda v: "" if v is None else f"{v:,.4g}" if isinstance(v, float) else f"{v:,}" if isinstance(v, int) and not isinstance(v, bool) else str(v).replace("|", "/").replace("\n", " ")
    return [head, "|" + "---|" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in shown)]


def dominant(turns: DataFrame, least: float = 0.85, k: int = 5) -> list[str]:
    """Of each source the largest topics that it holds nearly alone; the catch-all is left out."""
    found: dict[str, list] = {}
    for r in MODULES["semantic"]["topics"](turns).collect():  # at most 20 rows
        for source, share in (r["shares"] or {}).items():
            if share >= least and r["topic"] != 0:
                found.setdefault(source, []).append((r["count"], ", ".join((r["words"] or [])[:4]), share))
    return [f"- **{source}**: {words} ({count} turns, {share:.0%})" for source in sorted(found) for count, words, share in sorted(found[source], reverse=True)[:k]] or ["- No topic belongs to one source alone."]


def report(turns: DataFrame, rows: int = 30, plots: str = "plots") -> str:
    """The eight sections as one text."""
    out = ["# Conversation analysis report", ""]
    for title, tables, pictures in SECTIONS:
        out += [f"## {title}", ""]
        for module, name in tables:
            out += [f"### {name.replace('_', ' ').capitalize()}", "", *table(MODULES[module][name](turns), rows), ""]
        if title.startswith("2"):
            out += ["### Topics of one source", "", *dominant(turns), ""]
        out += [f"Chart data: {', '.join(f'`{plots}/{p}.json`' for p in pictures)}", ""]
    out += ["## 7. Methodology Notes", "", *(f"- {x}" for x in METHOD), "", "## 8. What's Next", "", "Further results that this report leaves out:", "", *(f"- {x}" for x in NEXT), ""]
    return "\n".join(out)
