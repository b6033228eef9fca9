"""Every driver query against its SQL twin in DuckDB."""

import math
from pathlib import Path

import duckdb
import pytest

from turnwise.plans import charts, conversation

ORACLES, QUERIES = conversation.ORACLES | charts.TWINS, conversation.QUERIES | charts.QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([float(r[i]) if type(r[i]).__name__ == "Decimal" else r[i] for i in order] for r in rows), key=str)


def same(a, b):
    return a == b or (isinstance(a, (int, float)) and isinstance(b, (int, float)) and math.isclose(a, b, abs_tol=1e-6))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA), duck.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows_of(got.collect(), got.columns), rows_of(want.fetchall(), want.columns)
    assert len(a) == len(b)
    assert all(same(x, y) for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True))


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


#: What has no row or no number on so small a table; sf0.01 has.
SPARSE = {"inflections", "all_inflections", "chart_inflection_points", "topic_routing", "most_rephrased"}
#: Whose word lists don't occur in the driver's own texts.
LISTED = ["hedging_by_phrase", "hedging_by_category", "disclaimers", "politeness_substr", "politeness_boundary", "question_rate", "first_person", "casual_markers", "framing", "resolution", "rephrase_060", "rephrase_strict_loose"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_shows_something(duck, name):
    """No query is right by having only zeros or a single value."""
    want = duck.sql(ORACLES[name])
    rows = want.fetchall()
    values = {c: {r[i] for r in rows} for i, c in enumerate(want.columns)}
    numbers = [v for v in values.values() if any(isinstance(x, (int, float)) for x in v)]
    assert name in SPARSE or (rows and any(v - {0, None} for v in numbers or values.values()))
    if name in LISTED:
        assert len(rows) > 1 and sum(len(v) > 1 for v in values.values()) > 1


def test_html_text(spark):
    """Against the standard library, on every page."""
    import html
    import re

    blocks = "p|div|br|li|ul|ol|tr|table|h[1-6]|pre|blockquote|section|article|hr"
    pages = dict(map(tuple, spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "html").collect()))
    for r in QUERIES["html_text"](spark, DATA).collect():
        t = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", "", pages[r.page_id])
        t = html.unescape(re.sub(r"<[^>]*>", "", re.sub(rf"(?i)</?(?:{blocks})\b[^>]*>", "\n", t)))
        lines = [" ".join(x.split()) for x in t.split("\n")]
        assert r.text == re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()
