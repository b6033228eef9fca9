"""Operators on literal rows, against hand results and plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from turnwise.functions import text as T
from turnwise.operators import lexical, pragmatic, semantic, stats, structure, user


def one(spark, text, *cols):
    return spark.createDataFrame([(text,)], "content string").select(*cols).first()


def turns(spark, rows):
    return spark.createDataFrame(rows, "source string, conv_id long, turn_idx int, role string, content string").withColumns({"created_at": F.lit(None).cast("timestamp"), "ts": F.lit(None).cast("timestamp")})


@pytest.mark.parametrize("text", ["", "a b", " a b　c d\x1ce ", "x\n\ny\tz"])
def test_words_as_python(spark, text):
    r = one(spark, text, T.word_count(F.col("content")), T.words(F.col("content")), T.strip(F.col("content")))
    assert (r[0], r[1], r[2]) == (len(text.split()), text.split(), text.strip())


def test_phrases(spark):
    r = one(spark, "mayor may may. it's worth noting it's worth noting", T.count_phrase(F.col("content"), "may"), T.count_phrase(F.col("content"), "it's worth noting"))
    assert tuple(r) == (2, 2)


def test_sentiment_negation(spark):
    rows = [("s", 1, i, "assistant", t) for i, t in enumerate(["this is not good", "not at all really good", "unable, but good", "nothing to say of it, neither"])]
    got = {r.turn_idx: r.score for r in semantic.sentiment(turns(spark, rows)).collect()}
    assert got[0] == -0.5 and got[1] == 1.0 and abs(got[2] + 1 / 3) < 1e-9


def test_mattr_brute_force(spark):
    rng = random.Random(3)
    for n, w in ((4, 5), (5, 5), (6, 5), (60, 7)):
        toks = [rng.choice("abcdef") for _ in range(n)]
        df = spark.createDataFrame([("s", i, t) for i, t in enumerate(toks)], "source string, pos long, token string")
        want = len(set(toks)) / n if n < w else sum(len(set(toks[i : i + w])) / w for i in range(n - w + 1)) / (n - w + 1)
        assert abs(stats.mattr(df, ["source"], w).first().mattr - want) < 1e-9
        assert (stats.mattr(df, ["source"], w, "null").first().mattr is None) == (n < w)


def test_self_similarity_brute_force(spark):
    rng = random.Random(5)
    vs = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(7)]
    df = spark.createDataFrame([(1, v) for v in vs], "g int, v array<double>")
    norm = [sum(x * x for x in v) ** 0.5 for v in vs]
    cos = [sum(a * b for a, b in zip(vs[i], vs[j], strict=True)) / norm[i] / norm[j] for i in range(7) for j in range(i)]
    m = sum(cos) / len(cos)
    r = stats.self_similarity(df, ["g"], "v").first()
    assert abs(r.mean - m) < 1e-4 and abs(r.std - (sum((c - m) ** 2 for c in cos) / len(cos)) ** 0.5) < 1e-4


def test_spearman(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 1.0), ("a", 3.0, 5.0), ("b", 1.0, 1.0), ("b", 2.0, 2.0)], "k string, x double, y double")
    got = {r.k: r.rho for r in stats.spearman(df, ["k"], "x", "y").collect()}
    assert abs(got["a"] - (1 - 6 * 0.5 / 24)) < 1e-9 and got["b"] is None


def test_expanding_z(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, 1.0, 1.0, 5.0])] + [("b", i, v) for i, v in enumerate([1.0, 2.0, None, 3.0, 9.0])], "k string, m int, v double")
    got = [(r.k, r.m) for r in stats.expanding_z(df, ["k"], "m", "v").collect()]
    assert got == [("b", 4)]


def test_top_k_first_seen_wins(spark):
    df = spark.createDataFrame([("s", 1, "b"), ("s", 2, "a"), ("s", 3, "a"), ("s", 4, "b"), ("s", 5, "c")], "source string, at int, w string")
    assert [(r.w, r.n) for r in stats.top_k(df, ["source"], "w", [F.col("at")], 2).orderBy("rank").collect()] == [("b", 2), ("a", 2)]


def test_depth_and_resolution(spark):
    rows = [("s", 1, 0, "assistant", "hello there all"), ("s", 2, 0, "user", "Actually, thanks?"), ("s", 2, 1, "assistant", "you are welcome now"), ("s", 3, 0, "user", "thanks a lot for all of it"), ("s", 4, 0, "user", "ok bye")]
    t = turns(spark, rows)
    assert {r.conv_id: r.pairs for r in structure.exchanges(t).collect()} == {1: 1, 2: 1, 3: 1, 4: 1}
    assert {r.kind: r.n for r in structure.resolution(t).collect()} == {"no_user_turns": 1, "correction": 1, "thank_you": 1, "short_close": 1}


def test_formatting_floors_fences(spark):
    rows = [("s", 1, i, "assistant", "# head line\n- item\n```code **bold** *it*") for i in range(3)]
    got = {r.kind: r.n for r in lexical.formatting(turns(spark, rows)).collect()}
    assert got == {"headers": 3, "bullet_points": 3, "numbered_lists": 0, "code_blocks": 1, "bold": 3, "italic": 3}
    assert turns(spark, rows).agg(F.sum(lexical.marks_per_text())).first()[0] == 12


def test_verbosity_needs_five_user_words(spark):
    rows = [("s", 1, 0, "user", "one two three four"), ("s", 1, 1, "assistant", "a b c d e f g h"), ("s", 1, 2, "user", "one two three four five"), ("s", 1, 3, "assistant", "a b c d e f g h i j")]
    assert [r.ratio for r in pragmatic.verbosity(turns(spark, rows)).collect()] == [2.0]


def test_first_message_skips_short(spark):
    rows = [("s", 1, 0, "user", "hi"), ("s", 1, 1, "user", "please write me a long text"), ("s", 2, 0, "user", "Write me a poem now"), ("s", 3, 0, "user", "is it so, or not?")]
    assert {r.conv_id: r.kind for r in user.first_messages(turns(spark, rows)).collect()} == {2: "command", 3: "question"}


def test_clusters_of_five_features(spark):
    """Conversations that differ only in their trajectories are told apart; labels follow the centroid."""
    rows = []
    for c in range(24):
        up = c % 2 == 0
        for k in range(4):
            n = 20 * (k + 1 if up else 4 - k)
            rows += [("s", c, 2 * k, "user", "question " * (c // 2 % 2 * k + 3)), ("s", c, 2 * k + 1, "assistant", "answer " * n)]
    feats = {r.conv_id: r for r in structure.cluster_features(turns(spark, rows)).collect()}
    r = feats[0]
    assert (r.turn_pairs, r.duration_min, r.verbosity_trajectory, r.mean_asst_length) == (4, 0, 1, 50) and feats[1].verbosity_trajectory == -1
    got = structure.clusters(turns(spark, rows)).collect()
    assert len(got) == 24 and {x.status for x in got} == {"ok"}
    assert {(x.conv_id % 2, x.label) for x in got} == {(0, "Short concise (escalating)"), (1, "Short concise (tapering)")}
    assert structure.cluster_label(30, 0, 0, 0, 600) == "Deep verbose (steady)"
    assert structure.clusters(turns(spark, [("s", c, k, "user", "the same") for c in range(12) for k in range(2)])).count() == 12


def as_sql(spark, path, name, rows):
    """Rows of a query and of its SQL over conversations of (conv_id, turn, role, text)."""
    import duckdb

    from turnwise.plans import conversation

    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{path}/conversations.parquet/*.parquet'")
    got, want = conversation.QUERIES[name](spark, str(path)), con.sql(conversation.ORACLES[name])
    return (sorted((tuple(float(r[c]) if type(r[c]).__name__ == "Decimal" else r[c] for c in want.columns) for r in x), key=str) for x in (got.collect(), [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]))


def test_rounded_as_sql(spark):
    import duckdb

    values = [(k * 10 + 5) / 10 ** (d + 1) for d in (1, 2, 3, 4) for k in range(7000, 7400)] + [-0.72025, 1.5, float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select("v", *(stats.rounded("v", d).alias(f"r{d}") for d in (1, 2, 3, 4))).collect()
    want = duckdb.execute("SELECT v, round(v, 1), round(v, 2), round(v, 3), round(v, 4) FROM (SELECT unnest(?::DOUBLE[]) AS v)", [values]).fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_all_inflections_as_sql(spark, tmp_path):
    """The last months have values on a tie of the rounding, a hedge before an accent and a carriage return before a mark."""
    rows = [(30 * m, t, "assistant", "word other words " * 40 + "could\n# mot " * (m % 3 % 2)) for m in range(7) for t in (2, 5)]
    rows += [(210, t, "assistant", " ".join(["the", *["une"] * (k % 2), "mayé could could\r# head\n# head", *["mot"] * 40])) for k, t in enumerate(range(2, 122, 3))]
    rows += [(240, 2, "assistant", "could " * 9 + "mot " * 1591)]  # 9 of 1600: 5.625
    rows += [(270, 2, "assistant", "could " * 461 + "mot " * 31539)]  # 461 of 32000: 14.40625
    got, want = as_sql(spark, tmp_path, "all_inflections", rows)
    assert got == want and {r[2] for r in got} >= {"hedges_per_1k", "marks_per_1k"}


#: Openings of texts of which Java's default boundary and case differ from SQL's.
OPENINGS = ["doé these words for me", "testê or not, in a word", "Do the first of them", "can youé say it again", "what iſ the way to it", "maKe a list of the names", "lıst them all in order", "docs are here for you", "what isé to be done there", "DO it once more for me"]


def test_framing_as_sql(spark, tmp_path):
    got, want = as_sql(spark, tmp_path, "framing", [(3 * c, t, "user", text) for c, text in enumerate(OPENINGS) for t in range(6)])
    assert got == want and {r[1] for r in got} == {"imperative", "request", "other"}


def test_first_message_as_sql(spark, tmp_path):
    """Openings as above, a first turn without a text, and a mean and a share on a tie of the rounding."""
    rows = [(3 * c, t, "user", text) for c, text in enumerate(OPENINGS) for t in (1, 2)] + [(3, 0, "user", None), (6, 0, "user", None)]
    for source, n in ((1, 160), (2, 800)):
        rows += [(300 + 3 * c + source, (3 - (300 + source)) % 3 + 2, "user", "Write the word again now" if c % 160 < 23 else "Are all words in this one?" if c % 7 else "nothing of all that, then") for c in range(n)]
    got, want = as_sql(spark, tmp_path, "first_message", rows)
    assert got == want and len(got) > 6


def test_rephrase_report_as_sql(spark, tmp_path):
    """Letters (0, 5, 5) and (3, 4, 5): a cosine of 0.9 to the last bit. Texts without letters. Rates on a tie of the rounding."""
    pairs = [("bbbbbccccc", "aaabbbbccccc")] * 23 + [("0123456789 0", "?????????? !"), ("0123456789 0", "aaabbbbccccc")] + [("aaaaaaaaaa", "zzzzzzzzzz")] * 375
    rows = [(21 * c, t, role, text) for c, (a, b) in enumerate(pairs) for t, role, text in ((2, "user", a), (3, "assistant", "yes"), (5, "user", b))]
    got, want = as_sql(spark, tmp_path, "rephrase_report", rows)
    assert got == want and [r[1] for r in got] == [25]
