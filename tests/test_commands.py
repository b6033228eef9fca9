"""From raw exports to results, charts and a report through the commands; golden parser results on exports of our own."""

import json

import pytest
from pyspark.sql import functions as F

from turnwise import analyses, cli
from turnwise.config import Config, load, parsed
from turnwise.operators import charts, comparative, semantic, stats
from turnwise.operators.turns import positioned, starts
from turnwise.sources import chatgpt, claude, gemini
from turnwise.sources.json_files import broken
from turnwise.sources.turns import as_turns, read_turns

ANSWER = "I think this is a good answer, however it could be better. What do you want to know? Here is a list of things that might help you with it."


def write_exports(raw):
    (raw / "claude").mkdir(parents=True)
    (raw / "chatgpt").mkdir()
    (raw / "gemini").mkdir()
    msgs = lambda n: [{"sender": ("human", "assistant")[k % 2], "text": f"please explain step by step what part {n} is about {k}" if k % 2 == 0 else f"{ANSWER} {n}", "created_at": f"2025-0{1 + n % 6}-03T10:{k:02d}:00Z", "content": []} for k in range(6)]
    (raw / "claude/conversations.json").write_text(json.dumps([{"uuid": f"c{n}" if n else "", "name": f"n{n}", "created_at": f"2025-0{1 + n % 6}-03T10:00:00Z", "chat_messages": msgs(n)} for n in range(8)]))
    node = lambda p, role, text: {"parent": p, "message": {"author": {"role": role}, "create_time": 1.74e9, "content": {"content_type": "text", "parts": [text]}}}
    (raw / "chatgpt/conversations.json").write_text(json.dumps([{"conversation_id": "" if n == 0 else None, "id": f"g{n}", "title": "t", "create_time": 1.74e9 + n * 2e6, "current_node": "b", "mapping": {"a": node(None, "user", "can you tell me more about it all"), "b": node("a", "assistant", ANSWER)}} for n in range(6)]))
    cell = lambda n: f'<div class="outer-cell"><div class="content-cell body-1">Prompted&nbsp;what is number {n}<br>and why<br><br>Attached 2 files<br>Feb {n}, 2025, 2:22:05&#8239;PM CST<br><p>{ANSWER} &eacute;&#x41;&#66;</p></div></div>'
    (raw / "gemini/MyActivity.html").write_text("<html>" + "".join(map(cell, range(1, 9))) + "</html>")


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("run")
    write_exports(base / "raw")
    (base / "config.yaml").write_text(f"paths:\n  raw_data: {base}/raw\n  processed_data: {base}/processed  # here\n  outputs: {base}/out\nanalysis:\n  min_turn_length: 10\n")
    assert cli.main(["--config", f"{base}/config.yaml", "parse"], spark) == 0
    return base


def test_parse_keeps_ids_apart(spark, folders):
    turns = read_turns(spark, f"{folders}/processed/turns")
    n = {r.source: (r.c, r.t) for r in turns.groupBy("source").agg(F.count_distinct("conversation_id").alias("c"), F.count("*").alias("t")).collect()}
    assert n == {"claude": (8, 48), "chatgpt": (6, 12), "gemini": (8, 16)}
    assert {r[0] for r in turns.where("source = 'chatgpt'").select("conversation_id").distinct().collect()} == {f"g{i}" for i in range(6)}
    first = turns.where("source = 'gemini' and turn_idx = 0").orderBy("created_at").first()
    assert first.content == "what is number 1 and why"
    assert turns.where("source = 'gemini' and turn_idx = 1").orderBy("created_at").first().content.endswith("éAB")
    seq = turns.where("source = 'claude' and title is not null").groupBy("conversation_id").agg(F.min("conv_seq").alias("s"), F.first("title").alias("t")).orderBy("s").collect()
    assert [r.t for r in seq] == [f"n{i}" for i in range(8)]


def test_commands_write_results(spark, folders, capsys):
    config = ["--config", f"{folders}/config.yaml"]
    assert cli.main([*config, "inspect"], spark) == 0 and "claude:" in capsys.readouterr().out
    for module in ("lexical", "pragmatic", "user"):
        assert cli.main([*config, "analyze", "--module", module], spark) == 0
        got = json.loads((folders / f"out/{module}_results.json").read_text())
        assert set(got) == {f"{module}.{k}" for k in analyses.MODULES[module]} and all(isinstance(v, list) for v in got.values())
    assert cli.main([*config, "visualize", "--plot", "hedging_comparison"], spark) == 0
    assert {r["x"] for r in json.loads((folders / "out/plots/hedging_comparison.json").read_text())["hedging_comparison"]} >= {"i think", "however"}
    assert cli.main([*config, "report"], spark) == 0
    text = (folders / "out/REPORT.md").read_text()
    assert sum(line.startswith("## ") for line in text.splitlines()) == 8 and "| claude |" in text and "Topics of one source" in text


@pytest.mark.parametrize("module", ["semantic", "comparative", "temporal", "structure"])
def test_modules_run(spark, folders, module):
    turns = as_turns(read_turns(spark, f"{folders}/processed/turns"))
    for name, df in analyses.run(turns, module).items():
        assert df.columns and df.collect() is not None, name


def test_charts_have_one_form(spark, folders):
    assert len(charts.CHARTS) == 21
    turns = as_turns(read_turns(spark, f"{folders}/processed/turns"))
    for name in ("topic_distribution", "rephrasing_rate", "style_fingerprint"):
        assert charts.CHARTS[name](turns).columns == ["series", "x", "y"]


def test_summary_of_two_sources(spark, folders):
    turns = as_turns(read_turns(spark, f"{folders}/processed/turns")).where("source <> 'gemini'")
    controlled = comparative.topic_controlled(turns, 0, [])
    got = {(r.metric, r.source): r for r in comparative.summary(turns, controlled=controlled).collect()}
    a, b = (got[("Mean response length (words)", s)] for s in ("chatgpt", "claude"))
    assert len(got) == 52 and abs(a.delta - (a.value - b.value)) < 1e-9 and a.note == ("Chatgpt" if a.value < b.value else "Claude") + ": More concise"
    assert got[("[Topic-ctrl] Response length", "claude")].value > 0


def test_stored_vectors_follow_the_text(spark, tmp_path):
    rows = lambda t: spark.createDataFrame([("s", "c", 0, "one two"), ("s", "c", 1, t)], "source string, conv_id string, turn_idx int, content string")
    a = semantic.stored_vectors(rows("three four"), f"{tmp_path}/v").orderBy("turn_idx").collect()
    b = semantic.stored_vectors(rows("five six"), f"{tmp_path}/v").orderBy("turn_idx").collect()
    assert a[0].vector == b[0].vector and a[1].vector != b[1].vector and spark.read.parquet(f"{tmp_path}/v").count() == 3


def test_broken_and_foreign_files(spark, tmp_path):
    (tmp_path / "a.json").write_text("[{oops")
    (tmp_path / "b.json").write_text(' {"uuid": "x"}')
    assert claude.read(spark, f"{tmp_path}/a.json").count() == 0 and broken(spark, f"{tmp_path}/a.json", claude.SCHEMA).count() == 1
    for source in (claude, chatgpt):
        with pytest.raises(ValueError):
            source.read(spark, f"{tmp_path}/b.json")


def test_sessions_stay_in_their_file(spark):
    cell = '<div class="outer-cell"><div class="content-cell body-1">Prompted hello there<br>Feb 1, 2026, 2:22:05 PM CST<br>answer</div></div>'
    df = spark.createDataFrame([(cell, "a"), (cell.replace("hello", "other"), "b")], "html string, file string")
    got = gemini.parse(df).where("turn_idx = 0").collect()
    assert len(got) >= 1 and gemini.parse(df.limit(1)).first().conversation_id == __import__("hashlib").sha256(b"gemini-2026-02-01T14:22:05-06:00").hexdigest()[:16]


def test_config():
    assert parsed("# x\na:\n  b: 1 # one\n  c: 'two'\n") == {"b": "1", "c": "two"} and load(None) == Config()


def test_ranged_sums_and_chunks(spark):
    rows = spark.range(5000).selectExpr("case when id % 3 = 0 then 'a' else 'b' end as g", "id as k", "id % 7 as n")
    a, b = (sorted(map(tuple, starts(rows, ["g"], "k", "n", most).collect())) for most in (10**6, 10))
    assert a == b
    turns = spark.range(300).selectExpr("'s' as source", "id div 3 as conv_id", "cast(id % 3 as int) as turn_idx", "array('x', 'y', concat('w', cast(id % 40 as string))) as t")
    toks = positioned(turns, F.col("t"), ["source"])
    assert [r.pos for r in toks.orderBy("pos").collect()] == list(range(900))
    assert stats.mattr(toks, ["source"], 50).first() == stats.mattr(toks, ["source"], 50, chunk=7).first()


def test_encoder_counts_words(spark):
    got = semantic.encode(spark.createDataFrame([("a a b",), ("",), (None,)], "content string"), 8).collect()
    assert sum(abs(x) for x in got[0].vector) in (1, 3) and got[1].vector == [0.0] * 8 and len(got) == 3


def test_density_is_a_density(spark):
    df = spark.createDataFrame([("s", float(v)) for v in (1, 2, 2, 3, 9)], "g string, v double")
    rows = stats.density(df, ["g"], "v", 2000, -20, 30).collect()
    assert abs(sum(r.y for r in rows) * 50 / 1999 - 1) < 1e-2
