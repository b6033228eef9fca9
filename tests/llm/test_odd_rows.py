"""Every operator on empty tables, null ids, repeated rows, ties, a very long text and columns of clashing names."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from turnwise.llm import op1_quality, op2_langid, op3_urls, op4_lm, op5_sentencepiece, op6_substring, op7_media, op8_simhash, op9_toxicity, op10_packing
from turnwise.session import ship_package

PATH = public_tokenizers.path
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string, cut string, gone string, spans string, doc string, key string, score string, fp string, `a.b` string, start string"
BASE = "the quick brown fox jumps over the lazy dog and then it runs away from all of them into the dark woods at night "


def rows():
    out = [(i, BASE + f"and tail{i} " * (i + 1)) for i in range(12)]
    out += [(None, None), (None, BASE), (3, out[3][1]), (3, out[3][1]), (50, ""), (51, "x " * 60_000), (52, " \t\n"), (53, "IDIOT scum " + BASE)]
    return [(i, t, "en" if t else None, "s", len(t or ""), "r", "c", "g", "sp", "d", "k", "sc", "fp", "dot", "st") for i, t in out]


@pytest.fixture(scope="module")
def docs(spark):
    ship_package(spark)
    return spark.createDataFrame(rows(), COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 3 > 0), int(i == 53)) for i in [*range(12), 53]] + [(3, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "quality": lambda d, y: op1_quality.judge(d, op1_quality.fit(d, y)),
    "language": lambda d, y: op2_langid.language_id(d),
    "urls": lambda d, y: op3_urls.judge(d.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"), "row", "key")),
    "lm": lambda d, y: op4_lm.lm_scores(d, PATH("byte_bpe_50k.tiktoken")),
    "pieces": lambda d, y: op5_sentencepiece.round_trip(d, PATH("piece_bpe_32k.model")),
    "substrings": lambda d, y: op6_substring.dedup(d),
    "media": lambda d, y: op7_media.media_features(d),
    "simhash": lambda d, y: op8_simhash.near_duplicates(d),
    "toxicity": lambda d, y: op9_toxicity.toxicity(d, y),
    "packing": lambda d, y: op10_packing.pack(d, PATH("byte_bpe_50k.json"), PATH("byte_bpe_50k.tiktoken")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_result_a_row(docs, labels, name):
    out = OPERATORS[name](docs, labels).collect()
    ids = sorted(((r[0] is None, r[0] or 0) for r in out))
    want = sorted((r[0] is None, r[0] or 0) for r in rows())
    assert (sorted(set(ids)) == sorted(set(want))) if name == "packing" else ids == want
    for r in out:
        assert "held_out" not in r or (r["held_out"] is True if r.doc_id is None else r["held_out"] is not None)
    if name not in ("packing", "simhash"):
        same = [tuple(round(x, 3) if isinstance(x, float) else x for x in r)[1:] for r in out if r[0] == 3]
        assert len(same) == 3 and len(set(same)) == 1


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(docs, labels, name):
    assert OPERATORS[name](docs.limit(0), labels.limit(0)).count() == 0


def test_filters_keep_all_columns(docs, labels):
    """The forms that the pipeline calls hand every other column through with its values."""
    forms = [
        op1_quality.kept(docs, op1_quality.fit(docs, labels)),
        op9_toxicity.kept(docs, op9_toxicity.fit(docs, labels)),
        op8_simhash.one_of_each(docs),
        op6_substring.deduplicated(docs),
        op6_substring.deduplicated(docs.where("doc_id < 12").dropDuplicates(["doc_id"])),
    ]
    for out in forms:
        assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
        got = out.collect()
        assert got and {tuple(r)[5:] for r in got} == {("r", "c", "g", "sp", "d", "k", "sc", "fp", "dot", "st")}
        assert all(r.n_chars == len(r.text or "") for r in got)


def test_stages_on_an_empty_table(spark, docs, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_sniffing_is_linear(spark):
    """Repeated magics, whose end marks are far or absent, cost one scan of the value."""
    import time

    began = time.time()
    for magic in (b"%PDF-", b"PK\x03\x04" + b"\0" * 30, b"\xff\xd8\xff\xda\x00\x02", b"GIF89a", b"\x1f\x8b\x08\x00" + b"\0" * 6, b"RIFF"):
        assert op7_media.finds(magic * (2_000_000 // len(magic))) == []
    assert time.time() - began < 60


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from turnwise.llm import common

    class Session:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})
        sparkContext = type("S", (), {"master": "spark://host:7077", "getCheckpointDir": staticmethod(lambda: None)})

    with pytest.raises(ValueError):
        common.shared_dir(Session)
