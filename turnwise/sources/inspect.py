"""What a raw folder holds: a preview of each source, from its first records only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.sources import chatgpt, claude, gemini
from turnwise.sources.html import text_of
from turnwise.sources.registry import found


def _json(spark: SparkSession, path: str) -> tuple[list[str], DataFrame]:
    raw = spark.read.json(path, multiLine=True)
    return raw.columns, raw


def preview(spark: SparkSession, raw: str, messages: int = 4, shown: int = 200) -> dict[str, dict]:
    """Source -> path, number of records, keys, and the first messages (role, text cut for display)."""
    out: dict[str, dict] = {}
    for name, path in found(spark, raw).items():
        if name == "gemini":
            cells = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(gemini.CELL), 1)).alias("cell"))
            texts = cells.select(F.substring(text_of(F.col("cell")), 1, shown).alias("t")).where("t like '%Prompted%'").limit(messages).collect()
            out[name] = {"path": path, "records": cells.count(), "keys": ["outer-cell"], "first": [("entry", r["t"]) for r in texts]}
            continue
        keys, rows = _json(spark, path)
        turns = (claude if name == "claude" else chatgpt).read(spark, path)
        first = turns.orderBy("conv_seq", "turn_idx").limit(messages).select("role", F.substring("content", 1, shown).alias("t")).collect()
        out[name] = {"path": path, "records": rows.count(), "keys": keys, "first": [(r["role"], r["t"]) for r in first]}
    return out
