"""Sources by name, and which of them a folder holds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from turnwise.sources import chatgpt, claude, gemini

SOURCES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"claude": claude.read, "gemini": gemini.read, "chatgpt": chatgpt.read}
#: Globs below the raw folder, the first with files counts.
FILES = {"claude": ["conversations.json"], "gemini": ["MyActivity.html", "*.html"], "chatgpt": ["conversations-*.json", "conversations.json"]}


def found(spark: SparkSession, raw: str) -> dict[str, str]:
    """Source name -> glob with files, through the file system that Spark reads from."""
    hadoop, out = spark._jvm.org.apache.hadoop.fs.Path, {}
    for name, globs in FILES.items():
        for g in globs:
            path = hadoop(f"{raw}/{name}/{g}")
            if path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path):
                out[name] = f"{raw}/{name}/{g}"
                break
    return out


def read_all(spark: SparkSession, raw: str) -> DataFrame | None:
    """Turns of all sources that the folder holds; others are skipped."""
    frames = [SOURCES[n](spark, p) for n, p in found(spark, raw).items()]  # no canonical file: the source is skipped
    out = frames[0] if frames else None
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
