"""Activity logs in HTML: one outer cell an exchange, grouped to sessions by gap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnwise.functions import text as T
from turnwise.sources.html import decoded, markdown_of, text_of
from turnwise.sources.sessions import sessionise
from turnwise.sources.turns import finish

STAMP = r"^([A-Z][a-z]{2} \d{1,2}, \d{4}, \d{1,2}:\d{2}:\d{2} [AP]M)(?: ([A-Z]{2,5}))?$"
CELL = r'(?s)<div class="outer-cell\b(.*?)(?=<div class="outer-cell\b|\z)'
#: Hours from UTC of the zones that logs name; any other counts as UTC.
ZONES = {"UTC": 0, "GMT": 0, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7}


def offset(zone: Column) -> Column:
    out = F.lit(0)
    for name, hours in ZONES.items():
        out = F.when(zone == name, F.lit(hours)).otherwise(out)
    return out


def parse(raw: DataFrame, gap_minutes: int = 60) -> DataFrame:
    """Turns from rows (html) or (html, file): a whole log each. Sessions don't reach from one file into another."""
    raw = raw if "file" in raw.columns else raw.withColumn("file", F.sha2("html", 256))
    cells = raw.select("file", F.posexplode(F.regexp_extract_all("html", F.lit(CELL), 1)).alias("i", "cell"))
    body = cells.select("file", "i", F.regexp_extract("cell", r'(?s)<div class="content-cell[^"]*"[^>]*>(.*?)</div>', 1).alias("body"))
    parts = body.select("file", "i", F.transform(F.split("body", r"(?i)<br\s*/?>"), lambda p: F.regexp_replace(T.strip(decoded(p)), rf"[{T.SPACE}]+", " ")).alias("lines"), F.split("body", r"(?i)<br\s*/?>").alias("raw")).where(F.element_at("lines", 1).startswith("Prompted"))
    at = parts.withColumn("k", F.array_position(F.transform("lines", lambda x: x.rlike(STAMP)), True)).where("k > 0")
    stamp = F.get("lines", F.col("k").cast("int") - 1)  # no error where k is 0, should the filter run later
    local = F.try_to_timestamp(F.regexp_extract(stamp, STAMP, 1), F.lit("MMM d, yyyy, h:mm:ss a"))
    hours = offset(F.regexp_extract(stamp, STAMP, 2))
    asked = F.transform(F.slice("raw", 1, F.greatest(F.col("k").cast("int") - 1, F.lit(0))), lambda x: T.strip(text_of(x)))
    asked = F.filter(asked, lambda x: ~x.rlike(rf"^Attached[{T.SPACE}]+\d+[{T.SPACE}]+files?") & ~x.rlike(rf"^-[{T.SPACE}]"))
    asked = F.filter(F.transform(asked, lambda x: F.regexp_replace(x, rf"^Prompted(?:[{T.SPACE}]+|$)", "")), lambda x: x != "")
    prompt = T.strip(F.array_join(asked, " "))
    answer = T.strip(markdown_of(F.array_join(F.slice("raw", F.col("k").cast("int") + 1, F.size("raw")), "<br>")))
    rows = at.select("file", "i", prompt.alias("prompt"), answer.alias("answer"), (local - F.make_dt_interval(hours=hours)).alias("ts"), hours.alias("hours"), local.alias("local")).where("ts is not null and prompt <> '' and answer <> ''")
    w = Window.partitionBy("file", "session")
    iso = F.concat(F.date_format("local", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("hours") < 0, "-").otherwise("+"), F.lpad(F.abs("hours").cast("string"), 2, "0"), F.lit(":00"))
    conv = sessionise(rows, ["file"], "ts", ["i"], gap_minutes).withColumns({"first": F.min_by(iso, F.struct("ts", "i")).over(w), "title": F.min_by("prompt", F.struct("ts", "i")).over(w), "created_at": F.min("ts").over(w), "updated_at": F.max("ts").over(w)})
    title = F.when(F.length("title") > 80, F.concat(F.substring("title", 1, 80), F.lit("…"))).otherwise(F.col("title"))
    two = F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content")))
    turns = conv.select(F.substring(F.sha2(F.concat(F.lit("gemini-"), "first"), 256), 1, 16).alias("conversation_id"), title.alias("title"), "created_at", "updated_at", "ts", "i", F.posexplode(two).alias("j", "t"))
    return finish(turns.select(F.lit("gemini").alias("source"), "conversation_id", "title", "created_at", "updated_at", F.struct("ts", -F.col("i"), "j").alias("at"), "t.role", "t.content", "ts"))


def read(spark: SparkSession, path: str, gap_minutes: int = 60) -> DataFrame:
    return parse(spark.read.text(path, wholetext=True).select(F.col("value").alias("html"), F.input_file_name().alias("file")), gap_minutes)
