"""Export files that hold one JSON array each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORRUPT = "_corrupt_record"


def only_arrays(spark: SparkSession, path: str) -> None:
    """Raise where a file's first sign (after blanks and a byte order mark) is no bracket; one sign of each file is read."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.globStatus(place) or ():
        stream = fs.open(status.getPath())
        try:
            sign = stream.read()
            while sign in (9, 10, 13, 32, 0xEF, 0xBB, 0xBF):
                sign = stream.read()
        finally:
            stream.close()
        if sign == ord("{"):
            raise ValueError(f"{status.getPath()} holds an object, not an array of conversations")


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of all files; a file that can't be parsed is left out."""
    raw = spark.read.schema(f"{schema}, {CORRUPT} string").json(path, multiLine=True, columnNameOfCorruptRecord=CORRUPT)
    return raw.where(f"{CORRUPT} is null").drop(CORRUPT)


def broken(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, record) of what ``records`` left out: to be kept aside and looked at."""
    raw = spark.read.schema(f"{schema}, {CORRUPT} string").json(path, multiLine=True, columnNameOfCorruptRecord=CORRUPT)
    raw = raw.withColumn("file", F.input_file_name()).persist()  # Spark won't read the bad record alone
    return raw.where(f"{CORRUPT} is not null").selectExpr("file", f"{CORRUPT} as record")
