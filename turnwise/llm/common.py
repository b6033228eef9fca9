"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zlib
from contextlib import suppress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that separate words: space and 0x09-0x0D. ``bytes.split()`` cuts at exactly these.
SEPARATORS = " \t\n\x0b\f\r"
_CLEARED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session that names none gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="turnwise-"))
    return spark.sparkContext.getCheckpointDir()


def _own_dir(spark: SparkSession) -> str:
    """This application's folder below the shared one."""
    return f"{shared_dir(spark)}/turnwise-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    Results are lazy and may read such tables later, so they stay until ``drop_written``,
    ``drop_all_written`` or the end of the driver.
    """
    spark = df.sparkSession
    if spark.sparkContext.applicationId not in _CLEARED:
        _CLEARED.add(spark.sparkContext.applicationId)
        atexit.register(_at_end, spark)
    path = f"{_own_dir(spark)}/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_all_written(spark: SparkSession) -> None:
    """Delete all tables of this application; call it when its results have been read."""
    _delete(spark, _own_dir(spark))


def _at_end(spark: SparkSession) -> None:
    with suppress(Exception):  # the session may have ended before the driver
        drop_all_written(spark)


def drop_written(*frames: DataFrame) -> None:
    """Delete tables made by ``written`` that no later plan reads."""
    for df in frames:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _delete(spark, folder)


def fold(doc_id: Column, k: int) -> Column:
    """crc32 of the decimal text of ``doc_id``, modulo ``k``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % k


def held_out(doc_id: Column, k: int, held: int = 0) -> Column:
    """Whether a row is in the fold that nothing is learned from; rows without id are, in all operators."""
    return F.coalesce(fold(doc_id, k) == held, F.lit(True))


def fold_of(doc_id: int | None, k: int) -> int | None:
    """Python twin of ``fold``."""
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % k


def slices(batch, rows: int = 512):
    """Cut an Arrow batch so that only a few texts are Python objects at a time."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def bounded_sample(df: DataFrame, key: str, cap: int, by: str | None = None, salt: str = "sample") -> DataFrame:
    """About ``cap`` rows of ``df`` (of each value of ``by``), the same at every run, without a shuffle of rows.

    A row stays where the hash of its ``key`` is under the share cap / count. All rows
    stay where there are fewer than ``cap``. ``by`` must have few distinct values.
    """
    h = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(salt)), F.lit(1 << 30))
    if by is None:
        return df.where(h < F.lit(int(min(1.0, cap / max(1, df.count())) * (1 << 30))))
    keep = F.lit(False)
    for r in df.where(F.col(by).isNotNull()).groupBy(by).count().collect():
        keep = keep | ((F.col(by) == F.lit(r[by])) & (h < F.lit(int(min(1.0, cap / r["count"]) * (1 << 30)))))
    return df.where(keep)
