"""What several operators share: the shared folder, text columns and ASCII word rules."""

from __future__ import annotations

import os
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or (unset, as in tests) the
    session's checkpoint folder or one under the warehouse."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
        spark.sparkContext.setCheckpointDir(named)
    if "://" in named or named.startswith("file:"):
        return named
    system = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    # without a scheme a path is the cluster's default file system's, as it is for Spark itself
    return ("file://" if system.startswith("file:") else system.rstrip("/")) + os.path.abspath(named)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """The rows of df, from a table written to the shared folder: later reads neither recompute nor lose them."""
    return written_at(df, scratch(df.sparkSession, name), codec)


def written_at(df: DataFrame, path: str, codec: str = "zstd") -> DataFrame:
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def documents(docs: DataFrame) -> DataFrame:
    """doc_id and the whole text (null: empty); other columns, whatever their names, are left behind."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))


def remainder(doc_id: Column, m: int) -> Column:
    """crc32(doc_id as text) mod m; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m


def remainder_of(doc_id: int | None, m: int) -> int:
    """remainder() for one id inside a task."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % m


def words_of(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased, as UTF-8: bytes.lower and bytes.split know
    the ASCII letters and exactly these separators."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()
