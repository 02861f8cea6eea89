"""Results that several parts of a query read, written once to the folder that the cluster shares."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or (unset, as in tests) the session's checkpoint folder or one under the warehouse."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows of df from a written table: its plan runs once, however many parts of a query read it, and lost
    executors lose nothing of it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
