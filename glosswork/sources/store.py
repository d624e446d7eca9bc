"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list = []


def folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where a local session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _OWN:
        _OWN.append(tempfile.TemporaryDirectory(prefix="glosswork-"))
        atexit.register(_OWN[0].cleanup)
    return f"file://{_OWN[0].name}"


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder, reread: what it holds is settled, and a lost executor costs no
    more than reading it again."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
