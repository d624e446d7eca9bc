"""Tables written to the folder that driver and executors share, and small helpers for plans."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []
_TABLES: list[str] = []


def folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Where the session names none, a local session (tests) gets a temporary one;
    on a cluster that is an error, as its machines do not share a local folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _OWN:
        keep = tempfile.TemporaryDirectory(prefix="glosswork-")
        atexit.register(keep.cleanup)
        _OWN.append(f"file://{keep.name}")
    return _OWN[0]


#: Spark removes the shuffle files of a query when it ends; nothing reads them again, as the query's result is a table.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder, reread: lineage ends there, and a lost
    executor costs no more than reading it again."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    _TABLES.append(path)
    return out


def tables() -> int:
    """How many tables `written` has made so far, for `sweep`."""
    return len(_TABLES)


def sweep(spark: SparkSession, since: int) -> None:
    """Removes the tables made since `tables` gave that number; for when a result that reads them is stored itself."""
    for path in _TABLES[since:]:
        drop(spark, path)
    del _TABLES[since:]


def forget(df: DataFrame | None) -> None:
    """Removes the table of a frame that `written` returned; other frames are left alone. Nothing may read it again."""
    path = getattr(df, "_written", None)
    if path:
        drop(df.sparkSession, path)
        if path in _TABLES:
            _TABLES.remove(path)


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def drop(spark: SparkSession, path: str) -> None:
    """Removes a path of the shared folder."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, most: int = 200_000) -> DataFrame:
    """The frame, marked for broadcast if a count shows that it has at most `most` rows; else as it is,
    for a join by shuffle. The frame should be a written table, as it is read twice."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def most_frequent(df: DataFrame, key: str, count: str, most: int, *more: str):
    """At most `most` of the keys with the greatest counts, as an Arrow table (key, count, more), and whether these
    are all. The least count that still fits is found from a table of how many keys have each count (in
    1,000 steps a power of ten), so that no task sorts all keys."""
    step = F.floor(F.log10(F.greatest(F.col(count), F.lit(1)).cast("double")) * 1000).cast("int")
    steps = sorted(((r["s"], r["n"]) for r in df.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    taken, least = 0, None
    for s, n in steps:
        if taken + n > most:
            break
        taken, least = taken + n, s
    rows = df.select(key, count, *more)
    rows = rows.where(F.lit(False)) if least is None else rows.where(step >= least)
    return rows.toArrow(), taken == sum(n for _, n in steps)
