"""Row numbers over all rows, and what is counted by them."""

import pytest
from pyspark.sql import functions as F

from glosswork.operators import corpus


@pytest.mark.parametrize(("rows", "parts"), [(5_000_000, 200), (1000, 64), (3, 8), (0, 4)])
def test_numbers_have_no_gap(spark, rows, parts):
    """Keys in a mixed order over many partitions: idx is 0..n-1, in the order of the keys."""
    df = spark.range(0, rows, 1, 16).select(((F.col("id") * 2_654_435_761) % 2**40).alias("k"), F.col("id"), F.lit("padding").alias("more"))
    out = corpus.numbered(df, ["k"], parts)
    got = out.agg(F.count(F.lit(1)), F.countDistinct("idx"), F.min("idx"), F.max("idx"), F.countDistinct("k")).first()
    assert tuple(got) == ((rows, rows, 0, rows - 1, rows) if rows else (0, 0, None, None, 0))
    # the row before by key is the one before by number: sums over neighbours that are joined by number
    wrong = out.alias("a").join(out.alias("b"), F.col("a.idx") == F.col("b.idx") - 1).where("a.k >= b.k").count()
    assert wrong == 0


def test_numbers_are_the_same_for_every_reader(spark):
    df = spark.range(0, 300_000, 1, 7).select((F.hash("id") % 1000).alias("k"), "id")
    out = corpus.numbered(df, ["k"], 50)
    once, again = (out.agg(F.sum(F.xxhash64("k", "id", "idx").cast("decimal(38,0)"))).first()[0] for _ in range(2))
    assert once == again and out.select("idx").distinct().count() == 300_000


def test_a_shared_key_is_dealt_on(spark, tmp_path, monkeypatch):
    """A key of half of the rows has no task of its own; equal rows have numbers of their own."""
    df = spark.range(0, 200_000, 1, 8).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("k"), F.lit("x").alias("t"))
    monkeypatch.setattr(corpus.store, "place", lambda *_: f"{tmp_path}/numbered")
    out = corpus.numbered(df, ["k"], 20)
    assert out.select("idx").distinct().count() == 200_000
    sizes = [r["count"] for r in spark.read.parquet(f"{tmp_path}/numbered").groupBy(F.input_file_name()).count().collect()]
    assert max(sizes) < 40_000


def test_length_buckets_and_nulls(spark):
    df = spark.createDataFrame([("a", "xx"), ("b", None), ("c", "x"), ("d", "yy"), (None, "x")], "key string, text string")
    got = [(r["key"], r["idx"], r["bucket"]) for r in corpus.length_buckets(df, "text", "key", 2).orderBy("idx").collect()]
    assert got == [("b", 0, 0), (None, 1, 0), ("c", 2, 1), ("a", 3, 1), ("d", 4, 2)]
    assert [r["idx"] for r in corpus.seeded_order(df.select("key"), "key", 1).orderBy("idx").collect()] == [0, 1, 2, 3, 4]
