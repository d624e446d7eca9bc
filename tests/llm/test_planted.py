"""Verdicts of hosts and templates planted over the tables: those that are bad are caught, the others stay."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from glosswork.llm import quality_rules, url_filters
from glosswork.llm.shared import table

DATA = "/root/testdata/sf0.1"


def labelled(spark):
    """The pages with the labels of the documents whose numbers they bear, as the query joins them."""
    pages = table(spark, DATA, "pages").select("page_id", "url")
    labels = table(spark, DATA, "labels").groupBy("doc_id").agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    number = F.regexp_extract(url_filters.path_of(F.col("url")), r"/([0-9]+)(?:\.[A-Za-z0-9]+)?/?\z", 1).try_cast("bigint")
    return pages.withColumn("doc_id", number).join(labels, "doc_id", "left").select("page_id", "url", "bad", F.lit("own").alias("kind"))


def test_planted_templates(spark):
    """20 hosts of 400 pages: in ten of them one template in four is bad for nine in ten of its labelled pages; all other labels are bad as often as
    the tables' own."""
    own = labelled(spark)
    rate = own.agg(F.avg(F.col("bad").cast("double"))).first()[0]
    spot = F.col("id") % 4
    spoilt = (F.floor(F.col("id") / 400) % 2 == 0) & (spot == 0)
    draw = lambda salt: F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(1000)) / 1000
    word = F.element_at(F.array(*map(F.lit, ("offers", "news", "blog", "wiki"))), (spot + 1).cast("int"))
    url = F.format_string("http://host%d.planted.org/%s/%d/page", F.floor(F.col("id") / 400).cast("int"), word, F.col("id"))
    bad = F.when(draw("label") < 0.6, draw("bad") < F.when(spoilt, 0.9).otherwise(rate))
    planted = spark.range(20 * 400).select((F.col("id") + 10**9).alias("page_id"), url.alias("url"), bad.alias("bad"), F.when(spoilt, "bad").otherwise("good").alias("kind"))
    pages = own.unionByName(planted)
    out = url_filters.judged(pages, F.col("bad"), keep=("page_id", "kind")).where("rule IS NULL")
    got = {(r["kind"], r["verdict"]): r["count"] for r in out.groupBy("kind", "verdict").count().collect()}
    share = lambda kind: got.get((kind, "block"), 0) / (got.get((kind, "block"), 0) + got.get((kind, "allow"), 0))
    assert share("bad") >= 0.9 and share("good") <= 0.05 and share("own") <= 0.05, got


@pytest.mark.parametrize(("share", "least"), [(0.9, 0.9), (0.4, 0.9)])
def test_planted_hosts(spark, share, least):
    """Ten hosts of 100 documents of which a share is full of symbols, ten of as many that aren't, over the documents' own hosts."""
    docs = table(spark, DATA, "documents").select("doc_id", "source", "text")
    sound = quality_rules.judged(docs).where("kept").select("doc_id").distinct().join(docs.select("doc_id", "text"), "doc_id")
    rows = sound.withColumn("n", F.row_number().over(Window.orderBy("doc_id")) - 1).where("n < 2000")
    host = F.floor(F.col("n") / 100).cast("int")
    spoilt = (host < 10) & (F.pmod(F.xxhash64("doc_id"), F.lit(1000)) / 1000 < share)
    text = F.when(spoilt, F.concat("text", F.repeat(F.lit(" ##$$"), F.length("text")))).otherwise(F.col("text"))
    planted = rows.select((F.col("doc_id") + 10**9).alias("doc_id"), F.format_string("planted%d", host).alias("source"), text.alias("text"), F.when(host < 10, F.when(spoilt, "spoilt").otherwise("beside")).otherwise("good").alias("kind"))
    out = quality_rules.judged(docs.withColumn("kind", F.lit("own")).unionByName(planted))
    got = {r["kind"]: r for r in out.where("NOT base_failed").groupBy("kind").agg(F.avg(F.col("kept").cast("double")).alias("kept"), F.count(F.lit(1)).alias("n")).collect()}
    failing = out.where("kind = 'spoilt'").agg(F.avg((~F.col("kept")).cast("double"))).first()[0]
    assert failing >= least and got["good"]["kept"] >= 0.95 and got["own"]["kept"] >= 0.99, got


def test_counts_on_the_tables(spark):
    """What README says of the tables themselves: labels hold no sign of a host or template, so nothing but the fixed rules blocks."""
    out = url_filters.judged(labelled(spark), F.col("bad")).where("rule IS NULL")
    assert out.where("verdict = 'block'").count() == 0 and out.count() > 1000
