"""Queries of the operators in this subpackage, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.llm import cotraining, decontamination, fill_middle, lm_scoring, mixing, ngram_join, oracle, quality_rules, sharding, substring_dedup, token_alignment, token_files, url_filters, warc
from glosswork.llm.shared import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the digests the number of longest matches, and the longest of them with its places (of equal ones the first item's,
    then the first in it, then in the document)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontamination.scan(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    first = F.array_min(F.transform("spans", lambda s: F.struct((-s["n_words"]).alias("less"), s["item_id"].alias("item"), s["item_start"].alias("at"), s["doc_start"].alias("start"))))
    out = out.withColumn("x", first).withColumn("n_spans", F.size("spans").cast("long")).drop("spans")
    columns = {"longest_words": -F.col("x.less"), "longest_item_start": F.col("x.at"), "longest_doc_start": F.col("x.start")}
    return out.withColumn("longest_item", F.col("x.item")).withColumns({k: v.cast("long") for k, v in columns.items()}).drop("x")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.joined(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return quality_rules.judged(docs).select("doc_id", *quality_rules.MEASURES, "base_failed", "kept")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    return cotraining.classified(docs, table(spark, sf_dir, "labels"), good)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents").select("doc_id", "text"), across=True)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_files.encoded_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.removed(docs).drop("spans")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    # a page's number is the id of the document that was taken from it
    number = F.regexp_extract(url_filters.path_of(F.col("url")), r"/([0-9]+)(?:\.[A-Za-z0-9]+)?/?\z", 1).try_cast("bigint")
    pages = pages.withColumn("doc_id", number).join(labels, "doc_id", "left")
    return url_filters.judged(pages, F.col("bad")).select("page_id", "host", "path", "template", F.round("purity", 6).alias("purity"), "rule", "verdict")


def mix_levels() -> dict:
    number = F.regexp_extract("source", r"([0-9]+)", 1).try_cast("int")
    return {"domain": F.concat(F.lit("domain"), F.coalesce(number % 4, F.lit(0)).cast("string")), "lang": F.col("lang"), "source": F.col("source")}


MIX_WEIGHTS = {"domain": {"domain0": 2.0, "domain1": 1.0, "domain2": 1.0, "domain3": 1.0}, "lang": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 1.0}}


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    out = mixing.mix(docs, 1.0, mix_levels(), MIX_WEIGHTS)
    return out.select("doc_id", "lang", "source", "mix_tokens", "mix_copies")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents").select("doc_id")).select("doc_id", F.col("slot").cast("long").alias("slot"), "shard")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_middle.transformed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = fill_middle.restored(F.col("fim_text"), F.col("fim_form"))
    return rows.select(
        "doc_id", F.col("fim_units").alias("n"), F.col("fim_form").alias("form"), F.col("fim_prefix_chars").alias("prefix_chars"), F.col("fim_middle_chars").alias("middle_chars"),
        F.sha2("fim_text", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"),
    )


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return oracle.sql()
