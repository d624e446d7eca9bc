"""The training-data pipeline: quality rules, near-duplicate removal, decontamination, mixing, sharding.

Each stage takes all rows that its predecessor kept and judges them on its own input; all but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glosswork.llm import decontamination, mixing, ngram_join, quality_rules, sharding
from glosswork.llm.registry import MIX_WEIGHTS, mix_levels
from glosswork.llm.shared import drop, place, sweep, table, tables

#: The share of the remaining tokens that the mixture takes, each document once at most: a mixture needs room to choose,
#: so a fifth of the tokens, those of the sources over their weights first, always goes.
MIX_BUDGET = 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor their host's verdict reject."""
    return quality_rules.kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each component of 0.75-similar documents."""
    return ngram_join.representatives(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of ten words with a benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each leaf's token-prefix of its first seeded epoch."""
    mixed = mixing.mix(docs, MIX_BUDGET, mix_levels(), MIX_WEIGHTS, epochs=1)
    return mixing.expanded(mixed).select(*docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its slot and shard."""
    return sharding.assign(docs)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("mixing sources to target weights", mixture),
    ("sharding", sharded),
]

#: Components of links and suffix arrays have no practical SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and reread."""
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        made = tables()
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = place(spark, f"stage-{i}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            # the stage's own tables and its input have served
            sweep(spark, made)
            if before:
                drop(spark, before)
            before = path
    return docs
