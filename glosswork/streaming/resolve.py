"""Documents as a stream, resolved micro-batch by micro-batch with the batch's own plan.

Words are looked up and counted inside their text's row, or, with a lexicon that tasks can't hold, exploded and joined with the senses and with an
inverted index of the definitions (word to synsets): bytes and time grow with a text's length. Each micro-batch has a folder of its own under `out`, written over if the batch runs
again, so that a killed stream that starts anew gives each document once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.operators import resolve as R
from glosswork.sources import store


def resolved(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """docs: doc_id, text. One row for each distinct content word of a document: doc_id, form, pos, synset_id (null if
    rejected), confidence."""
    out = R.predicted(docs, lexicon)
    return out.select("doc_id", "form", "pos", F.when(~F.col("rejected"), F.col("synset_id")).alias("synset_id"), "confidence")


def run(spark: SparkSession, source: str, schema: str, lexicon: DataFrame, out: str, checkpoint: str, **options) -> None:
    """Reads Parquet files as a stream, resolves what is there, and writes each micro-batch to `out`. options: the file source's."""
    settled = store.written(lexicon, "lexicon")  # one lexicon for all micro-batches

    def resolve(rows: DataFrame, batch: int) -> None:
        resolved(rows, settled).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    stream = spark.readStream.schema(schema).options(**options).parquet(source).select("doc_id", "text")
    query = stream.writeStream.foreachBatch(resolve).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def results(spark: SparkSession, out: str) -> DataFrame:
    """What a stream has written so far."""
    return spark.read.parquet(out).drop("batch")
