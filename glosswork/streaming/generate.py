"""Training examples generated for a stream of forms, each once, also when a run is killed and started again.

A micro-batch's forms that are neither done nor in the skip list are looked up; one synset sends a form to the skip list, several make a
request. Requests are dealt over `workers` tasks, as many as may be open at once; answers are folded, parsed and written, one file a
word. Files are named when they are whole, the skip list is a set, and a batch's log is written over when the batch runs again, so whatever part of a batch
was done before it was killed, the next run does the rest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glosswork.sources import readers, sinks, store

WORKERS = 4
SKIP = "form string"
LOG = "form string, outcome string, message string"


def _text(spark: SparkSession, path: str) -> DataFrame:
    """A skip list that may not be there yet."""
    return readers.skip_list(spark, path) if _there(spark, path) else spark.createDataFrame([], SKIP)


def _there(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def existing(spark: SparkSession, path: str) -> DataFrame:
    """The words that have a file."""
    return readers.training_files(spark, path) if _there(spark, path) else spark.createDataFrame([], SKIP)


def answered(requests: DataFrame, answer: Callable[[str], Iterator[str]], workers: int = WORKERS) -> DataFrame:
    """form, content and message: the answer's NDJSON lines folded to their content, to the line that is done; or what went wrong."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for form, payload in zip(batch.column("form").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                lines, message = [], None
                try:
                    lines = list(answer(payload))
                except OSError as e:  # one request's failure is its own
                    message = str(e)
                yield pa.RecordBatch.from_arrays([pa.array([form]), pa.array([lines], pa.list_(pa.string())), pa.array([message], pa.string())], ["form", "lines", "message"])

    got = requests.select("form", "payload").repartition(workers, "form").mapInArrow(run, "form string, lines array<string>, message string")
    got = store.written(got, "answers")  # each request is sent once
    content = readers.folded(got.select(F.col("form").alias("stream_id"), F.posexplode("lines").alias("line_no", "value")))
    return got.select("form", "message").join(content.withColumnRenamed("stream_id", "form"), "form", "left")


def batch(forms: DataFrame, synsets: Callable[[DataFrame], DataFrame], answer: Callable[[str], Iterator[str]], model: str, words: str, skip: str, log: str, workers: int = WORKERS) -> None:
    """One micro-batch of forms. synsets: gives form, synset_id, pos, definition of forms. log: the folder of the batch's log (LOG): made,
    one synset, no synset, or failed with a message; forms that were done before aren't in it."""
    spark = forms.sparkSession
    asked = forms.where("form <> ''").select("form").distinct()
    todo = store.written(readers.pending(asked, _text(spark, skip), existing(spark, words)), "todo")
    found = store.written(synsets(todo).select("form", "synset_id", "pos", "definition").join(todo, "form"), "synsets")
    several, one = readers.split_by_senses(found)
    got = answered(sinks.requests(found.join(several, "form"), model), answer, workers)
    parsed = store.written(got.withColumn("senses", F.from_json("content", readers.TRAINING)), "parsed")
    good = parsed.where("message IS NULL AND size(senses) > 0")
    senses = good.select(F.col("form").alias("word"), F.posexplode("senses").alias("ord", "s")).select("word", "ord", "s.*")
    sinks.write_words(senses, words)
    none = todo.join(found, "form", "left_anti")
    failed = F.coalesce("message", F.lit("the answer is no list of senses"))
    lines = good.select("form", F.lit("made").alias("outcome"), F.lit(None).cast("string").alias("message"))
    lines = lines.unionByName(parsed.where("message IS NOT NULL OR coalesce(size(senses), 0) <= 0").select("form", F.lit("failed").alias("outcome"), failed.alias("message")))
    for rows, outcome in ((one, "one synset"), (none, "no synset")):
        lines = lines.unionByName(rows.select("form", F.lit(outcome).alias("outcome"), F.lit(None).cast("string").alias("message")))
    lines.write.mode("overwrite").parquet(log)
    sinks.append_skipped(one, skip)


def run(spark: SparkSession, source: str, synsets: Callable[[DataFrame], DataFrame], answer: Callable[[str], Iterator[str]], model: str, out: str, checkpoint: str, workers: int = WORKERS, **options) -> DataFrame:
    """Reads text files of forms, a line each, as a stream and works off what is there. out has words/, skip and log/batch=N. Gives the log,
    in which the last batch's line of a form stands. Failed forms are tried again when they come again."""
    stream = spark.readStream.options(**options).text(source).select(F.trim("value").alias("form"))

    def one(rows: DataFrame, number: int) -> None:
        batch(rows, synsets, answer, model, f"{out}/words", f"{out}/skip", f"{out}/log/batch={number}", workers)

    stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return outcomes(spark, out)


def outcomes(spark: SparkSession, out: str) -> DataFrame:
    last = Window.partitionBy("form").orderBy(F.desc("batch"))
    return spark.read.schema(f"{LOG}, batch int").parquet(f"{out}/log").withColumn("r", F.row_number().over(last)).where("r = 1").select("form", "outcome", "message")
