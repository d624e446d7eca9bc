"""Evaluation examples, leak-free splits, accuracy, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glosswork.functions import text as X
from glosswork.functions.alphabet import REJECT
from glosswork.operators import lexicon as L
from glosswork.operators import prompts as P
from glosswork.sources import store

RUN = 4096


def examples(lexicon: DataFrame) -> DataFrame:
    """One row for each polysemous form and sense whose example (its definition here) can be marked:
    synset_id, form, pos, sentence, marked."""
    rows = lexicon.join(L.bounded(L.polysemous(lexicon).select("form", "pos")), ["form", "pos"]).select("synset_id", "form", "pos", F.col("definition").alias("sentence"))
    return rows.withColumn("marked", X.mark_first(F.col("sentence"), F.col("form"))).where("marked IS NOT NULL")


def split(rows: DataFrame, n_eval: int, seed: int = 42, group: str = "synset_id") -> DataFrame:
    """Adds `part` (eval or bench): whole groups go to eval, in seeded order, while it has fewer than n_eval
    rows. The running sum is over groups: bucketed by key first, so no task orders all of them."""
    per = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).withColumn("k", X.key(seed, F.col(group)))
    per = per.withColumn("bucket", F.substring("k", 1, 3))
    upto = per.groupBy("bucket").agg(F.sum("n").alias("b"))
    before = F.coalesce(F.sum("b").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # 4,096 rows at most
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("bucket").orderBy("k", group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = per.join(F.broadcast(upto.select("bucket", before.alias("before"))), "bucket").select(group, F.when(F.col("before") + inside < n_eval, "eval").otherwise("bench").alias("part"))
    return rows.join(parts, group)


def accuracy(judged: DataFrame) -> DataFrame:
    """correct, seen, accuracy (0 when nothing was seen)."""
    return judged.agg(F.count_if("correct").alias("correct"), F.count(F.lit(1)).alias("seen"), F.coalesce(F.avg(F.col("correct").cast("double")), F.lit(0.0)).alias("accuracy"))


def numbered(rows: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """Adds idx, each row's place (from 0) in the order given.

    The rows are dealt by ranges and sorted once, and written with their place in their range: the ranges are those of the table from
    then on, for the counts as for the rows. Only the ranges' sizes, a row for each, are summed in one task.
    Rows that are equal in the order are dealt on by a hash of all columns and by their input, so that a value that many
    rows share has no task of its own. An order of equal rows is settled when the table is written.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plain = [f.name for f in rows.schema if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    ties = {"__tie": F.xxhash64(*plain), "__row": F.monotonically_increasing_id()}
    by = [*order, *ties]
    dealt = rows.withColumns(ties).repartitionByRange(parts, *by).sortWithinPartitions(*by)
    # in its upper bits the task's number, in its lower 33 the row's place in the task
    table = store.written(dealt.withColumn("__at", F.monotonically_increasing_id()).drop(*ties), "numbered")
    part, inside = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = table.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    return table.withColumn("__part", part).join(F.broadcast(base), "__part").withColumn("idx", F.col("__base") + inside).drop("__at", "__part", "__base")


def batches(rows: DataFrame, order: list[str], size: int = 32) -> DataFrame:
    """Adds idx (from 0, in the order given) and batch."""
    return numbered(rows, order).withColumn("batch", F.floor(F.col("idx") / size))


def length_buckets(rows: DataFrame, text: str, key: str, size: int = 4) -> DataFrame:
    """Adds len, idx and bucket: chunks of rows of similar length, told back by their key."""
    out = batches(rows.withColumn("len", F.length(text)), ["len", key], size)
    return out.withColumnRenamed("batch", "bucket")


def running_accuracy(judged: DataFrame, order: list[str], size: int = 32) -> DataFrame:
    """batch, correct, seen and the accuracy up to and with each batch. The running sum is inside runs of RUN batches; only one
    total for each run is summed in one task."""
    per = batches(judged, order, size).groupBy("batch").agg(F.count_if("correct").alias("c"), F.count(F.lit(1)).alias("n")).withColumn("run", F.floor(F.col("batch") / RUN))
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    base = per.groupBy("run").agg(F.sum("c").alias("c"), F.sum("n").alias("n")).select("run", *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"{x}0") for x in "cn"])
    upto = Window.partitionBy("run").orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    out = per.join(base, "run").select("batch", (F.col("c0") + F.sum("c").over(upto)).alias("correct"), (F.col("n0") + F.sum("n").over(upto)).alias("seen"))
    return out.withColumn("accuracy", F.col("correct") / F.col("seen"))


def mismatches(judged: DataFrame, order: list[str], most: int = 10) -> DataFrame:
    """The wrong rows among the first `most` (a report)."""
    return batches(judged, order, 32).where((~F.col("correct")) & (F.col("idx") < most)).drop("batch")


def seeded_order(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """Adds the row's place in a seeded shuffle."""
    return batches(rows.withColumn("k", X.key(seed, F.col(key))), ["k", key], 1).drop("batch", "k")


def eval_examples(examples_: DataFrame, lexicon: DataFrame, mask: str = P.MASK) -> DataFrame:
    """Prompts with the gold's letter; examples whose gold is no candidate, or with over 127 candidates, are
    left out."""
    asked = examples_.select("form", "pos").distinct().withColumn("query_id", F.struct("form", "pos"))
    senses = L.local_map(asked, lexicon)
    packed = P.gathered(senses, ["form", "pos"]).where(F.size("senses") <= REJECT)
    gold = examples_.join(L.bounded(packed), ["form", "pos"])
    at = F.array_position(F.transform("senses", lambda s: s["synset_id"]), F.col("synset_id")) - 1
    rows = gold.withColumn("at", at).where("at >= 0")
    return rows.select("synset_id", "form", "pos", "sentence", "marked", P.letter(F.col("at")).alias("answer"), P.render(F.col("form"), F.col("marked"), F.col("definitions"), mask=mask).alias("prompt"))
