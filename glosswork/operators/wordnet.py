"""A nested lexicon: synsets with their words, the words' forms, and the synset's examples.

synsets: nr (its place), synset_id, pos, definition, words (array of lemma and forms), examples (array of sentences).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glosswork.functions import text as X
from glosswork.operators import lexicon as L

WORDS = "array<struct<lemma:string,forms:array<string>>>"


def words(synsets: DataFrame) -> DataFrame:
    """nr, synset_id, pos, definition, examples, word_nr, lemma, forms: a row for each word of a synset."""
    rows = synsets.select("nr", "synset_id", "pos", "definition", "examples", F.posexplode("words").alias("word_nr", "w"))
    return rows.select("*", "w.lemma", "w.forms").drop("w")


def lexicon(synsets: DataFrame) -> DataFrame:
    """The flat lexicon (form, pos, ord, synset_id, definition) for look-ups by lemma; ranks follow the synsets' places."""
    rank = F.row_number().over(Window.partitionBy("lemma", "pos").orderBy("nr", "word_nr")) - 1
    rows = words(synsets).dropDuplicates(["lemma", "synset_id"])
    return rows.select(F.col("lemma").alias("form"), "pos", rank.alias("ord"), "synset_id", "definition")


def examples(synsets: DataFrame) -> DataFrame:
    """Every usable example: nr, word_nr, form_nr, example_nr, synset_id, form, lemma, pos, sentence, marked.

    Synsets without an example have none, nor have words of one synset in their part of speech; a form that can't be marked in a
    sentence gives no row for it. The order of the four numbers is the order of the nested lists.
    """
    rows = words(synsets)
    several = rows.groupBy("lemma", "pos").agg(F.countDistinct("synset_id").alias("n")).where("n > 1").select("lemma", "pos")
    rows = rows.where(F.size("examples") > 0).join(L.bounded(several), ["lemma", "pos"])
    rows = rows.select("nr", "word_nr", "synset_id", "lemma", "pos", "examples", F.posexplode("forms").alias("form_nr", "form"))
    rows = rows.select("nr", "word_nr", "form_nr", "synset_id", "form", "lemma", "pos", F.posexplode("examples").alias("example_nr", "sentence"))
    marked = X.mark_first(F.col("sentence"), F.col("form"))
    return rows.withColumn("marked", marked).where("marked IS NOT NULL").select("nr", "word_nr", "form_nr", "example_nr", "synset_id", "form", "lemma", "pos", "sentence", "marked")


def training_words(synsets: DataFrame) -> DataFrame:
    """Rows for `training.training_set`: for each lemma its synsets with definitions and examples. A synset's alternative definition
    is its own where the table has no column `alternative_definition`."""
    other = F.col("alternative_definition") if "alternative_definition" in synsets.columns else F.col("definition")
    rows = words(synsets.withColumn("definition", F.struct(F.col("definition").alias("source"), other.alias("other")))).dropDuplicates(["lemma", "synset_id"])
    order = F.row_number().over(Window.partitionBy("lemma").orderBy("nr", "word_nr")) - 1
    return rows.select(F.col("lemma").alias("word"), F.col("synset_id").alias("id"), "pos", F.col("definition.source").alias("source_definition"), F.col("definition.other").alias("alternative_definition"), "examples", order.alias("ord"))
