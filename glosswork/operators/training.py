"""Training examples: one for each usable sentence of a sense, one reject example for each word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glosswork.functions import text as X
from glosswork.functions.alphabet import LETTERS, REJECT
from glosswork.operators import lexicon as L
from glosswork.operators import prompts as P

SEED = 42
IGNORE = -100
PAD = 0
MAX_LENGTH = 2048  # ids of an example, as in the reference


def _options(words: DataFrame, seed: int, by: list[str]) -> DataFrame:
    """For each target synset of a word the definitions of the word's synsets with the same pos (exactly the
    same: a and s differ here), each its source or alternative by a seeded draw, in one seeded order."""
    other = words.select("word", "pos", F.col("id").alias("option_id"), "source_definition", "alternative_definition")
    rows = words.select("word", "pos", "id").join(other, ["word", "pos"])
    draw = X.number(X.key(seed, "pick", F.col("word"), F.col("id"), F.col("option_id")), 2)
    definition = F.when(draw == 0, F.col("source_definition")).otherwise(F.col("alternative_definition"))
    rank = F.row_number().over(Window.partitionBy("word", "pos", "id").orderBy(X.key(seed, "order", F.col("word"), F.col("id"), F.col("option_id")), "option_id")) - 1
    rows = rows.select("word", "pos", "id", "option_id", definition.alias("definition"), rank.alias("ord"))
    packed = F.array_sort(F.collect_list(F.struct("ord", "option_id", "definition")))
    return rows.groupBy("word", "pos", "id").agg(packed.alias("options")).where(F.size("options") <= REJECT)


def _sentences(words: DataFrame) -> DataFrame:
    rows = words.select("word", "pos", "id", F.posexplode("examples").alias("nr", "sentence"))
    return rows.withColumn("marked", X.mark_first(F.col("sentence"), F.col("word"))).where("marked IS NOT NULL")


def sense_examples(words: DataFrame, seed: int = SEED, mask: str = P.MASK) -> DataFrame:
    """words: word, id, pos, source_definition, alternative_definition, examples. A row for each sentence
    that can be marked, its options starting at a letter drawn for the sentence."""
    rows = _sentences(words).join(_options(words, seed, ["id"]), ["word", "pos", "id"])
    n = F.size("options")
    offset = X.number(X.key(seed, "offset", F.col("word"), F.col("id"), F.col("nr")), (REJECT - n + 1).cast("long")).cast("int")
    rows = rows.withColumn("offset", offset)
    at = F.array_position(F.transform("options", lambda o: o["option_id"]), F.col("id")) - 1
    text = P.render(F.col("word"), F.col("marked"), F.transform("options", lambda o: o["definition"]), F.col("offset"), mask)
    return rows.select("word", F.col("id").alias("synset_id"), "nr", "sentence", "marked", P.letter(at + F.col("offset")).alias("answer"), text.alias("prompt"))


def majority(words: DataFrame) -> DataFrame:
    """word, pos of the most synsets; of equal ones the first listed."""
    per = words.groupBy("word", "pos").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    rank = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("n"), "first"))
    return per.withColumn("r", rank).where("r = 1").select("word", "pos", "n")


def reject_examples(words: DataFrame, seed: int = SEED, mask: str = P.MASK) -> DataFrame:
    """At most one row a word: a seeded sentence of another part of speech under the majority's definitions;
    no option fits, so the answer is the last letter."""
    major = majority(words).select("word", F.col("pos").alias("major"))
    pick = Window.partitionBy("word").orderBy(X.key(seed, "reject", F.col("word"), F.col("id"), F.col("nr")), "id", "nr")
    sentence = _sentences(words).join(major, "word").where("pos <> major").withColumn("r", F.row_number().over(pick)).where("r = 1")
    draw = X.number(X.key(seed, "rejectpick", F.col("word"), F.col("id")), 2)
    shown = words.join(major, "word").where("pos = major").withColumn("definition", F.when(draw == 0, F.col("source_definition")).otherwise(F.col("alternative_definition")))
    rank = F.row_number().over(Window.partitionBy("word").orderBy(X.key(seed, "rejectorder", F.col("word"), F.col("id")), "id")) - 1
    shown = shown.withColumn("o", rank).groupBy("word").agg(F.array_sort(F.collect_list(F.struct("o", "definition"))).alias("options")).where(F.size("options") <= REJECT)
    rows = sentence.join(shown, "word")
    offset = X.number(X.key(seed, "rejectoffset", F.col("word")), (REJECT - F.size("options") + 1).cast("long")).cast("int")
    text = P.render(F.col("word"), F.col("marked"), F.transform("options", lambda o: o["definition"]), offset, mask)
    return rows.select("word", F.concat("id", F.lit("_none")).alias("synset_id"), "nr", "sentence", "marked", F.lit(LETTERS[REJECT]).alias("answer"), text.alias("prompt"))


def training_set(words: DataFrame, seed: int = SEED, mask: str = P.MASK) -> DataFrame:
    return sense_examples(words, seed, mask).unionByName(reject_examples(words, seed, mask))


def words_of(lexicon: DataFrame) -> DataFrame:
    """Training words made of a lexicon: the alternative definition is the definition in reverse word
    order, and the sentences are the definition and its halves."""
    parts = F.split("definition", " ")
    half = F.floor(F.size(parts) / 2).cast("int")
    sentences = F.array(F.col("definition"), F.array_join(F.slice(parts, F.lit(1), half), " "), F.array_join(F.slice(parts, half + 1, F.size(parts)), " "))
    order = F.row_number().over(Window.partitionBy("form").orderBy("synset_id")) - 1
    return lexicon.select(F.col("form").alias("word"), F.col("synset_id").alias("id"), "pos", F.col("definition").alias("source_definition"), F.array_join(F.reverse(parts), " ").alias("alternative_definition"), sentences.alias("examples"), order.alias("ord"))


def encoded(ids: Column, answer: Column, mask_id: int, most: int) -> dict[str, Column]:
    """input ids cut to `most`, attention mask, labels (ignored but at the first mask), and whether the mask
    survived."""
    cut = F.slice(ids, F.lit(1), F.lit(most))
    at = F.array_position(cut, mask_id)
    labels = F.transform(cut, lambda x, i: F.when(i + 1 == at, F.instr(F.lit(LETTERS), answer) - 1).otherwise(IGNORE))
    return {"input_ids": cut, "attention_mask": F.transform(cut, lambda x: F.lit(1)), "labels": labels, "kept": at > 0}


def padded(rows: DataFrame, batch: str = "batch") -> DataFrame:
    """Pads the three lists of each batch's rows to its longest."""
    longest = F.max(F.size("input_ids")).over(Window.partitionBy(batch))
    rows = rows.withColumn("__n", longest)
    fill = {"input_ids": PAD, "attention_mask": 0, "labels": IGNORE}
    return rows.withColumns({c: F.concat(c, F.array_repeat(F.lit(v), F.col("__n") - F.size(c))) for c, v in fill.items()}).drop("__n")
