"""The lexicon as a table, and look-ups in it.

A lexicon is a frame of form, pos (n v a s r), ord (the sense's rank from 0), synset_id and definition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

POS = "nvasr"
MOST_BROADCAST = 1_000_000
MOST_BYTES = 256 << 20
HEAVY = 1000
SALT = 32
# Universal parts of speech of content words, and the lexicon's codes for them.
RECODED = {"NOUN": "n", "PROPN": "n", "NUM": "n", "INTJ": "n", "VERB": "v", "ADJ": "a", "ADV": "r"}
UNIVERSAL = {"n": "NOUN", "v": "VERB", "a": "ADJ", "s": "ADJ", "r": "ADV"}


def recode(pos) -> "F.Column":
    """The lexicon's part of speech of a universal one; null for words without content."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in RECODED.items() for x in kv]), pos)


def universal(pos) -> "F.Column":
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in UNIVERSAL.items() for x in kv]), pos)


def bounded(df: DataFrame, most: int = MOST_BROADCAST, bytes_: int = MOST_BYTES) -> DataFrame:
    """The frame marked for broadcast if it has at most `most` rows and its texts, arrays and numbers, measured, at most `bytes_` bytes;
    else as it is."""
    few = df.limit(most + 1)
    size = F.lit(16 + 8 * len(df.columns))
    for f in df.schema:
        kind = f.dataType.simpleString()
        if kind in ("string", "binary"):
            size += F.coalesce(F.octet_length(f.name), F.lit(0))
        elif kind.startswith(("array", "struct", "map")):
            size += F.coalesce(F.octet_length(F.to_json(F.struct(f.name))), F.lit(0))
    n, total = few.agg(F.count(F.lit(1)), F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()
    return F.broadcast(df) if n <= most and total <= bytes_ else df


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], most: int = MOST_BROADCAST, bytes_: int = MOST_BYTES) -> DataFrame:
    """The rows with the table's columns, null where it has no such keys (which it has several times where several rows match).

    A table that is small enough is broadcast. Of a larger one, the rows of the keys that over one in HEAVY of the rows ask for are
    joined apart: their rows are dealt over SALT places each, and the table's rows for them, whose keys are HEAVY at most, are
    given to every place. The others are joined by shuffle.
    """
    small = bounded(table, most, bytes_)
    if small is not table:
        return rows.join(small, keys, "left")
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total = rows.count()
    hot = F.broadcast(counts.where(F.col("__n") * HEAVY > total).select(*keys, F.lit(True).alias("__hot")))
    salts = F.array(*[F.lit(i) for i in range(SALT)])
    spread = F.coalesce("__hot", F.lit(False))
    for k in keys:  # a null finds nothing, in any place
        spread |= F.col(k).isNull()
    told = rows.join(hot, keys, "left").withColumn("__salt", F.when(spread, F.pmod(F.monotonically_increasing_id(), F.lit(SALT)).cast("int")).otherwise(0))
    dealt = table.join(hot, keys, "left").withColumn("__salt", F.explode(F.when(F.col("__hot"), salts).otherwise(F.array(F.lit(0))))).drop("__hot")
    return told.drop("__hot").join(dealt, [*keys, "__salt"], "left").drop("__salt")


def derived(benchmark: DataFrame) -> DataFrame:
    """A lexicon made of short texts: an item is a synset, its text the definition, and each of its
    ASCII words of four letters or more a form."""
    words = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), F.lower))
    pos = F.substring(F.lit(POS), (F.col("item_id") % 5 + 1).cast("int"), F.lit(1))
    rows = benchmark.select("item_id", pos.alias("pos"), F.col("text").alias("definition"), F.explode(F.filter(words, lambda w: w.rlike("^[a-z]{4,}$"))).alias("form"))
    rank = F.row_number().over(Window.partitionBy("form", "pos").orderBy("item_id")) - 1
    return rows.select("form", "pos", rank.alias("ord"), F.concat(F.lit("syn-"), F.lpad(F.col("item_id").cast("string"), 8, "0"), F.lit("-"), "pos").alias("synset_id"), "definition")


def forms(lexicon: DataFrame) -> DataFrame:
    return lexicon.select("form").distinct()


def lookup(queries: DataFrame, lexicon: DataFrame) -> DataFrame:
    """queries (query_id, form, pos) with their senses in rank order; one row of nulls where there is none."""
    return looked_up(queries, lexicon, ["form", "pos"]).select("query_id", "form", "pos", "ord", "synset_id", "definition")


def expanded(queries: DataFrame) -> DataFrame:
    """Each query as the look-ups it stands for: `a` also asks for satellites, after the others."""
    asks = F.when(F.col("pos") == "a", F.array(F.lit("a"), F.lit("s"))).otherwise(F.array("pos"))
    return queries.select("*", F.posexplode(asks).alias("turn", "ask"))


def definitions(queries: DataFrame, lexicon: DataFrame) -> DataFrame:
    """query_id, form, pos, ord, synset_id, definition: satellites follow adjectives, nothing is merged."""
    lex = bounded(lexicon.select("form", F.col("pos").alias("ask"), F.col("ord").alias("sense"), "synset_id", "definition"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("turn", "sense")) - 1
    return expanded(queries).join(lex, ["form", "ask"]).select("query_id", "form", "pos", rank.alias("ord"), "synset_id", "definition")


def local_map(queries: DataFrame, lexicon: DataFrame) -> DataFrame:
    """As `definitions`, without empty texts and with one row a synset: in the place where the lexicon lists it
    first, with the text that it lists last."""
    lex = bounded(lexicon.where("definition <> ''").select("form", F.col("pos").alias("ask"), F.col("ord").alias("sense"), "synset_id", "definition"))
    place = F.struct("turn", "sense")
    rows = expanded(queries).join(lex, ["form", "ask"]).groupBy("query_id", "form", "pos", "synset_id").agg(F.min(place).alias("place"), F.max_by("definition", place).alias("definition"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("place", "synset_id")) - 1
    return rows.select("query_id", "form", "pos", rank.alias("ord"), "synset_id", "definition")


def sense_counts(lexicon: DataFrame) -> DataFrame:
    return lexicon.groupBy("form", "pos").agg(F.count(F.lit(1)).alias("senses"))


def polysemous(lexicon: DataFrame) -> DataFrame:
    return sense_counts(lexicon).where("senses > 1")


def majority_pos(lexicon: DataFrame) -> DataFrame:
    """form, pos, senses of the part of speech with the most senses; of equal ones the first synset's."""
    per = lexicon.groupBy("form", "pos").agg(F.count(F.lit(1)).alias("senses"), F.min("synset_id").alias("first"))
    rank = F.row_number().over(Window.partitionBy("form").orderBy(F.desc("senses"), "first"))
    return per.withColumn("r", rank).where("r = 1").select("form", "pos", "senses")
