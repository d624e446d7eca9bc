"""Base forms of inflected words: suffixes are detached by rules, and what the lexicon doesn't have is dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswork.functions import text as X
from glosswork.operators import lexicon as L
from glosswork.operators import tokens as T
from glosswork.sources import store

# The published detachment rules of English dictionaries (part of speech, suffix, ending).
RULES = [
    ("n", "s", ""), ("n", "ses", "s"), ("n", "ves", "f"), ("n", "xes", "x"), ("n", "zes", "z"), ("n", "ches", "ch"), ("n", "shes", "sh"), ("n", "men", "man"), ("n", "ies", "y"),
    ("v", "s", ""), ("v", "ies", "y"), ("v", "es", "e"), ("v", "es", ""), ("v", "ed", "e"), ("v", "ed", ""), ("v", "ing", "e"), ("v", "ing", ""),
    ("a", "er", ""), ("a", "est", ""), ("a", "er", "e"), ("a", "est", "e"),
]
ORDER = "nvar"
ITSELF, LISTED, DETACHED = range(3)


def _plain(pos) -> "F.Column":
    """The part of speech that is asked for: satellites are found with adjectives."""
    return F.when(pos == "s", "a").otherwise(pos)


def candidates(words: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """word to word, kind, cut (letters detached), pos, lemma: what each rule and each exception (form, pos, lemma) makes of it.
    A rule needs a letter before its suffix."""
    word = F.col("word")
    made = [
        F.when(word.endswith(suffix) & (F.length(word) > len(suffix)), F.struct(F.lit(DETACHED).alias("kind"), F.lit(len(suffix)).alias("cut"), F.lit(pos).alias("pos"), F.concat(F.substring(word, F.lit(1), F.length(word) - len(suffix)), F.lit(ending)).alias("lemma")))
        for pos, suffix, ending in RULES
    ]
    rows = words.select("word", F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("x")).select("word", "x.*")
    if exceptions is not None:
        listed = exceptions.select(F.lower("form").alias("word"), F.lit(LISTED).alias("kind"), F.lit(0).alias("cut"), "pos", "lemma")
        rows = rows.unionByName(words.join(L.bounded(listed), "word"))
    return rows


def lemmas(words: DataFrame, lexicon: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """word (lower case, each once), lemma and pos (n v a r) of the words that the lexicon has, as they stand or inflected.

    A form of the lexicon is its own lemma, with the part of speech of most senses. Else an exception goes before a rule, a rule that
    detaches more before one that detaches less, then the part of speech with more senses, then n v a r, then the first lemma.
    """
    known = lexicon.groupBy(F.col("form").alias("lemma"), _plain(F.col("pos")).alias("pos")).agg(F.count(F.lit(1)).alias("senses"))
    made = candidates(words, exceptions).join(L.bounded(known), ["lemma", "pos"])
    own = L.majority_pos(lexicon).select(F.col("form").alias("word"), _plain(F.col("pos")).alias("pos"), "senses")
    own = words.join(L.bounded(own), "word").select("word", F.lit(ITSELF).alias("kind"), F.lit(0).alias("cut"), "pos", F.col("word").alias("lemma"), "senses")
    rank = F.struct("kind", (-F.col("cut")).alias("less"), (-F.col("senses")).alias("fewer"), F.instr(F.lit(ORDER), F.col("pos")).alias("turn"), "lemma", "pos")
    best = made.select(*own.columns).unionByName(own).groupBy("word").agg(F.min(rank).alias("x"))
    return best.select("word", "x.lemma", "x.pos")


def tagged(tokens: DataFrame, lexicon: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """Adds lemma and a universal pos by `lemmas`; words that the lexicon hasn't keep their lower case and are X, single other
    characters PUNCT. The rules see each distinct word once."""
    rows = tokens.withColumn("lower", F.lower("word"))
    words = rows.where(F.col("word").rlike(rf"^{X.WORD}")).select(F.col("lower").alias("word")).distinct()
    found = lemmas(words, lexicon, exceptions).select(F.col("word").alias("lower"), F.col("lemma").alias("base"), L.universal(F.col("pos")).alias("upos"))
    rows = L.looked_up(rows, found, ["lower"])
    word = F.col("word").rlike(rf"^{X.WORD}")
    return rows.withColumns({"lemma": F.coalesce("base", "lower"), "pos": F.when(word, F.coalesce("upos", F.lit("X"))).otherwise("PUNCT")}).drop("lower", "base", "upos")


def tags(docs: DataFrame, lexicon: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """What `tagged` knows of the texts' words: lower, lemma and upos of those that the lexicon has, as they stand or inflected. The texts are cut once for it."""
    found = lemmas(store.written(T.words(docs), "words"), lexicon, exceptions)
    return store.written(found.select(F.col("word").alias("lower"), "lemma", L.universal(F.col("pos")).alias("upos")), "tags")
