"""Multiple-choice prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.functions.alphabet import LETTERS, REJECT

# The prompt's wording.
NONE = "none of the above"
QUESTION = "What is the meaning of *{}* in this sentence?\n\nSentence: {}\n\n{}\n\nAnswer: [unused0] {}"
MASK = "[MASK]"


def letter(index: Column) -> Column:
    return F.substring(F.lit(LETTERS), (index + 1).cast("int"), F.lit(1))


def options(senses: DataFrame, by: list[str], offset: Column | None = None) -> DataFrame:
    """Each sense with its letter, and the reject option under the last letter."""
    start = F.lit(0) if offset is None else offset
    rows = senses.select(*by, "ord", letter(F.col("ord") + start).alias("letter"), "synset_id", "definition")
    none = senses.select(*by).distinct().select(*by, F.lit(REJECT).alias("ord"), F.lit(LETTERS[REJECT]).alias("letter"), F.lit("").alias("synset_id"), F.lit(NONE).alias("definition"))
    return rows.unionByName(none)


def render(word: Column, marked: Column, definitions: Column, offset: Column | None = None, mask: str = MASK) -> Column:
    """The prompt for an array of definitions in rank order; null where they don't fit before the reject
    letter."""
    start = F.lit(0) if offset is None else offset
    lines = F.transform(definitions, lambda d, i: F.concat(letter(i + start), F.lit(". "), d))
    lines = F.array_join(F.concat(lines, F.array(F.lit(f"{LETTERS[REJECT]}. {NONE}"))), "\n")
    a, b, c, d = QUESTION.split("{}")[:4]
    text = F.concat(F.lit(a), word, F.lit(b), marked, F.lit(c), lines, F.lit(d), F.lit(mask))
    return F.when((start >= 0) & (start + F.size(definitions) <= REJECT), text)


def plain(word: str, marked: str, definitions: list[str], mask: str = MASK) -> str:
    """The same prompt made in Python, where a task makes many of one text."""
    lines = "\n".join([*(f"{letter_}. {d}" for letter_, d in zip(LETTERS, definitions)), f"{LETTERS[REJECT]}. {NONE}"])  # noqa: B905
    return QUESTION.format(word, marked, lines, mask)


def gathered(senses: DataFrame, by: list[str]) -> DataFrame:
    """One row for each query with its senses as an array in rank order."""
    items = F.array_sort(F.collect_list(F.struct("ord", "synset_id", "definition")))
    return senses.groupBy(*by).agg(items.alias("senses")).withColumn("definitions", F.transform("senses", lambda s: s["definition"]))
