"""Tokens with exact character offsets, marked sentences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.functions import text as X
from glosswork.operators import lexicon as L

BLANKS = [" ", "\t", "\n", "\r", "\f", "\x0b"]  # those of X.BLANK
MOST_SEGMENTS = 1_000_000


def token_rows(docs: DataFrame, id_col: str = "doc_id", keep: tuple[str, ...] = (), deal: bool = True) -> DataFrame:
    """id, the columns to keep, and tokens, an array of (position, word, start_char, end_char) in order (positions from 0, blanks left out;
    offsets in code points); one row for each text with a character.

    The texts are dealt by row (unless they are dealt already) and cut there; offsets are running sums inside each text, so tokens are
    never shuffled, sorted or spilled.
    """
    if deal:
        docs = docs.select(id_col, *keep, "text", F.monotonically_increasing_id().alias("__row")).repartition(F.col("__row"))
    rows = docs.select(id_col, *keep, X.segments(F.col("text")).alias("segments")).where(F.size("segments") > 0)
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in (id_col, *keep))
    return rows.mapInArrow(_placed, f"{kinds}, tokens array<struct<position:bigint,word:string,start_char:bigint,end_char:bigint>>")


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(..., segments) to (..., tokens), some texts at a time."""
    upto = lambda x: np.concatenate((np.zeros(1, np.int64), np.cumsum(x, dtype=np.int64)))
    for batch in batches:
        sizes = upto(np.asarray(pc.list_value_length(batch.column("segments"))))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(sizes, sizes[at] + MOST_SEGMENTS, "right")) - 1)
            part = batch.slice(at, end - at)
            words, bounds = part.column("segments").flatten(), sizes[at : end + 1] - sizes[at]
            ends = upto(np.asarray(pc.utf8_length(words)))
            solid = ~np.asarray(pc.is_in(words, value_set=pa.array(BLANKS)))
            places = upto(solid)
            start, of = np.repeat(ends[bounds[:-1]], np.diff(bounds))[solid], np.repeat(places[bounds[:-1]], np.diff(bounds))[solid]
            tokens = [pa.array(np.arange(len(of)) - of), words.filter(pa.array(solid)), pa.array(ends[:-1][solid] - start), pa.array(ends[1:][solid] - start)]
            tokens = pa.ListArray.from_arrays(pa.array(places[bounds], pa.int32()), pa.StructArray.from_arrays(tokens, ["position", "word", "start_char", "end_char"]))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], tokens], [*batch.schema.names[:-1], "tokens"])
            at = end


def base_tokens(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, position (from 0, blanks left out), word, start_char, end_char (code points). Rows of one id are cut each by itself."""
    return token_rows(docs, id_col).select(id_col, F.inline("tokens"))


def plain_lemma(word: Column) -> Column:
    """The lemma of a word that the lexicon hasn't."""
    return F.lower(word)


def plain_pos(word: Column) -> Column:
    """Its part of speech: X, and PUNCT for single other characters."""
    return F.when(word.rlike(rf"^{X.WORD}"), "X").otherwise("PUNCT")


def tagged(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Adds lemma (lower case) and a universal pos: that of the form's majority in the lexicon, X for other
    words, PUNCT for single other characters."""
    major = L.bounded(L.majority_pos(lexicon).select(F.col("form").alias("lemma"), L.universal(F.col("pos")).alias("upos")))
    word = F.col("word").rlike(rf"^{X.WORD}")
    return tokens.withColumn("lemma", F.lower("word")).join(major, "lemma", "left").withColumn("pos", F.when(word, F.coalesce("upos", F.lit("X"))).otherwise("PUNCT")).drop("upos")


def tags(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """What `tagged` knows of words: lower, lemma and upos of those that the lexicon has. Others have their lower case, and X or PUNCT."""
    rows = L.majority_pos(lexicon).where(F.col("form").rlike(rf"^{X.WORD}"))
    return rows.select(F.col("form").alias("lower"), F.col("form").alias("lemma"), L.universal(F.col("pos")).alias("upos"))


def words(docs: DataFrame) -> DataFrame:
    """word: the lower case of the texts' words, each once; the words of some texts at a time are told apart before they are dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"word": batch.column("s").flatten().unique()})

    rows = docs.select(X.segments(F.col("text")).alias("s")).mapInArrow(run, "word string")
    return rows.where(F.col("word").rlike(rf"^{X.WORD}")).select(F.lower("word").alias("word")).distinct()


def content(tokens: DataFrame) -> DataFrame:
    """Content words with the lexicon's part of speech."""
    return tokens.withColumn("lex_pos", L.recode(F.col("pos"))).where("lex_pos IS NOT NULL")


def marked_by_index(docs: DataFrame, tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One marked text for each token of tokens."""
    rows = tokens.join(docs.select(id_col, "text"), id_col)
    return rows.withColumn("marked", X.mark_at(F.col("text"), F.col("start_char").cast("int"), F.length("word"))).drop("text")


def marked_by_search(rows: DataFrame, text: str = "text", word: str = "word") -> DataFrame:
    """Adds `marked`, null where the word can't be marked."""
    return rows.withColumn("marked", X.mark_first(F.col(text), F.col(word)))
