"""Lexicons from tables and replies, training files, and a pruned decoder."""

import json
import os

import pytest
from pyspark.sql import functions as F

from glosswork.operators import lexicon as L
from glosswork.operators import resolve, scoring
from glosswork.sources import readers, sinks

LEX = "form string, pos string, ord int, synset_id string, definition string"
WORDS = "word string, ord int, id string, pos string, source_definition string, alternative_definition string, examples array<string>"
ODD = ["in still", "café", "a/b", ".22", "_x", "100%", "a%41", "c+d", "t:o", "007", "日本"]


def test_local_map_keeps_the_first_place_and_the_last_text(spark):
    rows = [("flat", "a", 0, "z1", "level"), ("flat", "a", 1, "y1", ""), ("flat", "a", 2, "x1", "dull"), ("flat", "s", 0, "z1", "even"), ("flat", "s", 1, "b1", "no taste"), ("flat", "n", 0, "a1", "rooms")]
    asked = spark.createDataFrame([("q", "flat", "a")], "query_id string, form string, pos string")
    got = [(r["ord"], r["synset_id"], r["definition"]) for r in L.local_map(asked, spark.createDataFrame(rows, LEX)).orderBy("ord").collect()]
    assert got == [(0, "z1", "even"), (1, "x1", "dull"), (2, "b1", "no taste")]


def test_lexicon_tables(spark, tmp_path):
    rows = [("bank", "n", 0, "b1", "edge"), (None, "n", 0, "b2", "no form"), ("bank", "n", 1, None, "no synset")]
    spark.createDataFrame(rows, LEX).withColumn("more", F.lit(1)).write.parquet(f"{tmp_path}/p")
    got = readers.lexicon(spark, f"{tmp_path}/p")
    assert got.columns == list(readers.LEXICON) and [r["synset_id"] for r in got.collect()] == ["b1"]
    spark.createDataFrame(rows, LEX).write.option("header", True).csv(f"{tmp_path}/c")
    assert [tuple(r) for r in readers.lexicon(spark, f"{tmp_path}/c", "csv", header=True).collect()] == [("bank", "n", 0, "b1", "edge")]
    spark.createDataFrame(rows, LEX).drop("ord").write.parquet(f"{tmp_path}/q")
    with pytest.raises(ValueError, match="ord"):
        readers.lexicon(spark, f"{tmp_path}/q")


def test_lexicon_of_replies(spark):
    body = '{"data":[{"definitions":{"b":"x","a":"y"}},{"definitions":{}}]}'
    replies = spark.createDataFrame([(1, 200, body, 2), (2, 503, body, 2)], "batch_id int, status int, body string, n_queries int")
    asked = spark.createDataFrame([(b, i, f, "n") for b in (1, 2) for i, f in enumerate(("one", "two"))], "batch_id int, query int, form string, pos string")
    got = readers.lexicon_of(asked, replies)
    assert sorted(tuple(r) for r in got.collect()) == [("one", "n", 0, "b", "x"), ("one", "n", 1, "a", "y")]


def test_training_files(spark, tmp_path):
    rows = [(w, i, f"{w}-{i}", "n", f"definition {i}", None, ["an example", 'a "second"']) for w in ODD for i in (1, 0)] + [(None, 0, "x", "n", "d", "e", []), ("", 0, "x", "n", "d", "e", [])]
    words = spark.createDataFrame(rows, WORDS)
    path = f"{tmp_path}/words"
    assert sinks.write_words(words, path) == len(ODD)
    assert sorted(os.listdir(path)) == sorted(sinks.file_name(w) for w in ODD)
    with open(f"{path}/{sinks.file_name('café')}") as f:
        assert [s["id"] for s in json.load(f)] == ["café-0", "café-1"]
    got = {(r["word"], r["ord"]): (r["id"], r["alternative_definition"], r["examples"]) for r in readers.training_words(spark, path).collect()}
    assert got == {(w, i): (f"{w}-{i}", None, ["an example", 'a "second"']) for w in ODD for i in (0, 1)}
    more = words.unionByName(spark.createDataFrame([("new", 0, "n0", "v", "d", "e", [])], WORDS)).withColumn("id", F.lit("changed"))
    assert sinks.write_words(more, f"file://{path}") == 1  # the others keep their files
    assert {r["id"] for r in readers.training_words(spark, path).where("word <> 'new'").collect()} == {f"{w}-{i}" for w in ODD for i in (0, 1)}
    assert sinks.write_words(words.limit(0), path) == 0


def test_pruned_decoder(spark):
    df = spark.createDataFrame([([[1.0, 0.0], [0.0, 1.0], [2.0, 2.0]], [0.5, 0.0, -1.0], [2, 0], [3.0, 4.0])], "w array<array<double>>, b array<double>, ids array<int>, h array<float>")
    rows = df.select("h", scoring.pruned(F.col("w"), F.col("ids")).alias("w"), scoring.pruned(F.col("b"), F.col("ids")).alias("b"))
    assert rows.first()["w"] == [[2.0, 2.0], [1.0, 0.0]]
    assert rows.select(scoring.letter_logits(F.col("h"), F.col("w"), F.col("b")).alias("z")).first()["z"] == [13.0, 3.5]
    with pytest.raises(Exception, match="INVALID_ARRAY_INDEX"):
        df.select(scoring.pruned(F.col("w"), F.array(F.lit(9)))).collect()


def test_settings_and_language(spark):
    with pytest.raises(ValueError, match="is not set"):
        readers.setting(spark, "glosswork.lexicon.url")
    spark.conf.set("glosswork.lexicon.url", "http://lexicon")
    assert readers.setting(spark, "glosswork.lexicon.url") == "http://lexicon"
    docs, lex = spark.createDataFrame([(1, "a bank")], "doc_id long, text string"), spark.createDataFrame([("bank", "n", 0, "b1", "edge")], LEX)
    with pytest.raises(ValueError, match="not supported"):
        resolve.disambiguate(docs, lex, language="xx")
