"""Base forms, the nested lexicon, and look-ups of hot keys."""

import pytest
from pyspark.sql import functions as F

from glosswork.operators import lexicon as L
from glosswork.operators import morphology, resolve, tokens, training, wordnet

LEX = "form string, pos string, ord int, synset_id string, definition string"
FORMS = [
    ("bank", "n", 2), ("walk", "n", 1), ("walk", "v", 2), ("box", "n", 1), ("church", "n", 1), ("city", "n", 1), ("wolf", "n", 1), ("woman", "n", 1), ("bus", "n", 1), ("make", "v", 1), ("go", "v", 3),
    ("large", "a", 1), ("quick", "s", 1), ("saw", "n", 1), ("see", "v", 4), ("axe", "n", 1), ("ax", "n", 2), ("s", "n", 1), ("men", "n", 1), ("fast", "r", 2), ("fast", "a", 1),
]
WANT = {
    "bank": ("bank", "n"), "banks": ("bank", "n"), "walks": ("walk", "v"), "walked": ("walk", "v"), "walking": ("walk", "v"), "boxes": ("box", "n"), "churches": ("church", "n"), "cities": ("city", "n"), "wolves": ("wolf", "n"),
    "women": ("woman", "n"), "buses": ("bus", "n"), "making": ("make", "v"), "makes": ("make", "v"), "went": ("go", "v"), "larger": ("large", "a"), "largest": ("large", "a"), "quicker": ("quick", "a"),
    "saw": ("saw", "n"), "axes": ("ax", "n"), "s": ("s", "n"), "men": ("men", "n"), "fast": ("fast", "r"),
}


@pytest.fixture(scope="module")
def lex(spark):
    return spark.createDataFrame([(f, p, i, f"{f}-{p}{i}", f"sense {i} of {f}") for f, p, n in FORMS for i in range(n)], LEX)


def test_lemmas(spark, lex):
    exceptions = spark.createDataFrame([("Went", "v", "go"), ("saw", "v", "see"), ("mice", "n", "mouse")], "form string, pos string, lemma string")
    words = spark.createDataFrame([(w,) for w in [*WANT, "mice", "ing", "ed", "xyzs", "running"]], "word string")
    assert {r["word"]: (r["lemma"], r["pos"]) for r in morphology.lemmas(words, lex, exceptions).collect()} == WANT
    got = {r["word"] for r in morphology.lemmas(words, lex).collect()}
    assert got == set(WANT) - {"went"} and morphology.lemmas(words.limit(0), lex).count() == 0 == morphology.lemmas(words, lex.limit(0)).count()


def test_inflected_words_get_senses(spark, lex):
    """The same lemma under two parts of speech in one text keeps its own senses, and no token is doubled."""
    docs = spark.createDataFrame([(1, "Banks walked. The walk, CITIES!"), (2, None), (3, "")], "doc_id long, text string")
    more = lex.unionByName(spark.createDataFrame([("walk", "n", 1 + i, f"walk-n{1 + i}", "more") for i in range(3)], LEX))
    out = resolve.disambiguate(docs, more, tagger=lambda t, x: morphology.tagged(t, x))
    got = [(r["position"], r["word"], r["lemma"], r["pos"], r["synset_id"]) for r in out.orderBy("doc_id", "position").collect()]
    assert got == [(0, "Banks", "bank", "NOUN", "bank-n0"), (1, "walked", "walk", "VERB", "walk-v0"), (2, ".", ".", "PUNCT", None), (3, "The", "the", "X", None), (4, "walk", "walk", "NOUN", "walk-n0"), (5, ",", ",", "PUNCT", None), (6, "CITIES", "city", "NOUN", "city-n0"), (7, "!", "!", "PUNCT", None)]
    plain = resolve.disambiguate(docs, more).where("word = 'Banks'").first()
    assert plain["synset_id"] is None


@pytest.mark.parametrize("limits", [(10**6, 10**9), (0, 10**9), (10**6, 10)])
def test_looked_up_hot_keys(spark, monkeypatch, limits):
    """Small tables, tables over a limit of rows or bytes with a hot key, null keys, keys that are missing or listed twice."""
    monkeypatch.setattr(L, "HEAVY", 4)
    rows = spark.range(0, 2000, 1, 4).select("id", F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 30 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("k"))
    table = spark.createDataFrame([("hot", 1), ("hot", 2), ("k3", 3), (None, 4), ("other", 5)], "k string, v int")
    out = L.looked_up(rows, table, ["k"], *limits)
    want = rows.join(table, "k", "left")
    assert out.columns == ["k", "id", "v"] and sorted(map(str, out.collect())) == sorted(map(str, want.collect()))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert ("__salt" in plan) == (limits != (10**6, 10**9))


def test_bounded_counts_bytes(spark):
    wide = spark.createDataFrame([("x" * 10_000, ["y" * 1000] * 5)] * 10, "a string, b array<string>")
    hint = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hint(L.bounded(wide)) and not hint(L.bounded(wide, 9)) and not hint(L.bounded(wide, 10, 140_000)) and hint(L.bounded(wide, 10, 170_000))


SYNSETS = [
    (0, "s0", "n", "edge of water", [("bank", ["bank", "banks"]), ("shore", ["shore"])], ["We sat on the bank.", "The Banks flooded, the shore too", "no word"]),
    (1, "s1", "n", "house of money", [("bank", ["bank", "banks"])], ["a *marked* bank", "My bank lends."]),
    (2, "s2", "v", "to tilt", [("bank", ["bank", "banked"])], ["It banked left."]),
    (3, "s3", "n", "no example", [("bank", ["bank"]), ("shore", ["shore"])], []),
    (4, "s4", "n", "no list", [("bank", ["bank"])], None),
]
NESTED = f"nr long, synset_id string, pos string, definition string, words {wordnet.WORDS}, examples array<string>"


def test_nested_lexicon(spark):
    synsets = spark.createDataFrame(SYNSETS, NESTED).repartition(3)
    got = [(r["nr"], r["word_nr"], r["form_nr"], r["example_nr"], r["form"], r["marked"]) for r in wordnet.examples(synsets).orderBy("nr", "word_nr", "form_nr", "example_nr").collect()]
    assert got == [
        (0, 0, 0, 0, "bank", "We sat on the *bank*."), (0, 0, 1, 1, "banks", "The *Banks* flooded, the shore too"), (0, 1, 0, 1, "shore", "The Banks flooded, the *shore* too"), (1, 0, 0, 1, "bank", "My *bank* lends."),
    ]
    flat = [(r["form"], r["pos"], r["ord"], r["synset_id"]) for r in wordnet.lexicon(synsets).orderBy("form", "pos", "ord").collect()]
    assert flat == [("bank", "n", 0, "s0"), ("bank", "n", 1, "s1"), ("bank", "n", 2, "s3"), ("bank", "n", 3, "s4"), ("bank", "v", 0, "s2"), ("shore", "n", 0, "s0"), ("shore", "n", 1, "s3")]
    words = wordnet.training_words(synsets)
    made = training.sense_examples(words).where("word = 'bank'").select("synset_id", "nr", "sentence").collect()
    assert sorted(tuple(r) for r in made) == [("s0", 0, "We sat on the bank."), ("s1", 1, "My bank lends.")]
    assert wordnet.examples(synsets.limit(0)).count() == 0
