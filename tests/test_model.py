"""A model's choice for each occurrence: marked at its own place, scored in buckets of similar length."""

import pytest
from pyspark.sql import functions as F

from glosswork.operators import lexicon as L
from glosswork.operators import prompts as P
from glosswork.operators import resolve, scoring

LEX = [("bank", "n", 0, "b1", "edge of a river"), ("bank", "n", 1, "b2", "house for money"), ("flat", "a", 0, "f1", "level ground"), ("flat", "s", 0, "f2", "without taste")]
SCHEMA = "form string, pos string, ord int, synset_id string, definition string"


def by_place():
    """The second sense where the mark is near the text's start, the first elsewhere, none in brackets."""

    def score(prompts):
        out = []
        for p in prompts:
            sentence = p.split("Sentence: ", 1)[1].split("\n\n", 1)[0]
            at = next(i for i in range(len(sentence)) if sentence[i] == "*" and sentence[i + 1 :].split("*")[0].isalpha() and sentence[i + 1] != " ")
            z = [0.0] * 128
            z[127 if sentence[at - 1] == "(" else 1 if at < 6 else 0] = 5.0
            out.append(z)
        return out

    return score


def test_each_occurrence_has_its_own_sense(spark):
    lex = spark.createDataFrame(LEX, SCHEMA)
    docs = spark.createDataFrame([(1, "the bank, the bank (bank)"), (2, "a * mark near the bank"), (3, "no word of it"), (4, None), (5, "😀 flat flat")], "doc_id long, text string")
    out = resolve.disambiguate(docs, lex, scoring.ModelScorer(by_place)).where("confidence IS NOT NULL").orderBy("doc_id", "position")
    assert [(r["doc_id"], r["word"], r["start_char"], r["synset_id"]) for r in out.collect()] == [(1, "bank", 4, "b2"), (1, "bank", 14, "b1"), (1, "bank", 20, None), (2, "bank", 18, "b1"), (5, "flat", 2, "f2"), (5, "flat", 7, "f1")]


def test_too_many_senses_have_no_prompt(spark):
    rows = [(w, "n", i, f"{w}{i}", f"meaning {i}") for w, n in (("many", 127), ("over", 128)) for i in range(n)]
    docs = spark.createDataFrame([(1, "many over")], "doc_id long, text string")

    def load():
        return lambda prompts: [[float(i == 126) for i in range(128)] for _ in prompts]

    got = resolve.disambiguate(docs, spark.createDataFrame(rows, SCHEMA), scoring.ModelScorer(load)).orderBy("position").collect()
    assert [(r["lemma"], r["synset_id"]) for r in got] == [("many", "many126"), ("over", None)] and got[1]["confidence"] is None


def test_prompts_are_those_of_the_plan(spark):
    df = spark.createDataFrame([("w", "a *w* {b}", ["first {}", "second"])], "w string, m string, d array<string>")
    assert df.select(P.render(F.col("w"), F.col("m"), F.col("d"), mask="<m>").alias("p")).first()["p"] == P.plain("w", "a *w* {b}", ["first {}", "second"], "<m>")


def test_buckets_pad_less(spark):
    """The same results as one by one, each prompt once, the model asked in chunks, and less padding than in the order of the text."""
    lex = spark.createDataFrame(LEX, SCHEMA)
    docs = spark.createDataFrame([(i, "x " * (i * 37 % 200) + "bank and flat bank") for i in range(60)], "doc_id long, text string").coalesce(1)
    content = L.sense_counts(lex).select(F.col("form"), "pos")
    from glosswork.operators import tokens as T

    tokens = T.content(T.tagged(T.base_tokens(docs), lex)).select("doc_id", "position", "word", "start_char", F.col("lemma").alias("form"), F.col("lex_pos").alias("pos"))
    senses = resolve.packed_senses(tokens, lex)

    def load():
        def score(prompts):
            assert len(prompts) <= 4
            return [[float(len(p) % 7), float(len(p) % 5), *[0.0] * 126] for p in prompts]

        return score

    def run(**how):
        rows = scoring.ModelScorer(load, **how).scored(docs, tokens.coalesce(1), senses).collect()
        return {(r["doc_id"], r["position"]): tuple(r["logits"]) for r in rows}, sum(r["longest"] - r["chars"] for r in rows), len(rows)

    one, none, n = run(size=1)
    apart, padded, _ = run(size=4, ahead=4)
    bucketed, less, m = run(size=4, ahead=256)
    tight, _, _ = run(size=3, ahead=1000, most_chars=2000)
    assert one == apart == bucketed == tight and n == m == 180 and none == 0 and less < padded / 2 and content.count() == 3


def test_a_model_that_gives_too_few_results(spark):
    lex = spark.createDataFrame(LEX, SCHEMA)
    docs = spark.createDataFrame([(1, "the bank")], "doc_id long, text string")
    with pytest.raises(Exception, match="0 results for 1 prompts"):
        resolve.disambiguate(docs, lex, scoring.ModelScorer(lambda: lambda prompts: [])).collect()


@pytest.mark.parametrize("held", [0, 1 << 20])
def test_definitions_are_not_dealt_with_occurrences(spark, monkeypatch, held):
    """A task looks definitions up where they fit it; where they don't, they come with the occurrences. The results are the same."""
    monkeypatch.setattr(scoring, "HELD_BYTES", held)
    lex = spark.createDataFrame(LEX, SCHEMA)
    docs = spark.createDataFrame([(1, "the bank flat (bank)"), (2, "no word")], "doc_id long, text string")
    content = spark.createDataFrame([(1, 1, "bank", 4, "bank", "n"), (1, 2, "flat", 9, "flat", "a"), (1, 4, "bank", 15, "bank", "n"), (2, 0, "no", 0, "no", "n")], "doc_id long, position long, word string, start_char long, form string, pos string")
    out = scoring.ModelScorer(by_place).scored(docs, content, resolve.packed_senses(content, lex))
    assert sorted((r["doc_id"], r["position"], r["form"], len(r["logits"])) for r in out.collect()) == [(1, 1, "bank", 3), (1, 2, "flat", 3), (1, 4, "bank", 3)]
    dealt = [n.split("]")[0] for n in out._jdf.queryExecution().optimizedPlan().toString().split("collect_list(struct(position")[1:]]
    assert dealt and all(("definitions" in n) == (held == 0) for n in dealt)
