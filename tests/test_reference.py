"""The queries against their SQL, and the behaviours that SQL does not show."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from glosswork.functions import alphabet as A
from glosswork.functions import text as X
from glosswork.operators import corpus, lexicon, prompts, resolve, scoring, tokens, training
from glosswork.plans import registry
from glosswork.sources import readers, sinks

DATA = "/root/testdata/sf0.001"
TABLES = "documents benchmark conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def rows(table):
    names = sorted(table.column_names)
    clean = lambda v: round(v, 6) if isinstance(v, float) else v
    return names, sorted(zip(*[[repr(clean(v)) for v in table.column(n).to_pylist()] for n in names], strict=True))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, duck, name):
    ours = registry.queries()[name](spark, DATA).toArrow()
    assert rows(ours) == rows(duck.execute(registry.oracle_sql()[name]).to_arrow_table())


def test_alphabet():
    letters = [c for c, _ in A.alphabet()]
    assert len(set(letters)) == 128 and "".join(letters[:52]).isalpha() and letters[0] == "A" and letters[26] == "a" and letters[127] == "ς"
    with pytest.raises(ValueError):
        A.alphabet(lambda c: ord(c) if c.isascii() else None)


MARKS = [
    ("the café is open", "caf", None), ("the café is open", "café", "the *café* is open"), ("naïve Über uber", "über", "naïve *Über* uber"),
    ("keep 100th", "100", None), ("Keep the keep", "keep", "*Keep* the keep"), ("a_b b", "b", "a_b *b*"), ("x.y", ".", "x*.*y"),
    ("don't", "don", "*don*'t"), ("a\nkeep it", "keep", "a\n*keep* it"), ("a * b", "b", None), ("U.S. is", "U.S.", None), ("pay $5 now", "$5", None),
]


def test_mark_first(spark):
    df = spark.createDataFrame([(i, s, w) for i, (s, w, _) in enumerate(MARKS)], "i int, s string, w string")
    got = {r["i"]: r["m"] for r in df.withColumn("m", X.mark_first(F.col("s"), F.col("w"))).collect()}
    assert [got[i] for i in range(len(MARKS))] == [m for _, _, m in MARKS]


def test_offsets(spark):
    docs = spark.createDataFrame([(1, "Apple is a technology company"), (2, ""), (3, None), (4, "a😀b  c")], "doc_id long, text string")
    got = {(r["doc_id"], r["position"]): (r["word"], r["start_char"], r["end_char"]) for r in tokens.base_tokens(docs).collect()}
    assert got[1, 3] == ("technology", 11, 21) and got[4, 1] == ("😀", 1, 2) and got[4, 3] == ("c", 5, 6) and not any(k[0] in (2, 3) for k in got)


LEX = [("bank", "n", 0, "b1", "edge of a river"), ("bank", "n", 1, "b2", "house for money"), ("flat", "a", 0, "f1", "level ground"), ("flat", "s", 0, "f2", "without taste"), ("one", "n", 0, "o1", "single thing")]


def test_lookup_and_sentinels(spark):
    lex = spark.createDataFrame(LEX, "form string, pos string, ord int, synset_id string, definition string")
    asked = spark.createDataFrame([("q1", "bank", "n"), ("q2", "flat", "a"), ("q3", "nothing", "n")], "query_id string, form string, pos string")
    got = lexicon.definitions(asked, lex)
    assert [r["synset_id"] for r in got.where("query_id = 'q2'").orderBy("ord").collect()] == ["f1", "f2"]
    chosen = scoring.choose(got.withColumn("logit", F.lit(0.0)), ["query_id"]).drop("rejected")
    out = {r["query_id"]: r for r in scoring.with_sentinels(asked, chosen, ["query_id"]).collect()}
    assert out["q1"]["synset_id"] == "b1" and out["q1"]["confidence"] == 0.5  # a tie goes to the first
    assert (out["q3"]["synset_id"], out["q3"]["definition"], out["q3"]["confidence"]) == ("No definitions found", "", 0.0)


def test_reject_by_rank_not_text(spark):
    rows_ = spark.createDataFrame([("q", 0, "s", "none of the above", 1.0), ("q", 127, "", "none of the above", 0.0)], "q string, ord int, synset_id string, definition string, logit double")
    r = scoring.choose(rows_, ["q"]).first()
    assert r["synset_id"] == "s" and not r["rejected"]


def test_choice_slice(spark):
    p = [0.0] * 128
    p[0], p[1], p[127] = 0.8, 0.1, 0.05
    df = spark.createDataFrame([(p, 2)], "p array<double>, n int").select(scoring.choice_slice(F.col("p"), F.col("n")).alias("c"))
    assert df.first()["c"] == [0.8, 0.1, 0.05]


def test_prompt_overflow(spark):
    df = spark.createDataFrame([(["d"] * 127,), (["d"] * 128,)], "d array<string>").select(prompts.render(F.lit("w"), F.lit("*w*"), F.col("d")).alias("p"))
    full, over = (r["p"] for r in df.collect())
    assert over is None and full.endswith("ς. none of the above\n\nAnswer: [unused0] [MASK]")


def test_split_whole_groups(spark):
    df = spark.createDataFrame([(f"s{i % 7}", i) for i in range(50)], "synset_id string, i int")
    out = corpus.split(df, 10)
    assert out.groupBy("synset_id").agg(F.countDistinct("part").alias("n")).where("n > 1").count() == 0
    assert out.where("part = 'eval'").count() >= 10 and corpus.split(df, 0).where("part = 'eval'").count() == 0


def test_greedy_spans(spark):
    df = spark.createDataFrame([(1, 5, 0, 2, "a"), (1, 6, 1, 1, "b"), (1, 7, 3, 3, "c"), (1, 8, 0, 0, "d")], "doc_id long, id long, start_token int, end_token int, text string")
    assert [r["text"] for r in resolve.greedy_spans(df).orderBy("start_token").collect()] == ["a", "c"]


def test_training_directory(spark, tmp_path):
    one = [{"id": "x", "pos": "v", "source_definition": "s", "alternative_definition": "t", "examples": ["I keep it"]}]
    (tmp_path / "in still.json").write_text(json.dumps(one))
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "none.json").write_text("[]")
    got = readers.training_words(spark, str(tmp_path)).collect()
    assert [(r["word"], r["id"]) for r in got] == [("in still", "x")]


def test_batch_reply_all_or_nothing(spark):
    body = '{"data":[{"definitions":{"b":"x","a":"y"}}]}'
    df = spark.createDataFrame([(1, 200, body, 1), (2, 500, body, 1), (3, 200, body, 2), (4, 200, "no", 1)], "batch_id int, status int, body string, n_queries int")
    assert [(r["batch_id"], r["synset_id"]) for r in readers.batch_reply(df).orderBy("ord").collect()] == [(1, "b"), (1, "a")]


def test_nested_keeps_nulls(spark):
    t = spark.createDataFrame([(1, "w", "w", "X", 0, 0, 1)], "doc_id long, word string, lemma string, pos string, position int, start_char int, end_char int")
    t = t.withColumns({c: F.lit(None).cast(k) for c, k in (("synset_id", "string"), ("synset_definition", "string"), ("confidence", "double"))})
    e = spark.createDataFrame([], "doc_id long, id long, start_token int, end_token int, text string")
    out = json.loads(sinks.nested(t, e).first()["result"])
    one = spark.createDataFrame([(1, 7, 0, 0, "w", "what it is", "https://x")], "doc_id long, id long, start_token int, end_token int, text string, description string, url string")
    assert json.loads(sinks.nested(t, resolve.greedy_spans(one)).first()["result"])["entities"] == [{"id": 7, "start_token": 0, "end_token": 0, "text": "w", "description": "what it is", "url": "https://x"}]
    assert '<a href="https://x">w</a>' in sinks.html(t, one).first()["html"]
    assert out["entities"] == [] and out["tokens"][0]["synset_id"] is None and "confidence" in out["tokens"][0]


def test_stream_equals_batch(spark):
    from glosswork.streaming import resolve as stream

    lex = registry.lex(spark, DATA)
    batch = stream.resolved(registry.docs(spark, DATA), lex).withColumn("confidence", F.round("confidence", 6))
    live = registry.queries()["resolve_stream"](spark, DATA)
    assert rows(batch.toArrow()) == rows(live.toArrow())


def test_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "one two"), (1, "three  four")], "doc_id long, text string")
    got = sorted((r["word"], r["position"], r["start_char"]) for r in tokens.base_tokens(docs).collect())
    assert got == [("four", 1, 7), ("one", 0, 0), ("three", 0, 0), ("two", 1, 4)]


def test_too_many_senses(spark):
    """A word with 128 senses has no candidates; one with 127 may take its last sense."""
    lex = [(w, "n", i, f"{w}{i}", "some context words" if i == n - 1 else "other text") for w, n in (("many", 127), ("over", 128)) for i in range(n)]
    lexicon_ = spark.createDataFrame(lex + [(w, "v", 0, w, "x") for w in ("context", "words")], "form string, pos string, ord int, synset_id string, definition string")
    docs = spark.createDataFrame([(1, "many over context words")], "doc_id long, text string")
    got = {r["form"]: r for r in resolve.predictions(tokens.tagged(tokens.base_tokens(docs), lexicon_), lexicon_).collect()}
    assert "over" not in got and not got["many"]["rejected"]


def test_other_scorers(spark):
    c = spark.createDataFrame([("q", 0, "s", "d", [1.0, 0.0], [1.0, 0.0]), ("q", 1, "t", "e", [1.0, 0.0], [0.0, 2.0])], "q string, ord int, synset_id string, definition string, context_vec array<float>, sense_vec array<float>")
    assert [r["logit"] for r in scoring.EmbeddingScorer().score(c).orderBy("ord").collect()] == [10.0, 0.0]
    known = spark.createDataFrame([("q", 1, 2.5)], "q string, ord int, logit double")
    assert [r["logit"] for r in scoring.PrecomputedScorer(known, ["q", "ord"]).score(c).orderBy("ord").collect()] == [0.0, 2.5]


def test_running_accuracy_over_runs(spark, monkeypatch):
    monkeypatch.setattr(corpus, "RUN", 3)
    df = spark.createDataFrame([(i, i % 3 == 0) for i in range(200)], "i long, correct boolean")
    got = corpus.running_accuracy(df, ["i"], 8).orderBy("batch").collect()
    assert [(r["seen"], r["correct"]) for r in got] == [(k, len(range(0, k, 3))) for k in range(8, 201, 8)]


def test_labels(spark):
    df = spark.createDataFrame([([7, 1, 9, 1], "B"), ([7, 8, 9, 9, 9, 1], "A")], "ids array<int>, a string")
    got = df.select(*[c.alias(n) for n, c in training.encoded(F.col("ids"), F.col("a"), 1, 5).items()]).collect()
    assert got[0]["labels"] == [-100, 1, -100, -100] and got[0]["kept"] and not got[1]["kept"]
