"""Streams: responses folded with state, generation that is killed and started again, documents in micro-batches."""

import json
import os

import pytest
from pyspark.sql import functions as F

from glosswork.operators import tokens
from glosswork.sources import readers
from glosswork.streaming import fold, generate
from glosswork.streaming import resolve as stream


def line(content, done=False):
    return json.dumps({"message": {"content": content}, "done": done} if content is not None else {"done": done})


LINES = {
    "a": [line("one "), "", line("two "), "  ", line(None), line("end", True), line("late")],
    "b": [line("only", True)],
    "c": [line("never"), line(" ends")],
    "d": [line("é😀"), line("", True), line("again", True)],
}


@pytest.mark.parametrize("cuts", [[], [1], [1, 2, 3, 4, 5, 6], [3, 3, 5]])
def test_fold_equals_the_batch_on_any_micro_batches(spark, tmp_path, cuts):
    rows = [(k, i, v) for k, lines in LINES.items() for i, v in enumerate(lines)]
    edges = [0, *cuts, 99]
    schema = "stream_id string, line_no int, value string"
    for n, (a, b) in enumerate(zip(edges, edges[1:])):
        some = [r for r in rows if a <= r[1] < b]
        again = [r for r in rows if a - 1 <= r[1] < a]  # a line that comes twice
        path = f"{tmp_path}/in/{n}.parquet"
        spark.createDataFrame([*reversed(some), *again], schema).toPandas().to_parquet(path) if os.makedirs(f"{tmp_path}/in", exist_ok=True) is None else None
        os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))
    lines = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    fold.folded(lines).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    got = {r["stream_id"]: r["content"] for r in spark.read.schema("stream_id string, content string").parquet(f"{tmp_path}/out").collect()}
    batch = {r["stream_id"]: r["content"] for r in readers.folded(spark.createDataFrame(rows, schema)).collect()}
    assert got == {k: v for k, v in batch.items() if k != "c"} == {"a": "one two end", "b": "only", "d": "é😀"}


SENSES = [(f, f"{f}{i}", "n", f"sense {i} of {f}") for f, n in (("bank", 3), ("one", 1), ("flat", 2), ("bad", 2), ("run", 4)) for i in range(n)]


def answering(log, fails=()):
    """A service that notes what it is asked, and breaks off at some forms."""

    def answer(payload):
        asked = json.loads(payload)
        form = asked["messages"][0]["content"].split("word form '")[1].split("'")[0]
        with open(f"{log}/{form}", "a") as f:
            f.write("x")
        if form in fails:
            raise RuntimeError("killed")
        if form == "bad":
            yield line("no JSON", True)
            return
        senses = [{"id": x["id"], "pos": "n", "source_definition": "s", "alternative_definition": "t", "examples": ["e"]} for x in json.loads(asked["messages"][1]["content"])]
        text = json.dumps(senses)
        yield line(text[:9])
        yield line(text[9:], True)

    return answer


def test_generation_killed_and_started_again(spark, tmp_path):
    synsets = lambda todo: spark.createDataFrame(SENSES, "form string, synset_id string, pos string, definition string").join(todo, "form")
    os.makedirs(f"{tmp_path}/asked")
    os.makedirs(f"{tmp_path}/in")
    for n, forms in enumerate((["bank", "one", "", "none"], ["flat", "bank", "bad"], ["run", "one", "  flat "])):
        with open(f"{tmp_path}/in/{n}.txt", "w") as f:
            f.write("\n".join(forms))
        os.utime(f"{tmp_path}/in/{n}.txt", (1_700_000_000 + n, 1_700_000_000 + n))
    run = lambda answer: generate.run(spark, f"{tmp_path}/in", synsets, answer, "m", f"{tmp_path}/out", f"{tmp_path}/check", workers=2, maxFilesPerTrigger=1)
    with pytest.raises(Exception, match="killed"):
        run(answering(f"{tmp_path}/asked", fails=("flat",)))
    assert sorted(os.listdir(f"{tmp_path}/out/words")) == ["bank.json"]
    log = {r["form"]: (r["outcome"], r["message"]) for r in run(answering(f"{tmp_path}/asked")).collect()}
    assert log == {"bank": ("made", None), "one": ("one synset", None), "none": ("no synset", None), "flat": ("made", None), "bad": ("failed", "the answer is no list of senses"), "run": ("made", None)}
    made = readers.training_words(spark, f"{tmp_path}/out/words").groupBy("word").count().collect()
    assert {r["word"]: r["count"] for r in made} == {"bank": 3, "flat": 2, "run": 4}
    assert [r["form"] for r in readers.skip_list(spark, f"{tmp_path}/out/skip").collect()] == ["one"]
    times = {f: os.path.getsize(f"{tmp_path}/asked/{f}") for f in os.listdir(f"{tmp_path}/asked")}
    assert times["bank"] == 1 and times["run"] == 1 and "one" not in times and "none" not in times
    before = {f: os.path.getmtime(f"{tmp_path}/out/words/{f}") for f in os.listdir(f"{tmp_path}/out/words")}
    run(answering(f"{tmp_path}/asked"))  # nothing new
    assert before == {f: os.path.getmtime(f"{tmp_path}/out/words/{f}") for f in os.listdir(f"{tmp_path}/out/words")}


def test_a_batch_that_runs_again(spark, tmp_path):
    """The same micro-batch worked off twice leaves the same files, skip list and one log."""
    synsets = lambda todo: spark.createDataFrame(SENSES, "form string, synset_id string, pos string, definition string").join(todo, "form")
    os.makedirs(f"{tmp_path}/asked")
    forms = spark.createDataFrame([("bank",), ("one",), ("bank",), (None,)], "form string")
    for _ in range(2):
        generate.batch(forms, synsets, answering(f"{tmp_path}/asked"), "m", f"{tmp_path}/words", f"{tmp_path}/skip", f"{tmp_path}/log/batch=0")
    assert os.listdir(f"{tmp_path}/words") == ["bank.json"] and os.path.getsize(f"{tmp_path}/asked/bank") == 1
    assert readers.skip_list(spark, f"{tmp_path}/skip").count() == 1


def test_bytes_grow_with_the_text(spark):
    """A text of 20,000 distinct words that are all in the lexicon: what is shuffled grows with the words, not with their square."""
    lex = spark.range(0, 20_000).select(F.concat(F.lit("w"), F.translate(F.format_string("%05d", "id"), "0123456789", "abcdefghij")).alias("form"), F.lit("n").alias("pos"), F.lit(0).alias("ord"), F.col("id").cast("string").alias("synset_id"))
    lex = lex.withColumn("definition", F.concat_ws(" ", "form", F.lit("meaning")))
    words = [r["form"] for r in lex.select("form").collect()]

    def written(n):
        docs = spark.createDataFrame([(1, " ".join(words[:n]))], "doc_id long, text string")
        out = stream.resolved(docs, lex)
        rows = out.count()
        assert rows == n
        from glosswork.operators import resolve

        found = resolve.candidates(tokens.content(tokens.tagged(tokens.base_tokens(docs), lex)), resolve.ranked(lex), lex, resolve.contexts(tokens.tagged(tokens.base_tokens(docs), lex)))
        return found.agg(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0]

    assert written(20_000) < 4.5 * written(5_000)
