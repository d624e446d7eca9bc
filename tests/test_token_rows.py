"""Tokens are placed inside their text: nothing about them is shuffled or sorted."""

import hashlib

import pyarrow as pa
from pyspark.sql import functions as F

from glosswork.operators import lexicon, tokens
from glosswork.plans import registry

ODD = [(1, "Ab, c"), (1, "Ab"), (2, None), (3, ""), (4, " \n\t"), (5, "é😀x_1 y z"), (None, "a b"), (6, "x " * 5000)]


def plain(text):
    """Each token with its place, cut one character after the other."""
    out, word, at = [], "", 0
    for i, c in enumerate([*text, " "]):
        solid = c.isalnum() or c == "_"
        if solid:
            at, word = (i, c) if not word else (at, word + c)
            continue
        if word:
            out.append((word, at, i))
        if c not in " \t\n\r\f\x0b":
            out.append((c, i, i + 1))
        word = ""
    return [(p, *t) for p, t in enumerate(out)]


def operators(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_odd_texts(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["position"], r["word"], r["start_char"], r["end_char"]) for r in tokens.base_tokens(docs.coalesce(1)).collect())
    assert got == sorted((str(i), *t) for i, text in ODD if text for t in plain(text))


def test_texts_in_slices(monkeypatch):
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2, 3, None]), "segments": [["é😀", " ", "b"], [" "], ["a", ".", "\t", "c"], ["d"]]})
    want = [r for b in tokens._placed(iter([batch])) for r in b.to_pylist()]
    assert [[t["start_char"] for t in r["tokens"]] for r in want] == [[0, 3], [], [0, 1, 3], [0]]
    for most in (1, 3, 4):
        monkeypatch.setattr(tokens, "MOST_SEGMENTS", most)
        assert [r for b in tokens._placed(iter([batch, batch.slice(2, 1), batch.slice(0, 0)])) for r in b.to_pylist()] == [*want, want[2]]


def test_tokens_are_not_sorted(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    lex = lexicon.derived(spark.createDataFrame([(1, "some words here")], "item_id long, text string"))
    for df in (tokens.base_tokens(docs), tokens.content(tokens.tagged(tokens.base_tokens(docs), lex)).select("doc_id", F.col("lemma"))):
        up = operators(df).split("MapInArrow")[0]  # what stands above the cutting
        assert "Window" not in operators(df).split("BroadcastExchange")[0] and "Exchange hash" not in up and "Sort " not in up


def test_rebuilt_in_the_row(spark, tmp_path):
    """Pieces are put together in their text's row and none of them is dealt; null and empty texts have no row."""
    spark.createDataFrame(ODD, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = registry.queries()["sentence_rebuild"](spark, str(tmp_path))
    assert "Generate" not in operators(out)
    texts = {i: t for i, t in ODD if t}
    got = {r["doc_id"]: r["text_md5"] for r in out.collect()}
    assert set(got) == set(texts)
    assert all(got[i] == hashlib.md5(t.encode()).hexdigest() for i, t in texts.items() if i != 1)
