"""Rows that earlier limits of the queries left out."""

import pytest
from pyspark.sql import functions as F

from glosswork.operators import resolve
from glosswork.plans import registry
from glosswork.sources import sinks


@pytest.fixture
def items(spark, tmp_path):
    rows = [(8, "a" * 390), (9, "b" * 100), (10, "c" * 20), (11, "d" * 5000)]
    spark.createDataFrame(rows, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_encoding_keeps_long_items(spark, items):
    q = registry.queries()
    got = {r["item_id"]: (r["label"], r["at"]) for r in q["label_encode"](spark, items).collect()}
    assert got == {8: (8, 196), 9: (9, 51), 10: (10, 11)}  # the mask of 5,000 codes stands behind the limit
    assert tuple(q["truncation_filter"](spark, items).first()) == (3, 1)
    assert {r["item_id"]: r["n"] for r in q["pad_batch"](spark, items).collect()} == {8: 391, 9: 391, 10: 391}


def test_truncation(spark, items):
    rows = registry.encoded(spark, items, 60).select("item_id", F.size("input_ids").alias("n"), F.coalesce("kept", F.lit(False)).alias("kept"))
    assert {r["item_id"]: (r["n"], r["kept"]) for r in rows.collect()} == {8: (60, False), 9: (60, True), 10: (21, True), 11: (60, False)}


def test_html_entities(spark):
    t = spark.createDataFrame([(d, i, w, None, None) for d in (1, 2) for i, w in enumerate("in New York <now>".split())], "doc_id long, position long, word string, synset_id string, synset_definition string")
    e = spark.createDataFrame([(1, 7, 1, 2, "new & york")], "doc_id long, id long, start_token int, end_token int, text string")
    got = {r["doc_id"]: r["html"] for r in sinks.html(t, e).collect()}
    assert got[1].endswith('</tr><tr><td>-</td><td colspan="2"><a href="#7">new &amp; york</a></td><td>-</td></tr></table>')
    assert got[2].endswith("</tr><tr>" + "<td>-</td>" * 4 + "</tr></table>") and got[1].count("<tr>") == 3


def test_long_labels(spark):
    t = spark.createDataFrame([(1, i, w) for i, w in enumerate("at the united states of north america now".split())], "doc_id long, position long, lemma string")
    g = spark.createDataFrame([(5, "the United States of North America"), (6, "now")], "id long, label string")
    assert sorted((r["id"], r["start_token"], r["end_token"]) for r in resolve.entity_spans(t, g).collect()) == [(5, 1, 6), (6, 7, 7)]
    assert resolve.entity_spans(t, g.limit(0)).count() == 0
