"""How many comparisons the n-gram join makes in groups whose sets share most of their elements without links."""

import numpy as np
from pyspark.sql import functions as F
from test_llm import brute_components

from glosswork.llm import ngram_join


def compared(spark, monkeypatch, rows):
    """The components, and the comparisons in the rounds after the first."""
    made, write = [], ngram_join.written

    def counted(df, name):
        out = write(df, name)
        if name == "open-nodes":  # the last lists are listed anew instead
            made.pop()
        if name == "open-lists":
            lists = out.groupBy("gid").agg((F.count_if("pivot") * F.count(F.lit(1))).alias("n"))
            made.append(lists.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"])
        return out

    monkeypatch.setattr(ngram_join, "written", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.joined(df).collect()}
    assert got == brute_components(rows)
    return got, sum(made[1:])


def test_near_copies_without_links(spark, monkeypatch):
    """Near copies of a text that is not there, about as many pairs of them similar enough as not: each pair is compared once at most."""
    rng = np.random.default_rng(3)
    base, rows = [f"w{x}" for x in range(150)], []
    for i in range(160):
        w = list(base)
        for j in rng.choice(len(w), int(rng.integers(3, 7)), replace=False):
            w[j] = f"x{i}.{j}"
        rows.append((i, " ".join(w)))
    got, n = compared(spark, monkeypatch, rows)
    assert 1 < len({c for _, c in got.values()}) < 160
    assert n <= 160 * 160


def test_template_without_links(spark, monkeypatch):
    """Texts of 80 common words and 20 of their own are not linked and not compared but with one of them."""
    rng = np.random.default_rng(4)
    common = [f"w{x}" for x in range(80)]
    rows = [(i, " ".join([*common, *(f"v{x}" for x in rng.integers(0, 10**9, 20))])) for i in range(160)]
    got, n = compared(spark, monkeypatch, rows)
    assert len({c for _, c in got.values()}) == 160 and n == 0
