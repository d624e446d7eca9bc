"""What the n-gram join deals out: names of rows don't grow with the partitions, and texts without a pair stay where they are."""

import numpy as np
import pytest

from glosswork.llm import ngram_join


def shuffled(spark):
    """Bytes that all stages so far wrote for shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store = sc._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(i) for i in range(stages.size()))}


def written_since(spark, before):
    return sum(n for k, n in shuffled(spark).items() if k not in before)


def texts(rng, rows, words):
    return [(i, " ".join(f"w{x}" for x in rng.integers(0, 10**9, words))) for i in range(rows)]


class Dealt(Exception):
    pass


def test_names_of_rows_do_not_grow_with_partitions(spark, monkeypatch):
    df = spark.createDataFrame(texts(np.random.default_rng(5), 400, 200), "doc_id long, text string").coalesce(1)
    lists = ngram_join.lists

    def counted(*args):
        before = shuffled(spark)
        lists(*args).write.format("noop").mode("overwrite").save()
        raise Dealt(written_since(spark, before))

    monkeypatch.setattr(ngram_join, "lists", counted)
    parts, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (4, 120):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            with pytest.raises(Dealt) as e:
                ngram_join.joined(df)
            got.append(e.value.args[0])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert 0 < got[1] < 1.25 * got[0]


def test_only_texts_of_pairs_are_dealt(spark):
    rows = texts(np.random.default_rng(6), 400, 200)
    rows[7] = (7, rows[3][1])
    nodes = ngram_join.written(spark.createDataFrame(rows, "node long, text string"), "node-texts")
    pairs = ngram_join.written(spark.createDataFrame([(3, 7), (3, 9)], "a long, b long"), "pairs")
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for tables of a real size
    try:
        before = shuffled(spark)
        got = {(r["a"], r["b"]): r["linked"] for r in ngram_join.linked(pairs, nodes, 5, 75).collect()}
        n = written_since(spark, before)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    assert got == {(3, 7): True, (3, 9): False}
    assert 0 < n < 50_000


def test_packed_rows_come_back():
    rng = np.random.default_rng(7)
    for k in (1, 2, 5000):
        low = np.sort(rng.integers(0, 2**32, k).astype(np.uint64))
        low[:2] = low[0]
        row, flag, node = rng.integers(0, 300, k), rng.choice([1, 3, 4], k).astype(np.uint32), rng.integers(0, 2**63, 300).astype(np.uint64)
        b = ngram_join._packed(low, row, flag, node)
        got = [np.concatenate(x) for x in zip(*[ngram_join._unpacked(b, i) for i in range(ngram_join.PARTS)], strict=True)]
        assert (got[0] == low).all() and (got[1] == node[row]).all() and (got[2] == flag).all()
        assert len(b) < 8 * len(np.unique(row)) + 6 * k + 300
