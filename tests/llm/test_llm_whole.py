"""What earlier limits of the operators left out."""

import math

import pytest
from pyspark.sql import functions as F

from glosswork.llm import cotraining, lm_scoring, registry



def brute_scores(texts, trained, depth):
    """log10 of each text's probability by context trees over whole texts."""
    nodes, kids = {}, {}

    def steps(t):
        for j in range(len(t)):
            ctx = bytes(t[j - 1 - x] if j - 1 - x >= 0 else 0 for x in range(depth))
            for bit in range(8):
                yield ctx, bit, t[j] >> (8 - bit), (t[j] >> (7 - bit)) & 1

    for t, train in zip(texts, trained, strict=True):
        for ctx, bit, prefix, one in steps(t):
            for d in range(depth + 1):
                nodes.setdefault((ctx[:d], bit, prefix), [0, 0])[one] += train
                if d:
                    kids.setdefault((ctx[: d - 1], bit, prefix), set()).add((ctx[:d], bit, prefix))
    weight, stop = {}, {}
    for key in sorted(nodes, key=lambda x: -len(x[0])):
        a, b = nodes[key]
        own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)
        if len(key[0]) == depth:
            weight[key] = own
            continue
        below = sum(weight[x] for x in kids[key])
        top = max(own, below) + math.log1p(math.exp(-abs(own - below)))
        stop[key], weight[key] = math.exp(own - top), top - math.log(2)

    def score(t):
        total = 0.0
        for ctx, bit, prefix, one in steps(t):
            p = 0.5
            for d in range(depth, -1, -1):
                n = nodes[ctx[:d], bit, prefix]
                w = 1.0 if d == depth else stop[ctx[:d], bit, prefix]
                p = w * (n[one] + 0.5) / (n[0] + n[1] + 1) + (1 - w) * p
            total += math.log10(p)
        return total

    return [score(t) for t in texts]


@pytest.mark.parametrize("sent", [4_000_000, 40])  # all looked up; most joined
def test_lm_contexts_cross_words(spark, tmp_path, monkeypatch, sent):
    monkeypatch.setattr(lm_scoring, "SENT_CONTEXTS", sent)
    monkeypatch.setattr(lm_scoring, "RUN_BYTES", 60)
    rows = [(i, "the small cat sat on a mat") for i in range(12)] + [(12, "mat a on sat cat small the"), (13, "The  small\ncat"), (14, ""), (15, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r["doc_id"]: r for r in registry.op5_lm_scoring(spark, str(tmp_path)).collect()}
    texts = [(" ".join([*(t or "").lower().split(), "\n"])).encode() for _, t in rows]
    want = brute_scores(texts, [not out[i]["held_out"] for i, _ in rows], lm_scoring.DEPTH)
    assert [out[i]["score"] for i, _ in rows] == pytest.approx(want)
    assert out[0]["score"] > out[12]["score"] + 1  # the order of words counts


def test_few_labels_and_the_whole_pool(spark, monkeypatch):
    """A fixed set of labels counts in full however many documents there are, and pseudo-labels come from all."""
    rows = [(i, f"w{i % 7} w{i % 11} " + ("awful" if i % 3 == 0 else "fine"), "en", "a") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    lab = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(100)], "doc_id long, quality int")
    seen = []
    cotrain = cotraining.cotrain

    def watched(text, meta, y, fold, pool, rounds):
        def picks(*a):
            found = pool(*a)
            seen.append({v: len(x[2]) for v, x in found.items()})
            return found

        seen.append(len(y))
        return cotrain(text, meta, y, fold, picks, rounds)

    monkeypatch.setattr(cotraining, "cotrain", watched)
    out = {r["doc_id"]: r for r in cotraining.classified(df, lab, F.col("quality") == 1, sample=100).collect()}
    assert len(out) == 3000 and seen[0] == 100 and seen[1]["text"] >= 140  # 5 % of 2,900 unlabelled rows
    assert sum(r["kept"] == (i % 3 != 0) for i, r in out.items()) > 2700  # a constant gives 2,000
