"""The rounds of the quality classifier against plain sorting over all rows, its optimiser against Newton steps, and its defined cases."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glosswork.llm import cotraining
from glosswork.llm.cotraining import META, MIN_ROWS, PSEUDO_WEIGHT, SEED, SURE, Linear

SCHEMA = "doc_id long, text string, lang string, source string"


def packed(lists):
    return np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64), np.array([f for x in lists for f in x], np.int64)


def brute(words, metas, size, marks, fold, tie, rounds, share=SURE, most=cotraining.MOST_PSEUDO):
    """Text, metadata and combined probabilities of all rows. words, metas: lists of features; marks: row to class."""
    x = {"text": words, "meta": metas}
    models = {"text": (Linear(size), 1e-5), "meta": (Linear(META), 1e-4)}
    first = [r for r in marks if fold[r] > 0]
    train = {v: [(r, marks[r], 1.0) for r in first] for v in x}
    rate = sum(marks[r] for r in first) / len(first)
    taken = set()
    for turn in range(rounds + 1):
        for v, (linear, decay) in models.items():
            rows = [x[v][r] for r, _, _ in train[v]]
            if v == "text":
                seen = {}
                for row in rows:
                    for f in row:
                        seen[f] = seen.get(f, 0) + 1
                rows = [[f for f in row if seen[f] >= MIN_ROWS] for row in rows]
            linear.fit(*packed(rows), np.array([float(y) for _, y, _ in train[v]]), np.array([w for _, _, w in train[v]]), 120 if turn == 0 else 40, decay)
        if turn == rounds:
            break
        z = {v: [round(sum(m.w[f] for f in row) + m.bias, 9) for row in x[v]] for v, (m, _) in models.items()}
        free = [r for r in range(len(words)) if r not in marks and r not in taken]
        k = min(int(share * len(free)), most)
        for v, other in (("text", "meta"), ("meta", "text")):
            down = sorted((r for r in free if z[v][r] < 0), key=lambda r: (z[v][r], tie[r], r))[: int(k * (1 - rate))]
            up = sorted((r for r in free if z[v][r] > 0), key=lambda r: (-z[v][r], tie[r], r))[: int(k * rate)]
            train[other] += [(r, 0, PSEUDO_WEIGHT) for r in down] + [(r, 1, PSEUDO_WEIGHT) for r in up]
            taken |= {*down, *up}
    held = [r for r in marks if fold[r] == 0]
    y = np.array([marks[r] for r in held])
    prior = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    odds = []
    for v, (linear, _) in models.items():
        linear.calibrate(linear.logits(*packed([x[v][r] for r in held])), y)
        odds.append(linear.calibrated(linear.logits(*packed(x[v]))))
    return [1 / (1 + np.exp(-o)) for o in (*odds, odds[0] + odds[1] - prior)], len(taken)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    out = []
    for i in range(1500):
        bad = rng.random() < 0.35
        text = " ".join(f"w{x}" for x in rng.integers(0, 40, rng.integers(4, 25))) + " poor" * int(bad and rng.random() < 0.8) + "." * int(rng.integers(0, 5))
        out.append((i, text, rng.choice(["en", "de"]), f"s{int(rng.integers(0, 3)) + (3 if bad and rng.random() < 0.7 else 0)}", int(not bad)))
    return out + [(1500 + j, *out[5 * j + 1][1:]) for j in range(60)]  # equal rows: ties


@pytest.mark.parametrize("parts", [1, 7])
def test_rounds_against_sorting(spark, rows, parts):
    docs = spark.createDataFrame([r[:4] for r in rows], SCHEMA).repartition(parts, "doc_id")
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows[:1500] if r[0] % 5 == 0], "doc_id long, quality int")
    marks = {i: r[4] for i, r in enumerate(rows) if r[0] < 1500 and r[0] % 5 == 0}
    # the numbers of words are the operator's: the fit stops early, so even the order of a sum would show
    names = {w: int(cotraining.text_features(pa.array([w]))[1][0]) for w in {w.lower() for r in rows for w in r[1].split()}}
    words = [sorted({names[w.lower()] for w in r[1].split()}) for r in rows]
    batch = pa.RecordBatch.from_pylist([{"source": r[3], "lang": r[2], "text": r[1]} for r in rows])
    bounds, idx = cotraining.meta_features(batch)
    metas = [idx[bounds[i] : bounds[i + 1]].tolist() for i in range(len(rows))]
    keys = spark.createDataFrame([(r[0],) for r in rows], "id long").select("id", F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(SEED + 1)), F.lit(5)).alias("fold"), F.xxhash64("id", F.lit(SEED + 2)).alias("tie"))
    keys = {r["id"]: r for r in keys.collect()}
    (text, meta, both), taken = brute(words, metas, 1 << cotraining.BITS, marks, [keys[r[0]]["fold"] for r in rows], [keys[r[0]]["tie"] for r in rows], cotraining.ROUNDS)
    assert taken > 100  # the rounds did hand over labels
    got = {r["doc_id"]: r for r in cotraining.classified(docs, labels, F.col("quality") == 1).collect()}
    for i, r in enumerate(rows):
        out = got[r[0]]
        assert (out["text_score"], out["meta_score"], out["score"]) == pytest.approx((text[i], meta[i], both[i]), abs=1e-6)
        assert out["kept"] == (out["score"] >= 0.5)


def test_optimum():
    """The weights are those of Newton's method on the same loss."""
    rng = np.random.default_rng(5)
    x = (rng.random((300, 12)) < 0.3).astype(float)
    y = (rng.random(300) < 1 / (1 + np.exp(-(x @ rng.normal(size=12) - 0.4)))).astype(float)
    weight, decay = rng.choice([1.0, PSEUDO_WEIGHT], 300), 1e-3
    linear = Linear(12)
    linear.fit(*packed([np.flatnonzero(r) for r in x]), y, weight, 500, decay)
    a, ridge, v = np.hstack((x, np.ones((300, 1)))), np.diag([decay] * 12 + [0.0]), np.zeros(13)
    for _ in range(30):
        p = 1 / (1 + np.exp(-(a @ v)))
        s = weight / weight.sum()
        v -= np.linalg.solve((a.T * (s * p * (1 - p))) @ a + ridge, a.T @ (s * (p - y)) + ridge @ v)
    loss = lambda v: (s * (np.logaddexp(0, a @ v) - y * (a @ v))).sum() + decay / 2 * (v[:-1] ** 2).sum()
    assert loss(np.append(linear.w, linear.bias)) == pytest.approx(loss(v), abs=1e-5)


def test_defined_cases(spark):
    """Nulls, empty and long texts, repeated rows, ids without a row, and columns with the operator's own names."""
    texts = ["fine words here", "awful words here", None, "", "word " * 400_000, "fine words here"]
    made = [(i if i != 2 else None, texts[i % 6], "en" if i % 2 else None, "a" if i % 3 else None, "x", i, 0.5) for i in range(60)]
    made += [made[0], made[0]]
    docs = spark.createDataFrame(made, SCHEMA + ", words string, row int, score double")
    labels = spark.createDataFrame([(i, int(i % 6 != 1)) for i in range(60)] + [(0, None), (7, 1), (10**9, 0), (None, 1)], "doc_id long, quality int")
    out = cotraining.classified(docs, labels, F.col("quality") == 1)
    got = out.collect()
    assert out.columns == ["doc_id", "text_score", "meta_score", "score", "kept"] and len(got) == 62
    assert len({r["score"] for r in got if r["doc_id"] == 0}) == 1 and sum(r["doc_id"] is None for r in got) == 1
    assert all(0 <= r["score"] <= 1 for r in got)
    one_class = cotraining.classified(docs, labels.where("quality = 1"), F.col("quality") == 1)
    assert one_class.select("score").distinct().count() == 1
