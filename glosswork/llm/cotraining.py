"""Quality classification by co-training.

Two views of a document have a classifier each: its words (hashed, present or not), and its metadata
(source, language, size and layout, without a word of the text). Both start from the labelled rows
(a sample beyond SAMPLE of them). In each round either view labels the rows of the unlabelled pool of which it is most
sure, in the labels' proportion, and hands them to the other view's training set. After the rounds each view's scores are
calibrated on labelled rows that it has not seen, and a document's probability is the
product of both views' odds over the prior odds.

The texts are read once, for a table of features. In each round all unlabelled rows are scored from it, and
at most MOST_PSEUDO of them a view go to the driver, which fits the models on these and the labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.llm.shared import forget, small, written
from glosswork.llm.words import Words, slices

SAMPLE = 30_000
MOST_LABELS = 60_000
ROUNDS = 4
SURE = 0.05  # the share of the pool that a view labels in a round
MOST_PSEUDO = 5_000  # rows that a view labels in a round, at most
PSEUDO_WEIGHT = 0.5
MIN_ROWS = 5  # rows of the training set that a word must be in
BITS = 18
META = 256
SEED = 29


def text_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bounds and the distinct hashed words of each row."""
    w = Words(column, lower=True)
    codes, row = w.codes, w.rows
    size = len(w.distinct)
    w.codes = np.arange(size)
    name = (w.hashes() >> np.uint64(64 - BITS)).astype(np.int64)
    pair = np.unique((row << BITS) | name[codes]) if len(codes) else np.zeros(0, np.int64)
    return np.searchsorted(pair >> BITS, np.arange(len(w.bounds))), (pair & ((1 << BITS) - 1)).astype(np.int32)


def meta_features(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Bounds and the features of each row: source, language, and steps of size and of layout."""
    import xxhash

    def named(column: str, seed: int, most: int) -> np.ndarray:
        coded = pc.fill_null(part.column(column).cast(pa.string()), "\0").dictionary_encode()
        table = np.array([xxhash.xxh3_64_intdigest(x.encode(), seed=seed) % most for x in coded.dictionary.to_pylist()], np.int64)
        return table[np.asarray(coded.indices)] if len(table) else np.zeros(0, np.int64)

    text = pc.fill_null(part.column("text").cast(pa.large_string()), "")
    size = np.asarray(pc.utf8_length(text)).astype(float)
    count = lambda p: np.asarray(pc.count_substring(text, p)).astype(float)
    step = lambda x, most: np.clip(x, 0, most - 1).astype(np.int64)
    lines, spaces, stops = count("\n") + 1, count(" ") + 1, count(".") + count("!") + count("?")
    columns = [
        named("source", 1, 64),
        64 + named("lang", 2, 16),
        80 + step(np.log2(size + 1) * 2, 40),
        120 + step(np.log2(lines), 16),
        136 + step(np.log2(size / lines + 1) * 2, 32),
        168 + step(size / spaces, 24),
        192 + step(100 * stops / spaces / 2, 24),
        216 + step(np.log2(count("|") + count("#") + count("*") + 1), 8),
        224 + step(np.log2(count("http") + count("@") + 1), 8),
    ]
    n = part.num_rows
    return np.arange(n + 1) * len(columns), np.stack(columns, 1).ravel().astype(np.int32) if n else np.zeros(0, np.int32)


def _blocks(rows: int) -> Iterator[tuple[int, int]]:
    """Runs of rows, so that the driver's temporary arrays stay small."""
    return ((a, min(a + 2048, rows)) for a in range(0, rows, 2048))


@dataclass
class Linear:
    """Logistic regression over rows of present features."""

    size: int
    w: np.ndarray = field(default=None)  # type: ignore[assignment]
    bias: float = 0.0
    scale: tuple[float, float] = (1.0, 0.0)

    def logits(self, bounds: np.ndarray, idx: np.ndarray) -> np.ndarray:
        out = np.empty(len(bounds) - 1)
        for a, b in _blocks(len(out)):
            upto = np.concatenate(([0.0], np.cumsum(self.w[idx[bounds[a] : bounds[b]]])))
            at = bounds[a : b + 1] - bounds[a]
            out[a:b] = upto[at[1:]] - upto[at[:-1]] + self.bias
        return out

    def fit(self, bounds: np.ndarray, idx: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int, decay: float, own: bool = False) -> None:
        """L-BFGS with backtracking; from the last weights if there are any. own: idx may be written over."""
        if self.w is None:
            self.w = np.zeros(self.size)
            rate = np.average(y, weights=weight)
            self.bias = float(np.log(rate / (1 - rate)))
        n, total = np.diff(bounds), weight.sum()
        # features that no row has and whose weight is 0 stay at 0, so the steps are taken over the others alone
        there = self.w != 0
        there[idx] = True
        used = np.flatnonzero(there)
        place = np.zeros(self.size, np.int32)
        place[used] = np.arange(len(used))
        if own:
            for a in range(0, len(idx), 1 << 18):
                idx[a : a + (1 << 18)] = place[idx[a : a + (1 << 18)]]
        else:
            idx = place[idx]
        few = Linear(len(used), self.w[used], self.bias)

        def at(x: np.ndarray) -> tuple[float, np.ndarray]:
            few.w, few.bias = x[:-1], x[-1]
            z = few.logits(bounds, idx)
            loss = (weight * (np.logaddexp(0, z) - y * z)).sum() / total + decay / 2 * (few.w**2).sum()
            err = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / total
            grad = decay * few.w
            for a, b in _blocks(len(n)):
                grad += np.bincount(idx[bounds[a] : bounds[b]], weights=np.repeat(err[a:b], n[a:b]), minlength=few.size)
            return loss, np.append(grad, err.sum())

        x = np.append(few.w, few.bias)
        f, g = at(x)
        past: list[tuple[np.ndarray, np.ndarray]] = []
        for _ in range(steps):
            d, kept = -g, []
            for s, t in reversed(past):
                k = (s @ d) / (s @ t)
                kept.append(k)
                d = d - k * t
            if past:
                d = d * ((past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]))
            for (s, t), k in zip(past, reversed(kept), strict=True):
                d = d + s * (k - (t @ d) / (s @ t))
            size = 1.0 if past else min(1.0, 1.0 / (np.abs(g).sum() + 1e-12))
            slope = g @ d
            for _ in range(20):
                f2, g2 = at(x + size * d)
                if f2 <= f + 1e-4 * size * slope:
                    break
                size /= 2
            else:
                break
            if (size * d) @ (g2 - g) > 1e-12:
                past = [*past[-7:], (size * d, g2 - g)]
            x, small_gain, f, g = x + size * d, f - f2 < 1e-6 * abs(f), f2, g2
            if small_gain:
                break
        self.w, self.bias = np.zeros(self.size), float(x[-1])
        self.w[used] = x[:-1]

    def calibrate(self, z: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling by damped Newton steps, with smoothed targets."""
        mid, spread = float(z.mean()), float(z.std()) or 1.0
        x = np.stack(((z - mid) / spread, np.ones(len(z))))
        up, down = y.sum(), len(y) - y.sum()
        t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
        loss = lambda v: (np.logaddexp(0, v @ x) - t * (v @ x)).sum() + 1e-3 * (v @ v)
        v = np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-(v @ x)))
            g = x @ (p - t) + 2e-3 * v
            step = np.linalg.solve((x * (p * (1 - p))) @ x.T + 2e-3 * np.eye(2), g)
            size = 1.0
            while size > 1e-6 and loss(v - size * step) > loss(v):
                size /= 2
            v = v - size * step
            if np.abs(size * step).max() < 1e-6:
                break
        slope = max(float(v[0]), 0.0) / spread
        self.scale = (slope, float(v[1]) - slope * mid)

    def calibrated(self, z: np.ndarray) -> np.ndarray:
        return self.scale[0] * z + self.scale[1]


@dataclass
class Model:
    text: Linear
    meta: Linear
    prior: float

    def score(self, text: tuple[np.ndarray, np.ndarray], meta: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each view's and the combined log odds of the positive class."""
        a, b = self.text.calibrated(self.text.logits(*text)), self.meta.calibrated(self.meta.logits(*meta))
        return a, b, a + b - self.prior


def _rows(bounds: np.ndarray, idx: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size, out = np.diff(bounds)[rows], [idx[:0]]
    for a, b in _blocks(len(rows)):
        n = size[a:b]
        out.append(idx[np.repeat(bounds[:-1][rows[a:b]] - np.cumsum(n) + n, n) + np.arange(n.sum())])
    return np.concatenate(([0], np.cumsum(size))), np.concatenate(out)


def _packed(bounds: np.ndarray, idx: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * 4).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(idx, np.int32))])


def _unpacked(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds and features of a column of `_packed` lists."""
    lists = column.cast(pa.large_binary())
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    if not len(lists):
        return np.zeros(1, np.int64), np.zeros(0, np.int32)
    _, offsets, data = lists.buffers()
    at = np.frombuffer(offsets, np.int64)[lists.offset : lists.offset + len(lists) + 1] // 4
    idx = np.frombuffer(data, np.int32)[at[0] : at[-1]] if data is not None else np.zeros(0, np.int32)
    return at - at[0], idx


def _training(parts: list[tuple[tuple[np.ndarray, np.ndarray], np.ndarray]], size: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The features of the rows of all parts ((bounds, features), rows), without those that fewer than `least` rows
    have. Counted first and then filled in by blocks, so that beside the parts this one array is in memory."""

    def blocks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for features, rows in parts:
            for a, b in _blocks(len(rows)):
                yield _rows(*features, rows[a:b])

    df = np.zeros(size, np.int64)
    for _, idx in blocks():
        df += np.bincount(idx, minlength=size)
    common = df >= least
    out, counts, at = np.empty(int(df[common].sum()), np.int32), [np.zeros(1, np.int64)], 0
    for bounds, idx in blocks():
        kept = common[idx]
        upto = np.concatenate(([0], np.cumsum(kept)))
        counts.append(np.diff(upto[bounds]))
        out[at : at + upto[-1]] = idx[kept]
        at += int(upto[-1])
    return np.cumsum(np.concatenate(counts)), out


def cotrain(text: tuple, meta: tuple, y: np.ndarray, fold: np.ndarray, pool, rounds: int = ROUNDS) -> Model:
    """y: 1 or 0. fold: rows of fold 0 calibrate, the others train. pool(text, meta, rate): for each view
    the features (text, meta) and classes of the unlabelled rows that it is most sure of; None without such rows."""
    views = {"text": (Linear(1 << BITS), 1e-5), "meta": (Linear(META), 1e-4)}
    x = {"text": text, "meta": meta}
    start = np.flatnonzero(fold > 0)
    train = {v: [(x[v], start)] for v in views}
    label = {v: [y[start].astype(float)] for v in views}
    weight = {v: [np.ones(len(start))] for v in views}
    model = Model(views["text"][0], views["meta"][0], 0.0)
    if not len(start) or len(np.unique(y[start])) < 2:  # nothing to learn from: every score is the prior
        rate = float(y[start].mean()) if len(start) else 0.5
        for linear, _ in views.values():
            linear.w, linear.bias = np.zeros(linear.size), 0.0
            linear.scale = (0.0, 0.0)
        model.prior = float(-np.log((rate * len(start) + 1) / ((1 - rate) * len(start) + 1)))
        return model
    rate = float(y[start].mean())
    for r in range(rounds + 1):
        for v, (linear, decay) in views.items():
            bounds, idx = _training(train[v], linear.size, MIN_ROWS if v == "text" else 1)
            linear.fit(bounds, idx, np.concatenate(label[v]), np.concatenate(weight[v]), 120 if r == 0 else 40, decay, own=True)
            del bounds, idx
        found = pool(model.text, model.meta, rate) if r < rounds else None
        if found is None:
            break
        for other, (words, layout, sure) in (("meta", found["text"]), ("text", found["meta"])):
            train[other].append((words if other == "text" else layout, np.arange(len(sure))))
            label[other].append(sure.astype(float))
            weight[other].append(np.full(len(sure), PSEUDO_WEIGHT))
    rows = np.flatnonzero(fold == 0)
    if not len(rows) or len(np.unique(y[rows])) < 2:
        rows = start
    for v, (linear, _) in views.items():
        linear.calibrate(linear.logits(*_rows(*x[v], rows)), y[rows])
    model.prior = float(np.log((y[rows].sum() + 1) / (len(rows) - y[rows].sum() + 1)))
    return model


def features(docs: DataFrame, id_col: str) -> DataFrame:
    """row, the id, words and meta (packed features) of every row of docs, as a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("id"), _packed(*text_features(part.column("text"))), _packed(*meta_features(part))], ["id", "words", "meta"])

    rows = docs.select(F.col(id_col).alias("id"), "text", "lang", "source")
    made = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, words binary, meta binary")
    return written(made.withColumn("row", F.monotonically_increasing_id()), "cotraining-features")


def fit(made: DataFrame, labels: DataFrame, good: Column, id_col: str = "doc_id", sample: int = SAMPLE, rounds: int = ROUNDS) -> Model:
    """made: from `features`. labels: the id and what `good` (boolean) is made of; of an id's several labels all
    must be good."""
    spark = made.sparkSession
    marked = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(good.cast("int")).alias("y")).where("y IS NOT NULL")
    marked = written(marked, "cotraining-marked")
    n = max(1, made.select("id").join(marked, "id").count())  # the labelled rows
    unit = F.xxhash64(F.col("id").cast("string"), F.lit(SEED)).bitwiseAND(F.lit((1 << 30) - 1))
    marks = marked if n <= sample else written(marked.where(unit < int((1 << 30) * (sample / n))), "cotraining-labels")
    fold = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(SEED + 1)), F.lit(5)).cast("int").alias("fold")
    got = made.join(small(marks, MOST_LABELS), "id").select("id", "y", fold, "words", "meta").toArrow()
    got = got.sort_by([(c, "ascending") for c in ("id", "words", "meta")])  # the fit stops early, so it depends on the order of its rows
    y, fold = (np.asarray(got.column(c)).astype(np.int64) for c in ("y", "fold"))
    words, layout = _unpacked(got.column("words")), _unpacked(got.column("meta"))
    del got
    taken = np.zeros(0, np.int64)

    def rows_of(rows: np.ndarray) -> DataFrame:
        return F.broadcast(spark.createDataFrame(pa.table({"row": pa.array(rows, pa.int64())})))

    def pool(text: Linear, meta: Linear, rate: float):
        nonlocal taken
        sent = spark.sparkContext.broadcast((text, meta))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                # rounded, so that equal rows are equal wherever they stand in their batch, and ties go by the hash
                z = [pa.array(np.round(linear.logits(*_unpacked(batch.column(c))), 9)) for linear, c in zip(sent.value, ("words", "meta"), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("row"), *z], ["id", "row", "text", "meta"])

        z = made.select("id", "row", "words", "meta").mapInArrow(run, f"id {made.schema['id'].dataType.simpleString()}, row bigint, text double, meta double")
        z = z.join(marked.select("id"), "id", "left_anti").join(rows_of(taken), "row", "left_anti")
        z = written(z.withColumn("tie", F.xxhash64("id", F.lit(SEED + 2))), "cotraining-round")
        k = min(int(SURE * z.count()), MOST_PSEUDO)
        picked = {}
        for v in ("text", "meta"):
            down = z.where(F.col(v) < 0).orderBy(v, "tie", "row").limit(int(k * (1 - rate))).select("row").toArrow()
            up = z.where(F.col(v) > 0).orderBy(F.desc(v), "tie", "row").limit(int(k * rate)).select("row").toArrow()
            picked[v] = [np.asarray(t.column("row")).astype(np.int64) for t in (down, up)]
        forget(z)
        every = np.unique(np.concatenate([r for pair in picked.values() for r in pair]))
        if not len(every):
            return None
        taken = np.concatenate((taken, every))
        rows = made.join(rows_of(every), "row").select("row", "words", "meta").toArrow().sort_by("row")
        words, layout = _unpacked(rows.column("words")), _unpacked(rows.column("meta"))
        out = {}
        for v, (down, up) in picked.items():
            at = np.searchsorted(every, np.concatenate((down, up)))
            out[v] = (_rows(*words, at), _rows(*layout, at), np.repeat([0, 1], [len(down), len(up)]))
        return out

    return cotrain(words, layout, y, fold, pool, rounds)


def scored(made: DataFrame, model: Model, id_col: str) -> DataFrame:
    """The id of every row of `features`, text_score, meta_score and score: the probability of the positive
    class by each view and by both."""
    sent = made.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # rounded as in the rounds: the sums depend on a row's place in its batch in the last digits
            p = [np.round(1 / (1 + np.exp(-np.clip(z, -40, 40))), 9) for z in sent.value.score(_unpacked(batch.column("words")), _unpacked(batch.column("meta")))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(x) for x in p]], ["id", "text_score", "meta_score", "score"])

    rows = made.select("id", "words", "meta")
    return rows.mapInArrow(run, f"id {made.schema['id'].dataType.simpleString()}, text_score double, meta_score double, score double").withColumnRenamed("id", id_col)


def classified(docs: DataFrame, labels: DataFrame, good: Column, id_col: str = "doc_id", limit: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """id, the three scores and kept (score >= limit) of every row of docs (id, text, lang, source).

    Defined cases: null texts have no words, null metadata are a value of their own; rows without an id
    are scored like others and never drawn with a label; without labels of both classes every row gets
    the smoothed rate of the class; an empty table stays empty; other columns are not read.
    """
    made = features(docs, id_col)
    model = fit(made, labels, good, id_col, sample)
    return scored(made, model, id_col).withColumn("kept", F.col("score") >= limit)
