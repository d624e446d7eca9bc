"""Language-model scoring by context-tree weighting.

The model's text is its tokens: each word's bytes and a space, and a line end after the last. With `across`
a byte's context is the DEPTH bytes before it in the document, earlier words among them; without, those in
its own token alone.

One pass counts, over all training texts, the words and the pairs of a context and its byte. Words are
summed as rows; contexts go as packed lists, one for each subtree and task, and are summed where the
subtree is made. The context trees are made from these counts in subtrees (one for each three nearest bytes, of
distinct contexts only); their roots are summed by Spark to the nodes of two nearest bytes, at most 65,536 times
255 of them, which make the top. The scores of the most
frequent contexts and the counts of the most frequent words are sent to the executors, the others are
joined by shuffle. No table that grows
with the corpus is broadcast without a bound, and nothing is left out of the counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.llm import context_tree as tree
from glosswork.llm.shared import forget, most_frequent, written
from glosswork.llm.words import Words, slices

DEPTH = tree.DEPTH
NEAR = 3  # nearest bytes that name a subtree
COUNT_BYTES = 16 << 20
RUN_BYTES = 2 << 20
KEPT_CONTEXTS = 1_000_000
SUBTREES_KEYS = 200_000
SENT_WORDS = 500_000
SENT_CONTEXTS = 4_000_000
SPACE, END = b" ", b"\n"


def held_out(id_col: Column) -> Column:
    """Whether a row is left out of training: CRC-32 of its id as text, modulo 7, is 2."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _strings(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of the words with a space after each, and of the end."""
    flat = pc.binary_join_element_wise(words.cast(pa.large_string()), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
    flat = pa.concat_arrays([flat, pa.array(["\n"], pa.large_string())])
    _, offsets, data = flat.buffers()
    bounds = np.frombuffer(offsets, np.int64)[flat.offset : flat.offset + len(flat) + 1]
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key)
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(first) else n


def _runs(words: Words, data: np.ndarray, bounds: np.ndarray, across: bool) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about RUN_BYTES: first row, the row after the last, the contexts and bytes of their
    running text, and each row's bounds in it."""
    size = np.diff(bounds)
    upto = np.concatenate(([0], np.cumsum(size[words.codes]))) if len(words) else np.zeros(1, np.int64)
    upto = upto[words.bounds] + np.arange(len(words.bounds))
    at, rows = 0, len(words.bounds) - 1
    while at < rows:
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + RUN_BYTES, "right")) - 1)
        first, last = int(words.bounds[at]), int(words.bounds[to])
        owner = np.insert(words.codes[first:last], words.bounds[at + 1 : to + 1] - first, len(size) - 1)
        k = size[owner]
        end = np.cumsum(k)
        text = data[np.repeat(bounds[:-1][owner] - end + k, k) + np.arange(end[-1])]
        row = upto[at : to + 1] - upto[at]
        yield at, to, tree.grams_of(text, row if across else np.concatenate(([0], end)), DEPTH).view(np.int64), row
        at = to


def _counted(keys: list[np.ndarray], ns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return _summed(np.concatenate(keys), np.concatenate(ns)) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def counts(docs: DataFrame, across: bool = False) -> DataFrame:
    """Partial counts over the rows (text, train): of words (kind 0: key, n), and of contexts with their byte
    (kind 1: key is the subtree; steps of its sorted keys, and their counts); also contexts that only
    rows that don't train have, with n = 0."""

    def sent(kind: int, key: np.ndarray, n: np.ndarray, *packed: pa.Array) -> pa.RecordBatch:
        packed = packed or (pa.nulls(len(key), pa.binary()),) * 2
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int8)), pa.array(key), pa.array(n.astype(np.int64)), *packed], ["kind", "key", "n", "keys", "ns"])

    def packed(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        sub = (key >> (8 * (DEPTH + 1 - NEAR))) & ((1 << (8 * NEAR)) - 1)
        first = np.flatnonzero(np.diff(sub, prepend=-1))
        at = np.append(first, len(key))
        step = np.diff(key, prepend=0)
        step[first] = key[first]
        lists = [pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((at * x.itemsize).astype(np.int32)), pa.py_buffer(x)]) for x in (step, n.astype(np.int32))]
        return sent(1, sub[first], np.zeros(len(first)), *lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ns, held = [], [], 0
        for batch in batches:
            for part in slices(batch, "text", COUNT_BYTES):
                words = Words(part.column("text"), lower=True)
                train = np.asarray(part.column("train")).astype(bool)
                size = len(words.distinct)
                n = np.bincount(words.codes[train[words.rows]], minlength=size) if len(words) else np.zeros(size, np.int64)
                codes, words.codes = words.codes, np.arange(size)
                name = words.hashes()
                words.codes = codes
                yield sent(0, name[n > 0].view(np.int64), n[n > 0])
                for a, b, grams, row in _runs(words, *_strings(words.distinct), across):
                    trains = np.repeat(train[a:b], np.diff(row))
                    for some, weight in ((grams[trains], 1), (grams[~trains], 0)):
                        some.sort()
                        first = np.flatnonzero(np.concatenate(([True], some[1:] != some[:-1]))) if len(some) else np.zeros(0, np.int64)
                        keys.append(some[first])
                        ns.append(weight * np.diff(np.append(first, len(some))))
                        held += len(first)
                    if held > 2 * KEPT_CONTEXTS:
                        key, total = _counted(keys, ns)
                        if len(key) > KEPT_CONTEXTS:
                            yield packed(key, total)
                            key, total = key[:0], total[:0]
                        keys, ns, held = [key], [total], len(key)
        yield packed(*_counted(keys, ns))

    return docs.mapInArrow(run, "kind tinyint, key bigint, n bigint, keys binary, ns binary")


def subtrees(contexts: DataFrame) -> DataFrame:
    """From the partial counts of contexts: for each key n and the probabilities of its byte's bits at the root of its subtree (p), and, as
    rows with p null, each subtree's nodes at its root: sub, bit, prefix, a, b, log_w."""
    schema = "key bigint, n bigint, p array<float>, sub int, bit int, prefix int, a bigint, b bigint, log_w double"
    names = ["key", "n", "p", "sub", "bit", "prefix", "a", "b", "log_w"]

    def made(keys: list, ns: list) -> Iterator[pa.RecordBatch]:
        grams, n = _summed(np.concatenate(keys), np.concatenate(ns))
        grams = grams.view(np.uint64)
        levels = tree.levels(grams, n, DEPTH, NEAR)
        stop, below = tree.weighted(levels)
        p = tree.mixed_bits(levels, stop)
        k = len(grams)
        for i in range(0, k, 50_000):
            part = np.ascontiguousarray(p[:, i : i + 50_000].T)
            m = len(part)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * 8, pa.int32()), pa.array(part.ravel().astype(np.float32)))
            yield pa.RecordBatch.from_arrays([pa.array(grams[i : i + m].view(np.int64)), pa.array(n[i : i + m]), lists, *[pa.nulls(m, t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64())]], names)
        last = levels[-1][0]
        for bit in range(8):
            run, _, a, b = last.bits[bit]
            first = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
            prefix = ((last.grams[first] & np.uint64(255)) >> np.uint64(8 - bit)).astype(np.int32)
            sub = (last.grams[first] >> np.uint64(8)).astype(np.int32)
            m = len(first)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.list_(pa.float32())), pa.array(sub), pa.array(np.full(m, bit, np.int32)), pa.array(prefix), pa.array(a), pa.array(b), pa.array(below[bit])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keys, ns, held = None, [], [], 0
        for batch in batches:
            for sub, key, n in zip(*(batch.column(c) for c in ("sub", "keys", "ns")), strict=True):
                if sub.as_py() != at:
                    at = sub.as_py()
                    if held >= SUBTREES_KEYS:  # small subtrees are made together
                        yield from made(keys, ns)
                        keys, ns, held = [], [], 0
                keys.append(np.cumsum(np.frombuffer(key.as_buffer(), np.int64)))
                ns.append(np.frombuffer(n.as_buffer(), np.int32).astype(np.int64))
                held += len(keys[-1])
        if keys:
            yield from made(keys, ns)

    parts = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = contexts.select(F.col("key").cast("int").alias("sub"), "keys", "ns")
    return rows.repartition(parts, "sub").sortWithinPartitions("sub").mapInArrow(run, schema)


def scored_contexts(made: DataFrame) -> DataFrame:
    """key, n, log10 of its byte's probability."""
    nodes = made.where("p IS NULL").groupBy(F.shiftright("sub", 8).alias("sub"), "bit", "prefix").agg(*[F.sum(c).alias(c) for c in ("a", "b", "log_w")]).toArrow()
    top = tree.Top(*(np.asarray(nodes.column(c)) for c in ("sub", "bit", "prefix", "a", "b", "log_w")))
    sent = made.sparkSession.sparkContext.broadcast(top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                key = np.asarray(batch.column("key"))
                p = np.asarray(batch.column("p").flatten()).astype(np.float64).reshape(-1, 8).T
                near = (key >> (8 * (DEPTH - 1))) & 0xFFFF
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n"), pa.array(sent.value.mixed(near, key & 255, p) / np.log(10))], ["key", "n", "lp"])

    return made.where("p IS NOT NULL").select("key", "n", "p").mapInArrow(run, "key bigint, n bigint, lp double")


class Sent:
    """Sorted keys and values that executors look up."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        order = np.argsort(key)
        self.key, self.value = key[order], value[order]

    def get(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.key):
            return np.zeros(len(key)), np.zeros(len(key), bool)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        found = self.key[at] == key
        return np.where(found, self.value[at], 0), found


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: Column | None = None, across: bool = False) -> DataFrame:
    """For each row of docs: its id, held_out, n_tokens, n_known, train_tokens, base_score, score and
    bits_per_byte.

    Defined cases: a null text is empty and has the end token alone; a null id is in training; without
    any training row every count is 0 and every bit has probability 1/2; repeated rows count each; an
    empty table stays empty; other columns are not read.
    """
    spark = docs.sparkSession
    held = held_out(F.col(id_col)) if held is None else held
    base = docs.select(F.col(id_col).alias("doc"), held.alias("held_out"), F.col(text_col).alias("text"))
    table = written(counts(base.select("text", (~F.col("held_out")).alias("train")), across), "lm-counts")
    words = written(table.where("kind = 0").groupBy("key").agg(F.sum("n").alias("n")), "lm-words")
    trained = base.where("NOT held_out").count()
    sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, distinct = sums["n"] + trained, sums["v"] + (trained > 0)
    trees = written(subtrees(table.where("kind = 1")), "lm-trees")
    forget(table)
    contexts = written(scored_contexts(trees), "lm-contexts")
    forget(trees)

    top, all_words = most_frequent(words, "key", "n", SENT_WORDS)
    lps, few = most_frequent(contexts, "key", "n", SENT_CONTEXTS, "lp")
    as_np = lambda t, c: np.asarray(t.column(c).combine_chunks())
    sent_words = spark.sparkContext.broadcast(Sent(as_np(top, "key"), as_np(top, "n")))
    sent_lps = spark.sparkContext.broadcast(Sent(as_np(lps, "key"), as_np(lps, "lp")))
    end_n = trained

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column("text"), lower=True)
                rows = part.num_rows
                row, codes = w.rows, w.codes
                size = len(w.distinct)
                w.codes = np.arange(size)
                name = w.hashes().view(np.int64)
                w.codes = codes
                n, found = sent_words.value.get(name)
                here = lambda v: np.bincount(row, weights=v[codes], minlength=rows) if len(codes) else np.zeros(rows)  # noqa: E731,B023
                known = here((n > 0).astype(float)) + (end_n > 0)
                log_c = here(np.where(found, np.log10(n + 1), 0.0)) + np.log10(end_n + 1)
                data, bounds = _strings(w.distinct)
                length = here(np.diff(bounds)[:-1].astype(float)) + 1
                keys, kinds, times, counts_ = [np.zeros(0, np.int64)], [np.zeros(0, np.int8)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                value = np.zeros(rows)
                for a, b, grams, of in _runs(w, data, bounds, across):
                    order = np.argsort(grams)
                    sorted_ = grams[order]
                    first = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1])))
                    k = np.diff(np.append(first, len(sorted_)))
                    lp, sent = sent_lps.value.get(sorted_[first])
                    each = np.empty(len(grams))
                    each[order] = np.repeat(lp, k)
                    value[a:b] = np.add.reduceat(each, of[:-1])
                    if not sent.all():  # the others are joined
                        rest = order[np.repeat(~sent, k)]
                        r, g, t = _pairs(np.searchsorted(of, rest, "right") - 1 + a, grams[rest])
                        keys.append(g), kinds.append(np.ones(len(g), np.int8)), times.append(t), counts_.append(r)
                if not all_words:
                    rare = np.flatnonzero(~found[codes]) if len(codes) else np.zeros(0, np.int64)
                    r, g, t = _pairs(row[rare], name[codes[rare]])
                    keys.append(g), kinds.append(np.zeros(len(g), np.int8)), times.append(t), counts_.append(r)
                keys, kinds, times, counts_ = (np.concatenate(x) for x in (keys, kinds, times, counts_))
                order = np.argsort(counts_, kind="stable")
                cut = pa.array(np.searchsorted(counts_[order], np.arange(rows + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(cut, pa.array(x[order])) for x in (keys, kinds, times)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc"), part.column("held_out"), pa.array(w.counts + 1, pa.int64()), pa.array(length.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(log_c), pa.array(value), *lists],
                    ["doc", "held_out", "n_tokens", "n_bytes", "n_known", "log_c", "score", "keys", "kinds", "times"],
                )

    kind = base.schema["doc"].dataType.simpleString()
    part = base.mapInArrow(run, f"doc {kind}, held_out boolean, n_tokens bigint, n_bytes bigint, n_known bigint, log_c double, score double, keys array<bigint>, kinds array<tinyint>, times array<bigint>")
    part = written(part.withColumn("row", F.monotonically_increasing_id()), "lm-rows")
    out = part.select("row", "doc", "held_out", "n_tokens", "n_bytes", "n_known", "log_c", "score")
    if not (all_words and few):
        rest = part.select("row", F.explode(F.arrays_zip("keys", "kinds", "times")).alias("x")).select("row", F.col("x.keys").alias("key"), F.col("x.kinds").alias("kind"), "x.times")
        values = words.select(F.lit(0).cast("tinyint").alias("kind"), "key", F.log10(F.col("n") + 1).alias("v"))
        if not few:
            values = values.unionByName(contexts.select(F.lit(1).cast("tinyint").alias("kind"), "key", F.col("lp").alias("v")))
        rest = rest.join(values, ["kind", "key"])
        word = F.col("kind") == 0
        rest = rest.groupBy("row").agg(
            F.sum(F.when(word, F.col("times")).otherwise(0)).alias("k2"), F.sum(F.when(word, F.col("times") * F.col("v")).otherwise(0.0)).alias("c2"), F.sum(F.when(~word, F.col("times") * F.col("v")).otherwise(0.0)).alias("s2")
        )
        out = out.join(rest, "row", "left").select(
            "doc", "held_out", "n_tokens", "n_bytes", (F.col("n_known") + F.coalesce("k2", F.lit(0))).alias("n_known"), (F.col("log_c") + F.coalesce("c2", F.lit(0.0))).alias("log_c"), (F.col("score") + F.coalesce("s2", F.lit(0.0))).alias("score")
        )
    return out.select(
        F.col("doc").alias(id_col),
        "held_out",
        "n_tokens",
        F.col("n_known").cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("log_c") - F.col("n_tokens") * F.lit(float(np.log10(total + distinct + 1)))).alias("base_score"),
        "score",
        (-F.col("score") / F.lit(float(np.log10(2))) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def _pairs(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, key) and how often each comes."""
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])))) if len(row) else np.zeros(0, np.int64)
    return row[first], key[first], np.diff(np.append(first, len(row)))
