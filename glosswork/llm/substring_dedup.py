"""Removal of long repeated word runs through a compacted de Bruijn graph.

A window is `window` consecutive words. Its anchor is the least hash among the `window // 2`-word k-mers
inside it, so equal windows have equal anchors, whatever stands around them. A run of neighbouring
windows with one anchor is an edge (about one for each 13 words instead of one for each word), named by a
hash of all its words; the runs of a document that follow one another are a path in the graph.

1. One pass over the texts writes each document's edges. Edges whose anchor is in one document only are
   out; the others are few.
2. Nonbranching paths of edges that several documents share are compacted by joins: an edge and its
   successor belong together when every occurrence of either is followed, or preceded, by the other;
   pointer doubling names each edge's path and place in it in a logarithmic number of joins.
3. An occurrence of a path is a span. It counts only where the coordinates agree: the path's last edge
   must stand in the document at the place that the path's length gives. A span whose path also occurs in
   a document with a smaller id is removed.
4. Where edges differ although an anchor is shared (at the ends of repeated passages), the windows
   themselves are compared: only their hashes, from only the documents concerned, are shuffled.
5. The spans are cut from the texts.

Groups are only ever counted or reduced to a least id, with partial sums before the shuffle, and joins of a
hot anchor or edge can be split; no group's rows are gathered in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswork.llm.shared import written
from glosswork.llm.words import Words, mixed, run_hashes, run_starts, slices

WINDOW = 50


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    done, out = 1, x
    while done * 2 <= width:
        out = np.minimum(out[: len(out) - done], out[done:])
        done *= 2
    rest = width - done
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def edges(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first window (position in the row), number of windows, anchor and hash of each edge of a slice."""
    starts = run_starts(words.bounds, window)
    none = np.zeros(0, np.int64)
    if not len(starts):
        return none, none, none, none, none
    k = max(1, window // 2)
    h = words.hashes()
    # a k-mer's rank is its hash, mixed once more; the windows' own hashes name the edges
    anchor = _least(mixed(run_hashes(h, k) ^ np.uint64(0x5851F42D4C957F2D)), window - k + 1)[starts]
    whole = run_hashes(h, window)[starts]
    row = words.rows[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    # a longer run (an anchor that repeats) is cut, so that its end windows still cover its words
    since = np.arange(len(starts)) - np.repeat(first, np.diff(np.append(first, len(starts))))
    new |= since % (window - k + 1) == 0
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(starts)))
    name = mixed(mixed(whole[first] * np.uint64(3) + n.astype(np.uint64)) ^ whole[first + n - 1]) ^ mixed(anchor[first])
    return row[first], starts[first] - words.bounds[row[first]], n, anchor[first].view(np.int64), name.view(np.int64)


def joined(words: Words) -> pa.Array:
    """Each row's words with one space between them."""
    lists = pa.ListArray.from_arrays(pa.array(words.bounds, pa.int32()), words.distinct.cast(pa.string()).take(pa.array(words.codes)))
    return pc.binary_join(lists, " ")


def _sha(texts: pa.Array) -> list[str]:
    return [hashlib.sha256(t).hexdigest() for t in texts.cast(pa.binary()).to_pylist()]


def measured(docs: DataFrame, window: int) -> DataFrame:
    """For each row (doc, key, text): doc, key, n_words, sha (of all its words), and its edges as three lists and their starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                row, start, n, anchor, name = edges(words, window)
                bounds = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x.astype(t))) for x, t in ((start, np.int32), (n, np.int32), (anchor, np.int64), (name, np.int64))]
                yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("key"), pa.array(words.counts, pa.int64()), pa.array(_sha(joined(words))), *lists], ["doc", "key", "n_words", "sha", "start", "n", "anchor", "edge"])

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc {kind}, key bigint, n_words bigint, sha string, start array<int>, n array<int>, anchor array<bigint>, edge array<bigint>")


def compacted(occurrences: DataFrame) -> DataFrame:
    """edge, path, at (edges before it in its path), offset (windows before it), for each shared edge.

    occurrences: doc, key, start, n, edge. A path is named by its first edge; in a cycle every edge stays alone.
    """
    nodes = occurrences.groupBy("edge").agg(F.count(F.lit(1)).alias("times"), F.first("n").alias("n"))
    a = occurrences.select("doc", "key", (F.col("start") + F.col("n")).alias("next"), F.col("edge").alias("e"))
    b = occurrences.select("doc", "key", F.col("start").alias("next"), F.col("edge").alias("f"))
    links = a.join(b, ["doc", "key", "next"]).groupBy("e", "f").agg(F.count(F.lit(1)).alias("times"))
    t = nodes.select("edge", "times")
    links = links.where("e <> f").join(t.withColumnRenamed("edge", "e"), ["e", "times"]).join(t.withColumnRenamed("edge", "f"), ["f", "times"])
    links = links.select(F.col("f").alias("edge"), F.col("e").alias("back"))
    # pointer doubling: head is the edge `at` steps (and `offset` windows) back
    n = nodes.select("edge", "n")
    cur = n.join(links, "edge", "left").join(n.select(F.col("edge").alias("back"), F.col("n").alias("m")), "back", "left")
    cur = written(cur.select("edge", F.coalesce("back", "edge").alias("head"), F.col("back").isNotNull().cast("long").alias("at"), F.coalesce(F.col("m").cast("long"), F.lit(0)).alias("offset")), "unitigs")
    moving = cur.where("at > 0").count()
    for _ in range(40):
        if not moving:
            break
        up = cur.where("at > 0").select(F.col("edge").alias("head"), F.col("head").alias("head2"), F.col("at").alias("at2"), F.col("offset").alias("offset2"))
        nxt = written(
            cur.join(up, "head", "left").select("edge", F.coalesce("head2", "head").alias("head"), (F.col("at") + F.coalesce("at2", F.lit(0))).alias("at"), (F.col("offset") + F.coalesce("offset2", F.lit(0))).alias("offset"), F.col("head2").isNotNull().alias("moved")),
            "unitigs",
        )
        moving = nxt.where("moved").count()
        cur = nxt.drop("moved")
    else:  # what still moves runs in circles
        cur = nxt.select("edge", F.when(F.col("moved"), F.col("edge")).otherwise(F.col("head")).alias("head"), F.when(F.col("moved"), 0).otherwise(F.col("at")).alias("at"), F.when(F.col("moved"), 0).otherwise(F.col("offset")).alias("offset"))
    return cur.withColumnRenamed("head", "path")


def spans(occurrences: DataFrame, paths: DataFrame) -> DataFrame:
    """path, doc, key, start, n (windows) of each verified occurrence of a path of shared edges."""
    length = paths.join(occurrences.groupBy("edge").agg(F.first("n").alias("n")), "edge").groupBy("path").agg(F.max("at").alias("last"), F.max(F.col("offset") + F.col("n")).alias("total"))
    placed = occurrences.join(paths, "edge").join(length, "path").withColumn("from", F.col("start") - F.col("offset"))
    ends = placed.where((F.col("at") == 0) | (F.col("at") == F.col("last")))
    sides = ends.groupBy("path", "doc", "key", "from", "total").agg(F.max((F.col("at") == 0).cast("int")).alias("head"), F.max((F.col("at") == F.col("last")).cast("int")).alias("tail"))
    return sides.where("head = 1 AND tail = 1").select("path", "doc", "key", F.col("from").alias("start"), F.col("total").alias("n"))


def _window_hashes(texts: DataFrame, window: int) -> DataFrame:
    """texts: doc, key, text, wanted array<struct<start,n,ask>>. A row for each wanted window: doc, key, at,
    h, ask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                whole = run_hashes(words.hashes(), window)
                lists = part.column("wanted")
                bounds = np.asarray(lists.offsets).astype(np.int64)
                items = lists.values.slice(bounds[0], bounds[-1] - bounds[0])
                start, n, ask = (np.asarray(items.field(i)).astype(np.int64) for i in range(3))
                row = np.repeat(np.arange(part.num_rows), np.diff(bounds))
                each = np.repeat(np.arange(len(start)), n)
                at = start[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                where = words.bounds[row[each]] + at
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc").take(pa.array(row[each])), part.column("key").take(pa.array(row[each])), pa.array(at, pa.int32()), pa.array(whole[where].view(np.int64)), pa.array(ask[each] > 0)], ["doc", "key", "at", "h", "ask"]
                )

    kind = texts.schema["doc"].dataType.simpleString()
    return texts.select("doc", "key", "text", "wanted").mapInArrow(run, f"doc {kind}, key bigint, at int, h bigint, ask boolean")


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """For each row of docs: its id, n_words, n_removed, kept_sha256, and spans (the removed word runs).

    Defined cases: a row without an id neither removes nor loses words; rows of one id never remove each
    other's words; null, empty and short texts lose nothing; repeats inside one document stay; an
    empty table stays empty; other columns are not read.
    """
    # rows of one id are told apart by their texts
    base = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    table = written(measured(base, window), "edges")
    every = table.where("doc IS NOT NULL").select("doc", "key", F.explode(F.arrays_zip("start", "n", "anchor", "edge")).alias("x")).select("doc", "key", "x.*")
    shared = every.groupBy("anchor").agg(F.min("doc").alias("a_first"), F.max("doc").alias("a_last")).where("a_first < a_last").select("anchor", "a_first")
    near = written(every.join(shared, "anchor"), "shared-anchors")

    owner = near.groupBy("edge").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
    repeated = owner.where("first < last").select("edge", "first")
    occurrences = written(near.join(repeated, "edge").select("doc", "key", "start", "n", "edge"), "shared-edges")
    found = written(spans(occurrences, compacted(occurrences)), "spans")
    firsts = found.groupBy("path").agg(F.min("doc").alias("first"))
    whole = written(found.join(firsts, "path").where("first < doc").select("doc", "key", "start", "n"), "whole-spans")

    # windows at the ends of passages: an edge that no smaller document has, with an anchor that one has
    asking = near.join(owner.select("edge", "first"), "edge").where("first = doc AND a_first < doc")
    names = asking.groupBy("anchor").agg(F.max("doc").alias("most"))
    wanted = near.join(names, "anchor").where("doc <= most").join(owner.select("edge", "first"), "edge").where("first = doc")
    wanted = wanted.groupBy("doc", "key").agg(F.collect_set(F.struct("start", "n", (F.col("a_first") < F.col("doc")).cast("int").alias("ask"))).alias("wanted"))
    lists = written(wanted, "window-lists")
    concerned = written(base.join(near.select("doc", "key").distinct(), ["doc", "key"], "left_semi"), "concerned")
    hashes = written(_window_hashes(concerned.join(lists, ["doc", "key"]), window), "window-hashes")
    least = hashes.groupBy("h").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
    single = hashes.where("ask").join(least, "h").where("first < doc").select("doc", "key", F.col("at").alias("start"), F.lit(1).cast("long").alias("n"))

    runs = whole.select("doc", "key", "start", F.col("n").cast("long").alias("n")).unionByName(single)
    lists = written(runs.groupBy("doc", "key").agg(F.collect_set(F.struct("start", "n")).alias("runs")), "runs")
    cut = _cut(concerned.join(lists, ["doc", "key"]), window)
    rest = table.join(lists.select("doc", "key"), ["doc", "key"], "left_anti")
    rest = rest.select("doc", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"), F.array().cast("array<struct<start:bigint,n:bigint>>").alias("spans"))
    return cut.unionByName(rest).withColumnRenamed("doc", id_col)


def _cut(texts: DataFrame, window: int) -> DataFrame:
    """texts: doc, text, runs array<struct<start,n>> of windows whose words go."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                lists = part.column("runs")
                bounds = np.asarray(lists.offsets).astype(np.int64)
                items = lists.values.slice(bounds[0], bounds[-1] - bounds[0])
                start, n = (np.asarray(items.field(i)).astype(np.int64) for i in range(2))
                row = np.repeat(np.arange(part.num_rows), np.diff(bounds))
                # spans can end where another document's words begin: one mark more for each row
                edge = np.zeros(len(words) + part.num_rows + 1, np.int64)
                at = words.bounds[row] + row + start
                np.add.at(edge, at, 1)
                np.add.at(edge, at + n - 1 + window, -1)
                gone = np.cumsum(edge) > 0
                places = np.arange(len(words)) + words.rows
                gone_word = gone[places]
                upto = np.concatenate(([0], np.cumsum(gone_word)))
                lost = upto[words.bounds[1:]] - upto[words.bounds[:-1]]
                left = Words.__new__(Words)
                left.codes, left.distinct = words.codes[~gone_word], words.distinct
                left.bounds = words.bounds - upto[words.bounds]
                found: list[list] = [[] for _ in range(part.num_rows)]
                step = np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))
                first = words.bounds[:-1] + np.arange(part.num_rows)
                for a, b in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True):
                    r = int(np.searchsorted(first, a, "right")) - 1
                    found[r].append({"start": a - int(first[r]), "n": b - a})
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc"), pa.array(words.counts, pa.int64()), pa.array(lost, pa.int64()), pa.array(_sha(joined(left))), pa.array(found, span)],
                    ["doc", "n_words", "n_removed", "kept_sha256", "spans"],
                )

    kind = texts.schema["doc"].dataType.simpleString()
    return texts.select("doc", "text", "runs").mapInArrow(run, f"doc {kind}, n_words bigint, n_removed bigint, kept_sha256 string, spans array<struct<start:bigint,n:bigint>>")
