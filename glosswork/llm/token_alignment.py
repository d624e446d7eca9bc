"""Alignment of two tokenizers' tokens by the bytes at which both end.

Neither tokenizer ever joins what stands on both sides of a blank that follows another character, so texts are cut there into
pieces (a slice of texts numbers its distinct pieces), and each distinct piece of the corpus is aligned once, in plain Spark: its
tokens are exploded, their ends are windowed sums of lengths, tokens of both sides are joined on piece and end, running counts of the
common ends number the groups, and the groups of both sides are joined. What a piece says of links is weighted by its
occurrences. Last, each slice gets its pieces' results back and strings them together for its documents.

A tokenizer pair for which the cut isn't safe (it is judged by pattern and vocabulary) gets whole texts as pieces.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glosswork.llm.shared import forget, small, written
from glosswork.llm.words import plain, slices

SLICE_BYTES = 12 << 20
ENCODED = 2000  # pieces that go to a tokenizer at once
MOST_PAIRS = 500_000  # pairs of ids that may be broadcast
SALT = 16
NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
SPACE = "▁"


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class First:
    """A byte-level tokenizer's file: ids of texts as they stand, special tokens being plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        letters = byte_letters()
        self.bytes = [b""] * self.model.get_vocab_size()
        for token, i in self.model.get_vocab().items():
            if all(c in letters for c in token):
                self.bytes[i] = bytes(letters[c] for c in token)
        self.sizes = np.array([len(x) for x in self.bytes], np.int32)

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]


class Second:
    """A piece model: it puts a blank before a text, which a line feed in front, whose tokens are taken off again, keeps
    away from what follows."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        of = self.model
        self.bytes = [bytes([int(of.id_to_piece(i)[3:5], 16)]) if of.is_byte(i) else of.id_to_piece(i).replace(SPACE, " ").encode() for i in range(of.get_piece_size())]
        self.sizes = np.array([len(x) for x in self.bytes], np.int32)
        self.front = of.encode("\n")

    def __call__(self, texts: list[str]) -> list[list[int]]:
        n = len(self.front)
        out = self.model.encode([f"\n{t}" for t in texts], num_threads=1)
        if any(x[:n] != self.front for x in out):
            raise ValueError("the piece model joins a line feed with what follows")
        return [x[n:] for x in out]


@lru_cache(1)
def _sides(first: str, second: str) -> tuple[First, Second]:
    """Both tokenizers, loaded once in a worker."""
    return First(first), Second(second)


@lru_cache(1)
def can_cut(first: str, second: str) -> bool:
    """Whether no token of either has a blank or a line feed after another character, and texts are taken as they stand."""
    with open(first, encoding="utf-8") as f:
        spec = json.load(f)
    split = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or split.get("type") != "ByteLevel" or not split.get("use_regex", True) or split.get("add_prefix_space"):
        return False
    model = Second(second)
    text = "  a b  \n\tc  é … ﬁ Ａ "
    if b"".join(model.bytes[i] for i in model([text])[0]) != text.encode():
        return False
    names = (model.model.id_to_piece(i) for i in range(model.model.get_piece_size()) if not model.model.is_byte(i))
    return not any("\n" in x or " " in x or SPACE in x.lstrip(SPACE) for x in names)


def cuts(data: np.ndarray) -> np.ndarray:
    """Places in UTF-8 at which a blank or a line feed follows a character that is no white space."""
    at = np.flatnonzero((data == 32) | (data == 10))
    at = at[at > 0]
    last = data[at - 1]
    ok = (last > 32) & (last < 127)
    two, three = data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    wide = last >= 128
    # other white space ends in C2 85, C2 A0, E1 9A x, E2 80 x, E2 81 x or E3 80 x
    odd = ((two == 0xC2) & ((last == 0x85) | (last == 0xA0))) | (((three == 0xE1) | (three == 0xE2) | (three == 0xE3)) & ((two == 0x9A) | (two == 0x80) | (two == 0x81)))
    return at[ok | (wide & ~odd)]


def _pieces(texts: pa.Array, cut: bool) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Bounds (rows + 1) into the pieces, which are a dictionary and numbers into it. A blank is put before each text;
    an empty text has no pieces."""
    texts = plain(texts)
    spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))
    spaced = pc.if_else(pc.equal(pc.binary_length(texts), 0), pa.scalar("", pa.large_string()), spaced)
    _, offsets, body = spaced.buffers()
    starts = np.frombuffer(offsets, np.int64)[spaced.offset : spaced.offset + len(spaced) + 1]
    data = np.frombuffer(body, np.uint8)[: starts[-1]] if body is not None else np.zeros(0, np.uint8)
    marks = np.zeros(len(data) + 1, bool)
    marks[starts] = True
    if cut:
        marks[cuts(data)] = True
    edges = np.flatnonzero(marks)
    bounds = np.searchsorted(edges, starts)
    values = pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges.astype(np.int64)), body if body is not None else pa.py_buffer(b""))
    coded = values.dictionary_encode()
    return bounds, coded.dictionary, np.asarray(coded.indices).astype(np.int32)


def _sliced(docs: DataFrame, first: str, second: str, id_col: str, text_col: str) -> DataFrame:
    """A table of each slice's documents (with the numbers of their pieces) and of its distinct pieces."""
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    kind = rows.schema["doc"].dataType.simpleString()
    names = ["slice", "doc", "codes", "code", "piece", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                bounds, distinct, codes = _pieces(part.column("text"), can_cut(first, second))
                here = part.column("row")[0].as_py()
                body = codes.astype("<i4").tobytes()
                of_docs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(4 * bounds.astype(np.int64)), pa.py_buffer(body)])
                for i in range(0, part.num_rows, 1000):
                    m = min(1000, part.num_rows - i)
                    yield pa.RecordBatch.from_arrays([pa.array([here] * m, pa.int64()), part.column("doc").slice(i, m), of_docs.slice(i, m).cast(pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.string()), pa.nulls(m, pa.int64())], names)
                count = np.bincount(codes, minlength=len(distinct))
                for i in range(0, len(distinct), 20_000):
                    some = distinct.slice(i, 20_000)
                    m = len(some)
                    yield pa.RecordBatch.from_arrays([pa.array([here] * m, pa.int64()), pa.nulls(m, part.column("doc").type), pa.nulls(m, pa.binary()), pa.array(np.arange(i, i + m), pa.int32()), some.cast(pa.string()), pa.array(count[i : i + m], pa.int64())], names)

    return written(rows.mapInArrow(run, f"slice bigint, doc {kind}, codes binary, code int, piece string, n bigint"), "slices")


def encoded(pieces: DataFrame, first: str, second: str) -> DataFrame:
    """key, piece, n with both sides' ids and byte lengths, and whether both sides' bytes are the piece."""
    kinds = "key bigint, piece string, n bigint, ok boolean, a array<int>, a_len array<int>, b array<int>, b_len array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = _sides(first, second)
            for i in range(0, batch.num_rows, ENCODED):
                part = batch.slice(i, ENCODED)
                texts = part.column("piece").to_pylist()
                raw = [t.encode() for t in texts]
                ok, out = np.ones(len(texts), bool), []
                for side in sides:
                    ids = side(texts)
                    bounds = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
                    flat = np.fromiter(chain.from_iterable(ids), np.int32, bounds[-1])
                    upto = np.concatenate(([0], np.cumsum(side.sizes[flat])))[bounds]
                    said = b"".join([side.bytes[x] for x in flat.tolist()])
                    ok &= [said[a:b] == t for a, b, t in zip(upto[:-1].tolist(), upto[1:].tolist(), raw, strict=True)]
                    offsets = pa.array(bounds, pa.int32())
                    out += [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (flat, side.sizes[flat])]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("key", "piece", "n")), pa.array(ok), *out], ["key", "piece", "n", "ok", "a", "a_len", "b", "b_len"])

    return pieces.mapInArrow(run, kinds)


def tokens(pieces: DataFrame, side: str) -> DataFrame:
    """key, end (bytes from the piece's start) and id of one side's tokens."""
    rows = pieces.where("ok").select("key", F.posexplode(F.arrays_zip(F.col(side).alias("id"), F.col(f"{side}_len").alias("len"))).alias("pos", "t"))
    upto = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("key", F.col("t.id").alias(f"{side}_id"), F.sum("t.len").over(upto).alias("end"))


def common_ends(pieces: DataFrame) -> DataFrame:
    """key, end and `ids` of all tokens: those of both sides that end there, plus one each and in one number, 0 for none."""
    dealt = pieces.repartition(F.col("key"))
    ends = tokens(dealt, "a").join(tokens(dealt, "b"), ["key", "end"], "full")
    one = lambda c: F.coalesce(F.col(c) + 1, F.lit(0))
    return ends.select("key", "end", (F.shiftleft(one("a_id").cast("long"), 32) + one("b_id")).alias("ids"))


def aligned_pieces(pieces: DataFrame, ends: DataFrame) -> DataFrame:
    """key, piece, n, n_a, n_b, groups (each with a semicolon after it) and links (a's id times 2 to the 32nd, plus b's) of the pieces;
    where the bytes of a side differ all of these are null. A token's group is the number of common ends before its own end."""
    of_a, of_b = F.shiftright("ids", 32), F.col("ids").bitwiseAND(0xFFFFFFFF)
    before = Window.partitionBy("key").orderBy("end").rowsBetween(Window.unboundedPreceding, -1)
    cut = (of_a > 0) & (of_b > 0)
    ends = ends.withColumn("part", F.count_if(cut).over(before)).withColumns({"a_id": F.when(of_a > 0, of_a - 1), "b_id": F.when(of_b > 0, of_b - 1)})
    ends = ends.withColumn("link", F.shiftleft("a_id", 32) + F.col("b_id"))  # null where only one side ends
    items = F.array_sort(F.collect_list(F.struct("end", "a_id", "b_id")))
    said = lambda c: F.array_join(F.transform("x", lambda x: x[c].cast("string")), ",")  # noqa: E731  nulls are left out
    parts = ends.groupBy("key", "part").agg(items.alias("x"), F.max("link").alias("link"), F.count("a_id").alias("n_a"), F.count("b_id").alias("n_b"))
    parts = parts.select("key", "n_a", "n_b", F.struct("part", F.concat(said("a_id"), F.lit("|"), said("b_id"), F.lit(";")).alias("s"), "link").alias("g"))
    out = parts.groupBy("key").agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"), F.array_sort(F.collect_list("g")).alias("g"))
    out = out.select("key", "n_a", "n_b", F.array_join(F.transform("g", lambda x: x["s"]), "").alias("groups"), F.transform("g", lambda x: x["link"]).alias("links"))
    return pieces.select("key", "piece", "n").join(out, "key", "left")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """link (a pair of ids), count (its links in the whole corpus) and best (whether no pair of its b id has more)."""
    counts = aligned.select("n", F.explode("links").alias("link")).groupBy("link").agg(F.sum("n").alias("count"))
    best = Window.partitionBy(F.col("link").bitwiseAND(0xFFFFFFFF))
    return counts.withColumn("best", F.col("count") == F.max("count").over(best))


def _scored(aligned: DataFrame, pairs: DataFrame) -> DataFrame:
    """piece and said: its NUMBERS, comma-joined, a hash sign and its groups. One text is shorter than seven columns, and a piece's is
    sent to every slice that has it."""
    links = aligned.select("key", F.explode("links").alias("link"))
    few = small(pairs, MOST_PAIRS)
    if few is pairs:  # a pair may hold a great part of the links
        links = links.withColumn("salt", F.col("key") % SALT)
        few = pairs.withColumn("salt", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALT)])))
    sums = links.join(few, [c for c in links.columns if c in few.columns]).groupBy("key").agg(F.count_if("best").alias("n_best"), F.sum("count").alias("count_sum"))
    n = F.size("links").cast("long")
    numbers = F.concat_ws(",", "n_a", "n_b", n, n, "n_best", "count_sum")
    return aligned.join(sums, "key").select("piece", F.concat(numbers, F.lit("#"), "groups").alias("said"))


def align(docs: DataFrame, first: str, second: str, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's id, the columns of NUMBERS, and `groups` (its groups' ids as a1,a2|b1;a3|b2), or with `digest` the SHA-256 of
    these in `groups_sha256`. first: a byte-level tokenizer's file, second: a piece model's.

    Defined cases: a null or empty text, and one that either side doesn't give back byte by byte, has zeros and an empty
    string; ties for the highest count are all best; rows of one id are aligned and counted each by itself; other columns of docs are
    left out, whatever their names; an empty table gives no rows.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    both = _sliced(docs, first, second, id_col, text_col)
    of_pieces = both.where("code IS NOT NULL").select("slice", "code", "piece", "n")
    again = spark.read.schema(both.schema).parquet(both._written)  # columns of its own, for the joins by slice
    of_docs = again.where("code IS NULL").select("slice", "doc", "codes")
    distinct = of_pieces.groupBy("piece").agg(F.sum("n").alias("n")).select(F.monotonically_increasing_id().alias("key"), "piece", "n")
    coded = written(encoded(distinct, first, second), "coded")
    pieces = coded
    if not (bad := coded.where("NOT ok")).isEmpty():  # their documents have no tokens, so what else these hold isn't counted
        fewer = of_pieces.join(_lost(of_docs, of_pieces.join(bad.select("piece"), "piece")), ["slice", "code"]).groupBy("piece").agg(F.sum("lost").alias("lost"))
        pieces = coded.join(fewer, "piece", "left").withColumn("n", F.col("n") - F.coalesce("lost", F.lit(0))).drop("lost")
    before = spark.conf.get(_SUBSET)
    spark.conf.set(_SUBSET, "false")  # what is dealt by piece can be joined on piece and end without being dealt again
    try:
        ends = written(common_ends(pieces), "ends")
    finally:
        spark.conf.set(_SUBSET, before)
    aligned = written(aligned_pieces(pieces, ends), "aligned")
    forget(coded)
    forget(ends)
    pairs = written(pair_counts(aligned), "pairs")
    results = written(_scored(aligned, pairs), "scored")
    forget(aligned)
    forget(pairs)
    back = written(of_pieces.select("slice", "code", "piece").join(results, "piece", "left").drop("piece"), "results")
    forget(results)
    return _strung(of_docs, back, kind, digest, id_col)


_SUBSET = "spark.sql.requireAllClusterKeysForCoPartition"


def _lost(of_docs: DataFrame, bad: DataFrame) -> DataFrame:
    """slice, code and lost: how often each piece stands in documents that hold a bad one."""

    def run(key: tuple, docs: pa.Table, pieces: pa.Table) -> pa.Table:
        codes = np.asarray(pieces.column("code"))
        held = [np.frombuffer(x or b"", "<i4") for x in (docs.column("codes").to_pylist() if len(codes) else [])]
        held = [x for x in held if np.isin(x, codes).any()]
        code, n = np.unique(np.concatenate([np.zeros(0, "<i4"), *held]), return_counts=True)
        return pa.table({"slice": pa.array([key[0].as_py()] * len(code), pa.int64()), "code": pa.array(code, pa.int32()), "lost": pa.array(n, pa.int64())})

    return of_docs.select("slice", "codes").groupBy("slice").cogroup(bad.select("slice", "code").groupBy("slice")).applyInArrow(run, "slice bigint, code int, lost bigint")


def _strung(of_docs: DataFrame, results: DataFrame, kind: str, digest: bool, id_col: str) -> DataFrame:
    """Puts the results of each slice's pieces together for its documents."""

    def run(docs: pa.Table, pieces: pa.Table) -> pa.Table:
        place_of = np.empty(pieces.num_rows, np.int64)
        place_of[np.asarray(pieces.column("code"))] = np.arange(pieces.num_rows)
        good = np.asarray(pc.is_valid(pieces.column("said")), bool) if pieces.num_rows else np.zeros(0, bool)
        split = pc.split_pattern(pc.replace_with_mask(plain(pieces.column("said")), pa.array(~good), pa.scalar(f"{','.join('0' * len(NUMBERS))}#", pa.large_string())), "#", max_splits=1) if len(good) else None
        halves = split.flatten() if len(good) else pa.array([], pa.large_string())
        groups = halves.take(pa.array(np.arange(1, len(halves), 2))).cast(pa.large_binary())
        numbers = pc.split_pattern(halves.take(pa.array(np.arange(0, len(halves), 2))), ",").flatten().cast(pa.int64()) if len(good) else pa.array([], pa.int64())
        numbers = np.asarray(numbers).reshape(-1, len(NUMBERS)).T
        ids, sums, texts = [], [], []
        for batch in docs.to_batches():
            for codes in batch.column("codes").to_pylist():
                at = place_of[np.frombuffer(codes or b"", "<i4")]
                whole = len(at) > 0 and bool(good[at].all())
                sums.append(numbers[:, at].sum(1) if whole else np.zeros(len(NUMBERS), np.int64))
                said = b""
                if whole:
                    taken = groups.take(pa.array(at))
                    _, offsets, body = taken.buffers()
                    offsets = np.frombuffer(offsets, np.int64)
                    said = memoryview(body)[offsets[taken.offset] : offsets[taken.offset + len(taken)] - 1]
                texts.append((hashlib.sha256(said).hexdigest() if digest and whole else bytes(said).decode()))
            ids.append(batch.column("doc"))
        del halves, groups, numbers
        pa.default_memory_pool().release_unused()  # an idle worker keeps no more than it needs
        sums = np.array(sums, np.int64).reshape(-1, len(NUMBERS))
        out = [pa.chunked_array(ids, docs.schema.field("doc").type), *[pa.array(sums[:, i]) for i in range(len(NUMBERS))], pa.array(texts, pa.string())]
        return pa.Table.from_arrays(out, [id_col, *NUMBERS, "said"])

    both = of_docs.groupBy("slice").cogroup(results.groupBy("slice"))
    out = both.applyInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{c} bigint" for c in NUMBERS) + ", said string")
    return out.withColumnRenamed("said", "groups_sha256" if digest else "groups")
