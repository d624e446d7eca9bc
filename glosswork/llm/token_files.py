"""Token ids of whole texts in Parquet files that can be read in part.

The files hold one row for each document in ascending id order: its id, its place in the sequence of all
ids, its length, and the ids themselves as a list. Ids are dictionary-coded (a word vocabulary is small),
ids and places of documents delta-coded by the version-2 writer; row groups and pages are small enough
for the column and page indexes to lead a reader to a few documents without the rest of the file, and the
list column is not touched by reads of the metadata.

Texts, which are smaller than their ids, are what the one range shuffle carries; they are encoded after it,
in file order. A worker encodes the distinct white-space words of a slice of texts and joins the pieces: the
tokenizer drops white space and never merges across it.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glosswork.llm.shared import place
from glosswork.llm.words import Words, slices

END = 2
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
SLICE_BYTES = 8 << 20
CHUNK = 256
MARK = "\x01"
MARKS = "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"
LATIN = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+$"


def gathered(flat: np.ndarray, size: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of flat (`size` long each) that index names, one after the other, and their sizes."""
    if not len(index):
        return flat[:0], np.zeros(0, np.int64)
    n = size[index]
    upto = np.cumsum(n)
    start = np.cumsum(size) - size
    return flat[np.arange(upto[-1]) + np.repeat(start[index] - (upto - n), n)], n


class Encoder:
    """Ids of white-space words.

    A word of Latin letters, which may end in marks, is a unit of the tokenizer and a second one of marks.
    Its letters, lower-cased and with their bytes spelt as the vocabulary spells them, go to the tokenizer
    without its normaliser and its pattern; thousands are encoded as one text and told apart by the ids
    that end a word. All else goes to the whole tokenizer, words being parted by a control character whose id tells
    them apart, or one by one where a word holds that character. A tokenizer of other parts than lower
    case, one pattern, bytes and word ends gets all words that second way.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        mark = self._encode(self.whole, [MARK])[0]
        self.mark = mark[0] if len(mark) == 1 else None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        suffix = spec["model"].get("end_of_word_suffix")
        kinds = [x["type"] for part, of in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")) for x in (spec[part] or {}).get(of, [])]
        self.bare = None
        if suffix and kinds == ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"]:
            self.bare = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}}))
            vocabulary = self.whole.get_vocab()
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
            bytes_ = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            latin = [c for c in map(chr, range(0x250)) if c.isalpha()]
            self.spelt = {}
            for c in latin:  # how a letter's bytes are spelt
                self.spelt |= zip(c.encode(), bytes_.pre_tokenize_str(c)[0][0], strict=True)

    @staticmethod
    def _encode(tokenizer, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _any(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after the other, and the number of each word's."""
        flat, sizes = [], []
        for i in range(0, len(words), CHUNK):
            part = words[i : i + CHUNK]
            ids = np.array(self._encode(self.whole, [f" {MARK} ".join(part)])[0], np.uint32)
            marks = np.flatnonzero(ids == self.mark) if self.mark is not None else ids[:0]
            if self.mark is not None and len(marks) == len(part) - 1:
                flat.append(np.delete(ids, marks))
                sizes.append(np.diff(np.concatenate(([-1], marks, [len(ids)]))) - 1)
            else:
                one = self._encode(self.whole, part)
                flat.append(np.array([x for ids in one for x in ids], np.uint32))
                sizes.append(np.fromiter(map(len, one), np.int64, len(one)))
        return _joined(flat, sizes)

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of lower-case words of Latin letters."""
        flat, sizes = [], []
        for i in range(0, len(words), CHUNK):
            part = words[i : i + CHUNK]
            text = " ".join(part).encode().decode("latin-1").translate(self.spelt)
            ids = np.array(self._encode(self.bare, [text])[0], np.uint32)
            ends = np.flatnonzero(self.last[ids])
            if len(ends) != len(part) or ends[-1] != len(ids) - 1:
                ids, n = self._any(part)
            else:
                n = np.diff(np.concatenate(([-1], ends)))
            flat.append(ids)
            sizes.append(n)
        return _joined(flat, sizes)

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words one after the other, and the number of each word's."""
        if self.bare is None or not len(words):
            return self._any(words.to_pylist())
        body = pc.utf8_rtrim(words, characters=MARKS)
        plain = np.asarray(pc.match_substring_regex(body, pattern=LATIN))
        letters = pc.utf8_lower(body.filter(pa.array(plain))).dictionary_encode()
        tailed = plain & (np.asarray(pc.binary_length(body)) < np.asarray(pc.binary_length(words)))
        at = pa.array(tailed)
        tails = pa.array([w[len(b) :] for w, b in zip(words.filter(at).to_pylist(), body.filter(at).to_pylist(), strict=True)], pa.large_string()).dictionary_encode()
        others = words.filter(pa.array(~plain)).to_pylist()
        parts = [self._letters(letters.dictionary.to_pylist()), self._any(tails.dictionary.to_pylist()), self._any(others)]
        flat, size = _joined([x for x, _ in parts], [x for _, x in parts])
        size = np.append(size, 0)  # the empty piece
        first, second = np.empty(len(words), np.int64), np.full(len(words), len(size) - 1)
        first[plain] = np.asarray(letters.indices)
        first[~plain] = len(letters.dictionary) + len(tails.dictionary) + np.arange(len(others))
        second[tailed] = len(letters.dictionary) + np.asarray(tails.indices)
        flat, n = gathered(flat, size, np.stack((first, second), 1).ravel())
        return flat, n.reshape(-1, 2).sum(1)

    def encoded(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Bounds (rows + 1) and ids of a slice of texts, each with the end id."""
        words = Words(column)
        flat, size = self.words(words.distinct)
        ids, n = gathered(flat, size, words.codes)
        upto = np.concatenate(([0], np.cumsum(n)))
        rows = len(words.bounds) - 1
        ends = upto[words.bounds[1:]] + np.arange(rows)  # where each row's end id goes
        out = np.empty(len(ids) + rows, np.uint32)
        where = np.ones(len(out), bool)
        where[ends] = False
        out[where] = ids
        out[ends] = end
        return np.concatenate(([0], ends + 1)), out


def _joined(flat: list[np.ndarray], sizes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    none = np.zeros(0, np.int64)
    return np.concatenate([none.astype(np.uint32), *flat]), np.concatenate([none, *sizes])


def write(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: int = END, files: int | None = None) -> None:
    """Writes the files: file (int) and row (long, in the file), doc (the id, as it is), n_tokens (long), ids
    (array<int>).

    Defined cases: null ids come first; a null or empty text has the end id alone; rows of one id keep an
    order by their text; an empty table gives files without rows.
    """
    files = files or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(files, F.col("doc").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc").asc_nulls_first(), F.xxhash64("text"), "text")
    rows = rows.withColumn("file", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, row = None, 0
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                encoder = encoder or Encoder(tokenizer)
                bounds, ids = encoder.encoded(part.column("text"), end)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))
                at = pa.array(np.arange(row, row + part.num_rows), pa.int64())
                row += part.num_rows
                yield pa.RecordBatch.from_arrays([part.column("file"), at, part.column("doc"), pa.array(np.diff(bounds), pa.int64()), lists], ["file", "row", "doc", "n_tokens", "ids"])

    kind = rows.schema["doc"].dataType.simpleString()
    (
        rows.mapInArrow(run, f"file int, row bigint, doc {kind}, n_tokens bigint, ids array<int>")
        .write.option("parquet.writer.version", "v2")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.enable.dictionary", "true")
        .option("compression", "zstd")
        .parquet(path)
    )


def digests(spark: SparkSession, path: str, id_as: str = "doc_id") -> DataFrame:
    """Each document's id, start, n_tokens and the CRC-32 of its ids as little-endian 32-bit integers, read
    back from the files. Counts of the files are summed (a row for each file); inside a file a window runs
    over the lengths only."""
    kind = spark.read.parquet(path).schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            bounds = np.asarray(lists.offsets).astype(np.int64)
            body = np.ascontiguousarray(np.asarray(lists.values)).astype("<u4").tobytes()
            crc = [zlib.crc32(body[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("row"), batch.column("doc"), batch.column("n_tokens"), pa.array(crc, pa.int64())], ["file", "row", "doc", "n_tokens", "ids_crc32"])

    read = spark.read.parquet(path).select("file", "row", "doc", "n_tokens", "ids")
    out = read.mapInArrow(run, f"file int, row bigint, doc {kind}, n_tokens bigint, ids_crc32 bigint")
    sizes = spark.read.parquet(path).groupBy("file").agg(F.sum("n_tokens").alias("n"))
    base = sizes.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    out = out.join(F.broadcast(base), "file").withColumn("start", F.col("base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return out.select(F.col("doc").alias(id_as), "start", "n_tokens", "ids_crc32")


def read(spark: SparkSession, path: str, docs: list) -> DataFrame:
    """The ids of some documents: the page index keeps the reader to their pages."""
    return spark.read.parquet(path).where(F.col("doc").isin(docs)).select("doc", "n_tokens", "ids")


def encoded_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """write() to the shared folder, then digests()."""
    path = place(docs.sparkSession, "tokens")
    write(docs, path, tokenizer, id_col, text_col)
    return digests(docs.sparkSession, path)
