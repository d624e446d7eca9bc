"""Word columns for Arrow batches: split whole texts, number the distinct words, hash runs of words.

All functions work on one bounded slice of a batch; a slice is cut by bytes of text, never by
dropping rows, and a text longer than the bound is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 4 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# lower-cased ASCII letters, digits and every byte of a non-ASCII character are word bytes
_ALNUM = np.where(
    ((_LOWER >= 48) & (_LOWER <= 57)) | ((_LOWER >= 97) & (_LOWER <= 122)) | (_LOWER >= 128), _LOWER, 32
).astype(np.uint8)


def plain(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The texts as one large_string array without nulls (a null is an empty text)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows whose texts have at most `most` bytes, or one row."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    end = np.cumsum(size)
    at = 0
    while at < len(size):
        base = end[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(end, base + most, "right")))
        yield batch.slice(at, to - at)
        at = to
    pa.default_memory_pool().release_unused()  # an idle worker keeps no more than it needs


def mapped(texts: pa.Array, table: np.ndarray) -> pa.Array:
    """The texts with every byte replaced through a 256-entry table."""
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = table[np.frombuffer(data, np.uint8)[off[0] : off[-1]]] if data is not None else np.zeros(0, np.uint8)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((off - off[0]).tobytes()), pa.py_buffer(body.tobytes()))


class Words:
    """The words of a slice: `bounds` (rows + 1) into `codes`, which number the array `distinct`."""

    def __init__(self, column: pa.Array, lower: bool = False, alnum: bool = False):
        texts = plain(column)
        if (lower or alnum) and len(texts):
            texts = mapped(texts, _ALNUM if alnum else _LOWER)
        lists = pc.ascii_split_whitespace(texts)  # space and \t \n \v \f \r
        bounds = np.asarray(lists.offsets).astype(np.int64)
        values = lists.values.slice(int(bounds[0]), int(bounds[-1] - bounds[0])) if len(lists) else lists.values.slice(0, 0)
        bounds = bounds - bounds[0]
        some = np.asarray(pc.binary_length(values)) > 0
        if not some.all():
            before = np.concatenate(([0], np.cumsum(some)))
            bounds = before[bounds]
            values = values.filter(pa.array(some))
        coded = values.dictionary_encode()
        self.bounds = bounds.astype(np.int64)
        self.codes = np.asarray(coded.indices).astype(np.int32)
        self.distinct = coded.dictionary

    def __len__(self) -> int:
        return len(self.codes)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        one = xxhash.xxh3_64_intdigest
        table = np.fromiter((one(w) for w in self.distinct.cast(pa.large_binary()).to_pylist()), np.uint64, len(self.distinct))
        return table[self.codes] if len(table) else np.zeros(0, np.uint64)


_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * _B
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """An order-sensitive 64-bit hash of each run of k values, by doubling; len(h) - k + 1 of them."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    done, out, power, width = 0, None, h, 1
    rest = k
    while rest:
        if rest & 1:
            if out is None:
                out = power
            else:
                n = len(h) - (done + width) + 1
                out = mixed(out[:n] * _A + power[done : done + n] + np.uint64(width))
            done += width
        rest >>= 1
        if rest:
            power = mixed(power[: len(power) - width] * _A + power[width:] + np.uint64(width))
            width *= 2
    return out


def run_starts(bounds: np.ndarray, k: int) -> np.ndarray:
    """Positions at which a run of k words lies inside one row."""
    n = int(bounds[-1])
    ok = np.ones(max(n - k + 1, 0), bool)
    for back in range(1, k):
        cut = bounds[1:-1] - back
        ok[cut[(cut >= 0) & (cut < len(ok))]] = False
    return np.flatnonzero(ok)
