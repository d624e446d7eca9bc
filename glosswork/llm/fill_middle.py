"""Fill-in-the-middle: texts cut in three at unit boundaries and put together in another order.

A slice of texts is one run of bytes. The last byte of each unit is a set bit of a packed bitvector, whose directory holds
the number of set bits before each block of 512: rank at a text's two ends gives its number of units, and select on
the two drawn ranks gives the byte cuts. A second bitvector of the characters' first bytes turns cuts into code points.
No unit is ever made an object, and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.llm.words import plain, slices

SEED = 7
SENTINELS = ("<P>", "<S>", "<M>")
OUT = "fim_units long, fim_form string, fim_prefix_chars long, fim_middle_chars long, fim_text string"
_WORDS = 8  # 64-bit words of a block
_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True


class Bits:
    """A packed bitvector with rank and select for arrays of arguments."""

    def __init__(self, marks: np.ndarray):
        packed = np.packbits(marks, bitorder="little")
        size = 8 * _WORDS
        full = np.zeros((len(packed) // size + 1) * size, np.uint8)
        full[: len(packed)] = packed
        self.blocks = full.view("<u8").reshape(-1, _WORDS)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.blocks).sum(1, dtype=np.int64))))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """The number of set bits before each place."""
        block, word = at >> 9, (at >> 6) & (_WORDS - 1)
        rows = self.blocks[block]
        counts = np.bitwise_count(rows).astype(np.int64)
        whole = np.where(np.arange(_WORDS) < word[:, None], counts, 0).sum(1)
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + whole + np.bitwise_count(rows[np.arange(len(at)), word] & low)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of the set bit that has k others before it."""
        block = np.searchsorted(self.before, k, "right") - 1
        rows = self.blocks[block]
        upto = np.cumsum(np.bitwise_count(rows), 1, dtype=np.int64)
        left = k - self.before[block]
        word = (upto <= left[:, None]).sum(1)
        at = np.arange(len(k))
        left -= np.where(word > 0, upto[at, word - 1], 0)
        bits = np.unpackbits(np.ascontiguousarray(rows[at, word]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        inside = np.argmax(np.cumsum(bits, 1, dtype=np.int64) > left[:, None], 1)
        return (block << 9) + (word << 6) + inside


def ends(data: np.ndarray, starts: np.ndarray, unit: str) -> np.ndarray:
    """A mark at the last byte of each unit. starts: where texts begin, and the end of the last."""
    marks = np.zeros(len(data), bool)
    if not len(data):
        return marks
    last = starts[1:][np.diff(starts) > 0] - 1
    if unit == "line":  # up to and with a line feed
        marks |= data == 10
    elif unit == "word":  # a run without white space and the white space after it
        white = _WHITE[data]
        marks[:-1] = white[:-1] & ~white[1:]
    elif unit == "char":
        marks[:-1] = (data[1:] & 0xC0) != 0x80
    else:
        raise ValueError(f"no unit {unit}")
    marks[last] = True
    return marks


def _cut(texts: pa.Array, h: list[np.ndarray], unit: str, rate: int, spm: int, sentinels: tuple[str, str, str]) -> dict[str, pa.Array]:
    texts = plain(texts)
    _, offsets, body = texts.buffers()
    starts = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = memoryview(body)[starts[0] : starts[-1]] if body is not None else memoryview(b"")
    starts = starts - starts[0]
    data = np.frombuffer(raw, np.uint8)
    bound, chars = Bits(ends(data, starts, unit)), Bits((data & 0xC0) != 0x80)
    at = bound.rank(starts)
    n = np.diff(at)
    first, second = h[0] % (n + 1), h[1] % (n + 1)
    drawn = np.concatenate((np.minimum(first, second), np.maximum(first, second)))
    cut = np.tile(starts[:-1], 2)
    some = drawn > 0
    cut[some] = bound.select((np.tile(at[:-1], 2) + drawn - 1)[some]) + 1
    low, high = cut[: len(n)], cut[len(n) :]
    marked = np.zeros(len(n), bool)
    for s in sentinels:
        marked |= np.asarray(pc.match_substring(texts, s), bool)
    as_is = (n == 0) | marked | (h[2] % 100 >= rate)
    mode = np.where(as_is, "plain", np.where(h[3] % 100 < spm, "spm", "psm"))
    places = chars.rank(np.concatenate((starts[:-1], low, high))).reshape(3, -1)
    p, s, m = (x.encode() for x in sentinels)
    out = []
    for kind, a, b, c, d in zip(mode.tolist(), starts[:-1].tolist(), low.tolist(), high.tolist(), starts[1:].tolist(), strict=True):
        if kind == "plain":
            out.append(bytes(raw[a:d]))
        elif kind == "psm":
            out.append(b"".join((p, raw[a:b], s, raw[c:d], m, raw[b:c])))
        else:
            out.append(b"".join((s, raw[c:d], p, raw[a:b], m, raw[b:c])))
    sizes = [pa.array(x, pa.int64(), mask=as_is) for x in np.diff(places, axis=0)]
    return {"fim_units": pa.array(n, pa.int64()), "fim_form": pa.array(mode.tolist(), pa.string()), "fim_prefix_chars": sizes[0], "fim_middle_chars": sizes[1], "fim_text": pa.array(out, pa.binary()).cast(pa.string())}


def transformed(docs: DataFrame, unit: str = "line", rate: int = 100, spm: int = 50, seed: int = SEED, sentinels: tuple[str, str, str] = SENTINELS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with the columns of OUT: number of units, form (plain, psm or spm), code points of prefix and middle (null
    if plain) and the text in its new order. `rate` and `spm` are per cent; draws are the SHA-256 of the seed and the id.

    Defined cases: a null or empty text is plain with an empty text; a text that holds a sentinel stays as it is; a null id is
    drawn as an empty one; rows of one id have the same draws, each row is cut by itself; an empty table gives no rows; columns of
    docs that have a name of OUT, and the drawn numbers' h1 to h4, are replaced or left out. A text is one slice at least, however long.
    """
    names = [x.split()[0] for x in OUT.split(", ")]
    draws = [f"__h{i}" for i in range(1, 5)]
    hexed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    keep = [c for c in docs.columns if c not in names]
    rows = docs.select(*keep).withColumns({c: F.conv(F.substring(hexed, 8 * i + 1, 8), 16, 10).cast("long") for i, c in enumerate(draws)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                made = _cut(part.column(text_col), [np.asarray(part.column(c)) for c in draws], unit, rate, spm, sentinels)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], *made.values()], [*keep, *made])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]
    return rows.mapInArrow(run, ", ".join([*kinds, OUT]))


def restored(text: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The original text of a transformed one: sentinels can't occur in its parts."""
    parts = F.split(text, "|".join(re.escape(s) for s in sentinels))
    second, third, middle = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return F.when(form == "psm", F.concat(second, middle, third)).when(form == "spm", F.concat(third, middle, second)).otherwise(text)
