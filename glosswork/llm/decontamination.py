"""Benchmark decontamination with suffix arrays over the training texts.

A shard is a slice of a task's rows. Its words are numbered by the benchmark's vocabulary (0 for
every other word, so that no suffix runs through a word that no item has), and the suffixes that
start with a benchmark word are sorted: first by a 64-bit number of several words at once, then, only
inside runs of equal suffixes, by the words that follow. Every suffix of every item is searched in it
by a vectorised binary search for its first `window` words. Suffixes with the same first words share an
interval of the array, which is read once, in pieces of `PIECE` suffixes, for the words hit and the items.
Where the longest matches are asked for, each hit that can't be extended to the left is extended to
the right as far as the words agree; those that can be are left out before they are paired with the items.
Documents never leave their task: nothing is shuffled. The benchmark's numbers are read and broadcast
in blocks of `block_words` words; a benchmark of more than four blocks takes a pass over the
texts for each four, what was hit so far being carried in the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswork.llm.shared import forget, written
from glosswork.llm.words import Words, slices

WINDOW = 10
BLOCK_WORDS = 1_000_000
BLOCKS_A_PASS = 4
PIECE = 1 << 20
SPAN = pa.struct([("item_id", pa.string()), ("item_start", pa.int64()), ("doc_start", pa.int64()), ("n_words", pa.int64())])
SPAN_DDL = "struct<item_id: string, item_start: bigint, doc_start: bigint, n_words: bigint>"
ADDED = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans")


class Items:
    """The numbered words of a block of items, and what of them is searched for."""

    def __init__(self, ids: list[str], texts: list[str], window: int):
        words = Words(pa.array(texts, pa.large_string()), alnum=True)
        order = np.asarray(pc.sort_indices(words.distinct)) if len(words.distinct) else np.zeros(0, np.int64)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(1, len(order) + 1)
        self.vocabulary = words.distinct.take(pa.array(order)).to_pylist()
        self.bits = max(1, int(len(order)).bit_length())
        self.per_key = 63 // self.bits
        counts = words.counts
        # items stand one after another, each followed by a 0
        self.start = np.concatenate(([0], np.cumsum(counts + 1)))[:-1]
        self.words = np.zeros(int((counts + 1).sum()) + 1, np.int64)
        self.item = np.repeat(np.arange(len(counts)), counts + 1)
        at = np.arange(len(words)) + words.rows
        if len(at):
            self.words[at] = rank[words.codes]
        self.ids = ids
        width = np.minimum(counts, window)
        left = np.repeat(counts, counts) - (np.arange(len(words)) - np.repeat(words.bounds[:-1], counts))
        need = np.repeat(width, counts)
        self.query = at[left >= need].astype(np.int64)  # where a window starts
        self.need = need[left >= need].astype(np.int64)


def packed(tokens: np.ndarray, at: np.ndarray, bits: int, per_key: int, width: np.ndarray | None = None) -> np.ndarray:
    """The words from each place on as one number, a suffix ending at its first 0; with width, of that
    many words only."""
    out = np.zeros(len(at), np.int64)
    live = np.ones(len(at), bool)
    n = len(tokens)
    for j in range(per_key):
        t = np.where(at + j < n, tokens[np.minimum(at + j, n - 1)], 0)
        if width is not None:
            t = np.where(j < width, t, 0)
        live &= t > 0
        out = (out << bits) | np.where(live, t, 0)
    return out


def suffix_array(tokens: np.ndarray, bits: int, per_key: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted starts of the suffixes that begin with a number over 0, compared over `most` words at
    least, and their first keys."""
    at = np.flatnonzero(tokens)
    if not len(at):
        return at, np.zeros(0, np.int64)
    first = packed(tokens, at, bits, per_key)
    order = np.argsort(first)
    sa, first = at[order], first[order]
    key, done = first, per_key
    group = np.concatenate(([True], key[1:] != key[:-1]))  # a new run of equal suffixes starts here
    while done < most:
        run = np.cumsum(group) - 1
        size = np.bincount(run)
        tied = np.flatnonzero(size[run] > 1)
        if not len(tied):
            break
        key = packed(tokens, sa[tied] + done, bits, per_key)
        if not key.any():
            break
        order = np.lexsort((key, run[tied]))
        sa[tied] = sa[tied][order]
        key, owner = key[order], run[tied]
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])))
        group[tied] |= new
        done += per_key
    return sa, first


def intervals(tokens: np.ndarray, sa: np.ndarray, first: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """For each query the run [lo, hi) of suffixes that begin with its words."""
    bits, per_key = items.bits, items.per_key

    def bisect(a: np.ndarray, b: np.ndarray, level: int, target: np.ndarray, right: bool) -> np.ndarray:
        a, b = a.copy(), b.copy()
        while (live := np.flatnonzero(a < b)).size:
            mid = (a[live] + b[live]) >> 1
            key = packed(tokens, sa[mid] + level, bits, per_key)
            below = key <= target[live] if right else key < target[live]
            a[live[below]] = mid[below] + 1
            b[live[~below]] = mid[~below]
        return a

    q, need = items.query, items.need
    lo, hi = np.zeros(len(q), np.int64), np.full(len(q), len(sa), np.int64)
    for level in range(0, int(need.max(initial=0)), per_key):
        width = np.clip(need - level, 0, per_key)
        live = np.flatnonzero((width > 0) & (lo < hi))
        low = packed(items.words, q[live] + level, bits, per_key, width[live])
        high = low | ((np.int64(1) << ((per_key - width[live]) * bits)) - 1)
        if level == 0:
            lo[live], hi[live] = np.searchsorted(first, low, "left"), np.searchsorted(first, high, "right")
        else:
            a, b = lo[live], hi[live]
            lo[live], hi[live] = bisect(a, b, level, low, False), bisect(a, b, level, high, True)
    return lo, hi


def _expanded(lo: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places lo, lo + 1, ... (n of them) of every interval, in pieces: each place's interval, and the place."""
    end = np.cumsum(n)
    for at in range(0, int(end[-1]) if len(end) else 0, PIECE):
        flat = np.arange(at, min(at + PIECE, int(end[-1])))
        which = np.searchsorted(end, flat, "right")
        yield which, lo[which] + flat - (end[which] - n[which])


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One index for each distinct row of the keys, and each row's number among these."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


class Found:
    """What of a block of items is in the words of one slice."""

    def __init__(self, words: Words, items: Items, vocabulary: pa.Array, window: int):
        self.items = items
        rows = len(words.bounds) - 1
        known = np.asarray(pc.fill_null(pc.index_in(words.distinct, value_set=vocabulary), -1)).astype(np.int64) + 1
        self.tokens = np.zeros(len(words) + rows + 1, np.int64)  # a 0 after each row
        if len(words):
            self.tokens[np.arange(len(words)) + words.rows] = known[words.codes]
        self.start = words.bounds[:-1] + np.arange(rows)
        longest = int(np.diff(np.concatenate((items.start, [len(items.words) - 1]))).max()) if len(items.start) else 0
        self.sa, first = suffix_array(self.tokens, items.bits, items.per_key, min(window, longest))
        none = np.zeros(0, np.int64)
        self.query = self.lo = self.n = self.need = none
        if len(self.sa) and len(items.query):
            lo, hi = intervals(self.tokens, self.sa, first, items)
            some = np.flatnonzero(hi > lo)
            self.query, self.lo, self.n, self.need = items.query[some], lo[some], (hi - lo)[some], items.need[some]

    def row(self, p: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, p, "right") - 1

    def hit(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows and items (distinct pairs) that share a window, and the starts and ends of the runs of words hit."""
        one, number = _groups(self.lo, self.n, self.need)
        edge = np.zeros(len(self.tokens) + 1, np.int64)
        pairs = [np.zeros(0, np.int64)]
        for which, place in _expanded(self.lo[one], self.n[one]):
            p = self.sa[place]
            np.add.at(edge, p, 1)
            np.add.at(edge, p + self.need[one][which], -1)
            pairs.append(np.unique(which * len(self.start) + self.row(p)))
        pairs = np.unique(np.concatenate(pairs))
        group, row = pairs // max(len(self.start), 1), pairs % max(len(self.start), 1)
        # each group's rows, for each item that has the window
        item, of = self.items.item[self.query], number
        both = np.unique(of * (len(self.items.ids) + 1) + item)
        of, item = both // (len(self.items.ids) + 1), both % (len(self.items.ids) + 1)
        first, many = np.searchsorted(group, of, "left"), np.searchsorted(group, of, "right")
        out = [np.zeros(0, np.int64)]
        for which, place in _expanded(first, many - first):
            out.append(np.unique(row[place] * (len(self.items.ids) + 1) + item[which]))
        out = np.unique(np.concatenate(out))
        covered = np.cumsum(edge) > 0
        step = np.diff(covered.astype(np.int8), prepend=0)
        return out // (len(self.items.ids) + 1), out % (len(self.items.ids) + 1), np.flatnonzero(step > 0), np.flatnonzero(step < 0)

    def longest(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Matches that can't be extended to either side: places in the shard, places in the items, words."""
        tokens, items = self.tokens, self.items
        before_q = np.where(self.query > 0, items.words[np.maximum(self.query - 1, 0)], 0)
        one, number = _groups(self.lo, self.n, self.need, before_q)
        by = np.argsort(number, kind="stable")
        cut = np.searchsorted(number[by], np.arange(len(one) + 1))
        for which, place in _expanded(self.lo[one], self.n[one]):
            p = self.sa[place]
            before_p = np.where(p > 0, tokens[np.maximum(p - 1, 0)], 0)
            left = (before_p == 0) | (before_p != before_q[one][which])
            p, which = p[left], which[left]
            for w, k in _expanded(cut[which], (cut[1:] - cut[:-1])[which]):
                at, q, length = p[w], self.query[by[k]], self.need[by[k]].copy()
                live = np.arange(len(at))
                while len(live):
                    a = tokens[np.minimum(at[live] + length[live], len(tokens) - 1)]
                    b = items.words[q[live] + length[live]]
                    live = live[(a == b) & (a > 0)]
                    length[live] += 1
                yield at, q, length


EMPTY = hashlib.sha256(b"").hexdigest()


class State:
    """What all blocks so far found in the rows of a slice: items, runs of words hit, longest matches."""

    def __init__(self, part: pa.RecordBatch, words: Words, carried: bool):
        self.rows, self.n_words = part.num_rows, words.counts
        self.ids: dict[int, set] = {}
        self.runs = np.zeros((3, 0), np.int64)  # row, start, end
        self.spans: dict[int, list] = {}
        if carried:
            self.ids = {r: set(x) for r, x in enumerate(part.column("__ids").to_pylist()) if x}
            self.spans = {r: x for r, x in enumerate(part.column("spans").to_pylist()) if x}
            runs = [np.frombuffer(x.as_buffer(), "<i8").reshape(2, -1) for x in part.column("__runs")]
            self.runs = np.concatenate([np.stack((np.full(x.shape[1], r), *x)) for r, x in enumerate(runs)], axis=1) if runs else self.runs

    def add(self, found: Found, with_spans: bool) -> None:
        row, item, start, end = found.hit()
        ids = found.items.ids
        for r, i in zip(row.tolist(), item.tolist(), strict=True):
            self.ids.setdefault(r, set()).add(ids[i])
        of = found.row(start)
        self.runs = _joined(np.concatenate((self.runs, np.stack((of, start - found.start[of], end - found.start[of]))), axis=1))
        if with_spans:
            for p, q, n in found.longest():
                of, item = found.row(p), found.items.item[q]
                for r, a, i, b, k in zip(of.tolist(), (p - found.start[of]).tolist(), item.tolist(), (q - found.items.start[item]).tolist(), n.tolist(), strict=True):
                    self.spans.setdefault(r, []).append({"item_id": ids[i], "item_start": b, "doc_start": a, "n_words": k})

    def columns(self, last: bool) -> list[pa.Array]:
        hit = np.bincount(self.runs[0], weights=self.runs[2] - self.runs[1], minlength=self.rows).astype(np.int64)
        spans = pa.array([sorted(self.spans.get(r, []), key=lambda s: (s["doc_start"], s["item_id"], s["item_start"])) for r in range(self.rows)], pa.list_(SPAN))
        if not last:
            cut = np.searchsorted(self.runs[0], np.arange(self.rows + 1))
            runs = pa.array([self.runs[1:, a:b].astype("<i8").tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())
            return [pa.array([sorted(self.ids.get(r, ())) for r in range(self.rows)], pa.list_(pa.string())), runs, spans]
        digest = [hashlib.sha256(",".join(sorted(self.ids[r])).encode()).hexdigest() if r in self.ids else EMPTY for r in range(self.rows)]
        return [pa.array(self.n_words, pa.int64()), pa.array(hit), pa.array([len(self.ids.get(r, ())) for r in range(self.rows)], pa.int64()), pa.array(digest), pa.array(hit > 0), spans]


def _joined(runs: np.ndarray) -> np.ndarray:
    """Runs (row, start, end), sorted, those that touch or overlap made one."""
    runs = runs[:, np.lexsort((runs[1], runs[0]))]
    if not runs.shape[1]:
        return runs
    shift = runs[0] * (1 << 40)  # rows apart, so that one running maximum serves all
    upto = np.maximum.accumulate(runs[2] + shift)
    new = np.concatenate(([True], runs[1, 1:] + shift[1:] > upto[:-1]))
    first = np.flatnonzero(new)
    end = upto[np.append(first[1:], len(new)) - 1] - shift[first]
    return np.stack((runs[0, first], runs[1, first], end))


def blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_words: int) -> Iterator[Items]:
    """The items in blocks of about `block_words` words. Items without an id or words are left out;
    rows of one id are one item with several texts."""
    ids, texts, size = [], [], 0
    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("i IS NOT NULL AND t IS NOT NULL").distinct().orderBy("i", "t")
    for r in rows.toLocalIterator():
        ids.append(r["i"])
        texts.append(r["t"])
        size += len(r["t"]) // 2 + 1
        if size >= block_words:
            yield Items(ids, texts, window)
            ids, texts, size = [], [], 0
    if ids:
        yield Items(ids, texts, window)


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    keep: list[str] | None = None,
    spans: bool = True,
) -> DataFrame:
    """Every row of docs (its columns, or those in keep) with n_words, n_hit, n_items, items_sha256,
    contaminated and spans (item_id, item_start, doc_start, n_words of each longest match; empty if spans are not
    asked for).

    Defined cases: null texts have no words; an item of fewer than `window` words is one window, an
    empty one none; repeated rows are scanned each; without items nothing is hit; columns of docs named
    like an added one are replaced.
    """
    spark = docs.sparkSession
    out_cols = [c for c in (keep if keep is not None else docs.columns) if c not in ADDED]
    texts = docs.select(*[F.col(c) for c in out_cols], F.col(text_col).alias("__text"))
    own = [f"`{f.name}` {f.dataType.simpleString()}" for f in texts.select(*out_cols).schema]
    made = {True: ["n_words bigint", "n_hit bigint", "n_items bigint", "items_sha256 string", "contaminated boolean", f"spans array<{SPAN_DDL}>"], False: ["__ids array<string>", "__runs binary", f"spans array<{SPAN_DDL}>"]}

    def passed(df: DataFrame, group: list[Items], last: bool, carried: bool) -> DataFrame:
        sent = [spark.sparkContext.broadcast(b) for b in group]
        names = [x.split(" ")[0] for x in made[last]]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = [pa.array(b.value.vocabulary, pa.large_string()) for b in sent]
            for batch in batches:
                for part in slices(batch, "__text"):
                    split = Words(part.column("__text"), alnum=True)
                    state = State(part, split, carried)
                    for b, vocabulary in zip(sent, words, strict=True):
                        state.add(Found(split, b.value, vocabulary, window), spans)
                    through = out_cols if last else [*out_cols, "__text"]
                    yield pa.RecordBatch.from_arrays([*[part.column(c) for c in through], *state.columns(last)], [*through, *names])

        return df.mapInArrow(run, ", ".join([*own, *([] if last else ["__text string"]), *made[last]]))

    every = blocks(benchmark, item_col, item_text_col, window, block_words)  # read as the passes go
    group, df, before = list(islice(every, BLOCKS_A_PASS)), texts, None
    while True:
        more = list(islice(every, BLOCKS_A_PASS))
        out = passed(df, group, not more, before is not None)
        if not more:
            return out
        df = written(out, "decontamination")
        forget(before)
        group, before = more, df


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents that no item touches, with the columns of docs."""
    named = {c: f"__in_{c}" for c in docs.columns if c in ADDED}
    renamed = docs.withColumnsRenamed(named)
    out = scan(renamed, benchmark, named.get(text_col, text_col), item_col, item_text_col, window, spans=False).where("NOT contaminated")
    back = {v: k for k, v in named.items()}
    return out.select(*[F.col(c).alias(back.get(c, c)) for c in renamed.columns])
