"""Exact n-gram Jaccard self-join by universe partitioning, and the components of its links.

Two sets with a Jaccard similarity of at least t = p / q differ in at most H = (q - p)(a + b) / (q + p)
elements. The hashed universe is cut into m equal segments (m by size band), and a set's elements in one
segment form a subset with a signature. If the sets' differences are spread over segments that were given
credits of H + 1 in all, one of these segments differs by less than its credits: a segment with one credit
then has equal subsets, one with two credits has subsets that differ by one element at most, which the
signatures of the subset and of its one-deletion neighbours show.

Every set is indexed in its own band and, if a larger partner can be there, in the next; the larger set
probes. All signatures of a bucket meet in one task, so the length of every list is known before a
probe is chosen (fewer than one in a hundred share by chance, as 32 bits are kept beside the bucket: they cost comparisons, no links). A set's segments whose list holds no other set are credits that cost nothing; only the
credits it lacks beyond these are bought, from its shortest lists (equal lists count as one), and a set
whose free credits reach H + 1 probes nothing. So a passage that many sets share costs nothing as long
as it is not most of a set. Sets with fewer non-empty segments than H + 1 take second credits on segments with
a deletion index; those that can't raise their credits even so (fewer than one in a million) are compared
with all sets, in blocks.

Members of a chosen list become a pair only if their sets can be so similar: their odd sketches (the parities
of their counts in 512 equal parts of the universe) differ in no more bits than the sets in elements, of
which there must be at most H. Signatures travel packed by bucket. What shares a signature is verified on
the whole texts. Lists are not expanded into pairs: one of a list's probing members is compared with the others,
and lists within one component are dropped. The sets in lists that stay open mostly share a passage without being
similar. They are listed anew, by their single elements: of similar sets the smaller, of size b, lacks at most
(q - p) b / (q + p) of its elements in the larger, so it probes its rarest elements, one more than that. A passage that
leaves a set so many elements of its own is then in none of its probes. Near copies that are not similar enough are in
many of these lists together, so lists that hang together become one where that saves comparisons. Then rounds follow: in each a few
of a list's probing members are compared with the others that are not yet in their component. A pair that shares
a chosen list and is in no common component at the end has been compared, so no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glosswork.llm.components import components
from glosswork.llm.shared import forget, small, written
from glosswork.llm.words import Words, mixed, run_hashes, run_starts, slices

N = 5
PERCENT = 75
BANDS = [8 << i for i in range(40)]
DELETIONS = 8  # segments with a deletion index in the larger bands
BUCKET_ROWS = 12_000_000
PARTS = 8  # of a bucket, worked on one after the other
HELD_ROWS = 1_000_000
LEAST_BUCKETS = 16  # if there are so many shuffle partitions
BLOCK_SETS = 2000
INDEXED, MAY_PROBE, PROBES = 1, 2, 4
SKETCH = tuple(f"s{i}" for i in range(8))
U = np.uint64
LOW = U((1 << 32) - 1)


def segments_of(upper: int) -> tuple[int, int]:
    """Segments, and segments with a deletion index, of the band of sizes up to `upper`."""
    m = max(8, round(0.5 * upper))
    return m, (m if upper <= 64 else DELETIONS)


class Sets:
    """The distinct n-grams of each row of a slice: sorted hashes `h`, their rows, `size`, and two 64-bit
    hashes of the whole set."""

    def __init__(self, column: pa.Array, n: int):
        words = Words(column, lower=True)
        w = words.hashes()
        at = run_starts(words.bounds, n)
        h, row = run_hashes(w, n)[at], words.rows[at]
        for k in range(1, n):  # shorter texts: the whole sequence
            short = np.flatnonzero(words.counts == k)
            if len(short):
                one = mixed(run_hashes(w, k)[words.bounds[short]] + U(k * 0x9E3779B1))
                h, row = np.concatenate((h, one)), np.concatenate((row, short))
        order = np.argsort(h)
        h, row = h[order], row[order]
        order = np.argsort(row.astype(np.int16 if len(words.bounds) < 32000 else np.int32), kind="stable")
        h, row = h[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        self.h, self.row = h[new], row[new]
        rows = len(words.bounds) - 1
        self.bounds = np.searchsorted(self.row, np.arange(rows + 1))
        self.size = np.diff(self.bounds)
        self.n_words = words.counts
        mix = mixed(self.h ^ U(0xA0761D6478BD642F))
        self.key, self.key2 = (sums(x, self.bounds) for x in (mix, mixed(mix + U(0x8EBC6AF09C88C6E3))))
        self.key = mixed(self.key + self.size.astype(U))

    def sketch(self) -> list[np.ndarray]:
        """The odd sketch: whether the counts in 512 equal parts of the universe are odd, in eight numbers."""
        rows = len(self.size)
        at = self.row.astype(np.int64) * 512 + (self.h >> U(55)).astype(np.int64)
        odd = (np.bincount(at, minlength=512 * rows) & 1).astype(np.uint8).reshape(rows, 64, 8)
        return list(np.packbits(odd, axis=2, bitorder="little").reshape(rows, 64).view(np.int64).T)


def sums(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Wrapping sums of the runs between bounds."""
    upto = np.concatenate((np.zeros(1, U), np.cumsum(x, dtype=U)))
    return upto[bounds[1:]] - upto[bounds[:-1]]


class Segments:
    """The non-empty segments of the rows of which `upper` (their band's upper size) is over 0: bounds into the
    elements `h`, the row `of` each, and whether it has a deletion index (`d`)."""

    def __init__(self, sets: Sets, upper: np.ndarray):
        use = np.repeat(upper > 0, sets.size)
        self.h, row = sets.h[use], sets.row[use]
        m_of, d_of = np.zeros(len(upper), np.int64), np.zeros(len(upper), np.int64)
        for u in np.unique(upper[upper > 0]).tolist():
            m_of[upper == u], d_of[upper == u] = segments_of(u)
        seg = (((self.h >> U(32)) * m_of[row].astype(U)) >> U(32)).astype(np.int64)
        new = np.ones(len(self.h), bool)
        new[1:] = (row[1:] != row[:-1]) | (seg[1:] != seg[:-1])
        first = np.flatnonzero(new)
        self.bounds = np.append(first, len(self.h))
        self.size = np.diff(self.bounds)
        self.of, self.seg = row[first], seg[first]
        self.d = (self.seg < d_of[self.of]) & (self.size >= 2)


def credits(sets: Sets, parts: Segments, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row the credits it needs, its non-empty segments, and the second credits it must take."""
    n = len(sets.size)
    need = (2 * sets.size * (100 - percent)) // (100 + percent) + 1
    every = np.bincount(parts.of, minlength=n)
    second = np.minimum(np.clip(need - every, 0, None), np.bincount(parts.of[parts.d], minlength=n))
    return need, every, second


def signatures(sets: Sets, upper: np.ndarray, own: bool, percent: int):
    """For the rows of which `upper` > 0: signatures, their rows, their flags; and the rows that lack credits."""
    none = np.zeros(0, np.int64)
    parts = Segments(sets, upper)
    if not len(parts.h):
        return np.zeros(0, U), none, none, none
    of, size = parts.of, parts.size
    element = mixed(parts.h ^ U(0xE7037ED1A0B428DB))
    total = sums(element, parts.bounds)
    place = mixed(parts.seg.astype(U) * U(0x9E3779B97F4A7C15) + upper[of].astype(U))
    # deletion index: S holds subsets, D holds subsets without one element (from two elements on)
    S, D = U(0), U(0x1D8E4E27C47D124F)
    dels = np.flatnonzero(np.repeat(parts.d, size))
    g_of = np.repeat(np.arange(len(of)), size)[dels]
    fewer = total[g_of] - element[dels]
    all_of = lambda n, flag: np.full(n, flag, np.int64)
    out = [(mixed(total ^ place ^ S), of, all_of(len(of), INDEXED | MAY_PROBE if own else INDEXED)), (mixed(fewer ^ place[g_of] ^ D), of[g_of], all_of(len(g_of), INDEXED))]
    short = none
    if own:
        need, every, second = credits(sets, parts, percent)
        short = np.flatnonzero((every + second < need) & (upper > 0))
        ok = np.flatnonzero(parts.d)
        rank = np.arange(len(ok)) - np.searchsorted(of[ok], np.arange(len(need)))[of[ok]]
        two = np.zeros(len(of), bool)
        two[ok] = rank < second[of[ok]]
        t, mine = np.flatnonzero(two), two[g_of]
        out.append((mixed(total[t] ^ place[t] ^ D), of[t], all_of(len(t), PROBES)))  # in their deletions
        out.append((mixed(fewer[mine] ^ place[g_of[mine]] ^ S), of[g_of[mine]], all_of(int(mine.sum()), PROBES)))  # my deletions in their subsets
    return (*(np.concatenate(x) for x in zip(*out, strict=True)), short)


def partitioned(sets: Sets, percent: int):
    """The signatures of the sets' own bands and of the next, as in `signatures`."""
    upper = bands(sets)
    most = sets.size * 100 // percent
    own = signatures(sets, upper, True, percent)
    nxt = signatures(sets, np.where((upper > 0) & (most > upper), 2 * upper, 0), False, percent)
    return (*(np.concatenate((x, y)) for x, y in zip(own[:3], nxt[:3], strict=True)), own[3])


def single(sets: Sets, percent: int):
    """Every element as a signature, as in `signatures`; no set lacks credits."""
    return mixed(sets.h ^ U(0xD6E8FEB86659FD93)), sets.row, np.full(len(sets.h), INDEXED | MAY_PROBE, np.int64), np.zeros(0, np.int64)


def bands(sets: Sets) -> np.ndarray:
    """The upper size of each row's band; 0 for an empty set."""
    uppers = np.array(BANDS)
    return np.where(sets.size > 0, uppers[np.searchsorted(uppers, sets.size)], 0)


def measured(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc, two hashes of its set, n_shingles, `spare` (its segments beyond the credits it needs) and the sketch
    of each row (doc, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                s = Sets(part.column("text"), n)
                need, every, _ = credits(s, Segments(s, bands(s)), percent)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc"), pa.array(s.key.view(np.int64)), pa.array(s.key2.view(np.int64)), pa.array(s.size, pa.int64()), pa.array(np.clip(every - need, 0, None), pa.int64()), *[pa.array(np.ascontiguousarray(x)) for x in s.sketch()]],
                    ["doc", "key", "key2", "n_shingles", "spare", *SKETCH],
                )

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc {kind}, key bigint, key2 bigint, n_shingles bigint, spare bigint, {', '.join(f"{c} bigint" for c in SKETCH)}")


LIST = "gid bigint, node bigint, flag tinyint, times int, members bigint"


def lists(docs: DataFrame, n: int, percent: int, buckets: int, signed=partitioned) -> DataFrame:
    """The members (node, flag) of the list of each signature (`signed`) that several sets share, one of which may probe: the
    list's name gid, how many signatures of the bucket have this list, and its length. gid null: a set
    without enough credits."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                s = Sets(part.column("text"), n)
                sig, row, flag, short = signed(s, percent)
                node = s.key
                bucket = (sig >> U(40)) * U(buckets) >> U(24)
                low = bucket << U(32) | sig & LOW  # the low 32 bits, beside the bucket; more sharing than there is costs a comparison
                order = np.argsort(low)
                low, row, flag, bucket = low[order], row[order], flag[order].astype(np.uint32), bucket[order].astype(np.int64)
                cut = np.concatenate(([0], np.cumsum(np.bincount(bucket, minlength=buckets))))
                to, blob = [], []
                for k in np.flatnonzero(np.diff(cut)):
                    c = slice(cut[k], cut[k + 1])
                    to.append(int(k))
                    blob.append(_packed(low[c] & LOW, row[c], flag[c], node))
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(blob, pa.binary()), pa.nulls(len(to), pa.int64())], ["to", "blob", "node"])
                if len(short):
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(short)) % buckets, pa.int32()), pa.nulls(len(short), pa.binary()), pa.array(node[short].view(np.int64))], ["to", "blob", "node"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            to = np.asarray(batch.column("to"))
            lacking = batch.column("node").filter(batch.column("node").is_valid())
            if len(lacking):
                nulls = [pa.nulls(len(lacking), t) for t in (pa.int64(), pa.int8(), pa.int32(), pa.int64())]
                yield pa.RecordBatch.from_arrays([nulls[0], lacking, *nulls[1:]], ["gid", "node", "flag", "times", "members"])
            for i in np.flatnonzero(np.asarray(batch.column("blob").is_valid())).tolist():
                if to[i] != at and held:
                    yield from _shared(held)
                    held = []
                at = int(to[i])
                held.append(batch.column("blob")[i].as_py())
        if held:
            yield from _shared(held)

    packed = docs.mapInArrow(pack, "to int, blob binary, node bigint")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return packed.repartition(parts, "to").sortWithinPartitions("to").mapInArrow(unpack, LIST)


def _packed(low: np.ndarray, row: np.ndarray, flag: np.ndarray, node: np.ndarray) -> bytes:
    """One bucket's signatures (ascending, 32 bits), their rows and flags. Each row's node stands once. Each part of the bucket
    has the steps from signature to signature and the places of rows and flags, byte by byte, so that what is small or regular
    in them compresses."""
    used, local = np.unique(row, return_inverse=True)
    place = local.astype(np.uint32) << 3 | flag  # an Arrow batch has fewer rows than 21 bits count
    cut = np.searchsorted(low, np.arange(PARTS + 1, dtype=U) * U(2**32 // PARTS))
    parts = []
    for i, j in zip(cut[:-1], cut[1:], strict=True):
        step = np.diff(low[i:j], prepend=U(0)).astype("<u4").view(np.uint8).reshape(-1, 4)
        planes = np.concatenate((step, place[i:j].astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]), axis=1).T
        parts.append(pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if j > i else b"")
    head = np.array([len(used), *np.diff(cut), *map(len, parts)], "<u4")
    return b"".join((head.tobytes(), node[used].tobytes(), *parts))


def _unpacked(b: bytes, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The signatures, nodes and flags of a part of what `_packed` gave."""
    head = np.frombuffer(b, "<u4", 1 + 2 * PARTS).astype(np.int64)
    used, k, sizes = int(head[0]), int(head[1 + part]), head[1 + PARTS :]
    names = np.frombuffer(b, U, used, 4 * len(head))
    at = 4 * len(head) + 8 * used + int(sizes[:part].sum())
    if not k:
        return np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.uint8)
    planes = np.frombuffer(pa.decompress(memoryview(b)[at : at + int(sizes[part])], 7 * k, codec="zstd"), np.uint8).reshape(7, k).T
    place = np.zeros((k, 4), np.uint8)
    place[:, :3] = planes[:, 4:]
    place = place.view("<u4").ravel()
    return np.cumsum(np.ascontiguousarray(planes[:, :4]).view("<u4").ravel(), dtype=U), names[place >> 3], (place & 7).astype(np.uint8)


def _shared(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
    """The lists of a bucket that two sets or more share, one of which may probe; lists with the same members and flags
    are one (in every HELD_ROWS rows or more of them)."""
    held, rows = [], 0
    for part in range(PARTS):
        held.append(_lists_of([_unpacked(b, part) for b in blobs]))
        rows += len(held[-1][3])
        if rows > HELD_ROWS or part == PARTS - 1:
            yield from _merged(held)
            held, rows = [], 0
    blobs.clear()


def _lists_of(blobs: list[tuple]) -> tuple[np.ndarray, ...]:
    """The lists of a bucket's part: names, how many signatures have each, lengths; and the nodes and flags of their members."""
    sig, node, flag = (np.concatenate(x) for x in zip(*blobs, strict=True))
    blobs.clear()
    order = np.argsort(sig)
    sig = sig[order]
    same = np.zeros(len(sig), bool)
    same[1:] = sig[1:] == sig[:-1]
    some = same.copy()
    some[:-1] |= same[1:]  # in a list of two rows or more
    sig, order = sig[some], order[some]
    node, flag = node[order], flag[order]
    order = np.lexsort((node, sig))
    sig, node, flag = sig[order], node[order], flag[order]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])  # copies of a set are one node
    first = np.flatnonzero(new)
    none = np.zeros(0, np.int64)
    if not len(first):
        return none.astype(U), none, none, none.astype(U), none.astype(np.uint8)
    flag = np.bitwise_or.reduceat(flag, first)
    sig, node = sig[first], node[first]
    group = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
    size = np.diff(np.append(group, len(sig)))
    probing = np.bitwise_or.reduceat(flag, group) & (MAY_PROBE | PROBES)
    member = mixed(node ^ mixed(flag.astype(U)))
    name = mixed(np.add.reduceat(member, group) + size.astype(U))
    keep = (size > 1) & (probing > 0)
    named, one, times = np.unique(name[keep], return_index=True, return_counts=True)
    chosen = np.flatnonzero(keep)[one]
    where = _runs(group[chosen], size[chosen])
    return named, times, size[chosen], node[where], flag[where]


def _runs(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places of runs, one after the other."""
    return np.repeat(start - np.cumsum(length) + length, length) + np.arange(length.sum())


def _merged(held: list[tuple]) -> Iterator[pa.RecordBatch]:
    """The rows of lists (`_lists_of`), each name's once."""
    name, times, length, node, flag = (np.concatenate(x) for x in zip(*held, strict=True))
    held.clear()
    gid, one, which = np.unique(name, return_index=True, return_inverse=True)
    times = np.bincount(which, times, minlength=len(gid))
    where = _runs((np.cumsum(length) - length)[one], length[one])
    list_of, length, gid = np.repeat(np.arange(len(gid)), length[one]), length[one], gid.view(np.int64)
    for i in range(0, len(where), 100_000):
        w, g = where[i : i + 100_000], list_of[i : i + 100_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(gid[g]), pa.array(node[w].view(np.int64)), pa.array(flag[w].astype(np.int8)), pa.array(times[g].astype(np.int32)), pa.array(length[g].astype(np.int64))], ["gid", "node", "flag", "times", "members"]
        )


def probes(made: DataFrame, sets: DataFrame) -> DataFrame:
    """gid, node: the lists that a set has to probe. sets: key, spare. Of its lists with other sets it may leave out as many
    as it has segments to spare; the longest are left out."""
    optional = made.where(F.col("flag").bitwiseAND(MAY_PROBE) > 0).groupBy("node", "gid").agg(F.sum("times").alias("times"), F.max("members").alias("members"))
    optional = optional.join(sets.select(F.col("key").alias("node"), "spare"), "node")
    by = Window.partitionBy("node")
    before = F.coalesce(F.sum("times").over(by.orderBy("members", "gid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bought = optional.withColumns({"before": before, "every": F.sum("times").over(by)}).where(F.col("before") < F.col("every") - F.col("spare")).select("gid", "node")
    must = made.where(F.col("flag").bitwiseAND(PROBES) > 0).select("gid", "node")
    return bought.unionByName(must).distinct()


def probed(made: DataFrame, sets: DataFrame) -> DataFrame:
    """gid, node, probe: the members of every list that a set has to probe, as a written table; from `lists`, whose table
    is removed. sets: key, spare."""
    chosen = written(probes(made.where("gid IS NOT NULL"), sets), "probes")
    state = made.where("gid IS NOT NULL").select("gid", "node").distinct().join(chosen.select("gid").distinct(), "gid", "left_semi")
    state = written(state.join(chosen.withColumn("probe", F.lit(True)), ["gid", "node"], "left").select("gid", "node", F.coalesce("probe", F.lit(False)).alias("probe")), "probed-lists")
    forget(made)
    forget(chosen)
    return state


def by_elements(state: DataFrame, texts: DataFrame, traits: DataFrame, n: int, percent: int, buckets: int) -> DataFrame:
    """Lists like `probed` gives, of the single elements of all sets in state (node, comp); the smaller of two similar sets
    probes. Lists within one component are left out."""
    table = written(state.select("node", "comp").distinct(), "open-nodes")
    nodes = small(table.select("node"))
    made = written(lists(texts.join(nodes, "node"), n, percent, buckets, single), "element-lists")
    lacked = F.floor((100 - percent) * F.col("size") / (100 + percent))  # elements that the larger set may not have
    out = probed(made, traits.join(nodes, "node").select(F.col("node").alias("key"), (F.col("size") - lacked - 1).alias("spare")))
    open_ = out.join(small(table), "node").groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count_if("probe").alias("n")).where("lo < hi AND n > 0")
    left = written(out.join(open_, "gid", "left_semi"), "probed-lists")
    for x in (table, out):
        forget(x)
    return together(left)


def together(state: DataFrame) -> DataFrame:
    """The lists (gid, node, probe), those that hang together by their members made one list where that takes no more
    comparisons: near copies are in many of each other's lists, and would meet in each. As a written table; state's is
    removed."""
    label = components(state.select(F.col("gid").alias("a"), F.col("node").alias("b")))
    held = written(state.join(label.select(F.col("node").alias("gid"), F.col("comp").alias("all")), "gid"), "held-lists")
    for x in (state, label):
        forget(x)
    work = lambda by: held.groupBy("all", by).agg(F.count_if("probe").cast("double").alias("p"), F.count(F.lit(1)).alias("n"))
    apart = work("gid").groupBy("all").agg(F.sum(F.col("p") * F.col("n")).alias("apart"))
    one = work("node").groupBy("all").agg(F.count_if(F.col("p") > 0).cast("double").alias("p"), F.count(F.lit(1)).alias("n"))
    one = written(apart.join(one, "all").where(F.col("p") * F.col("n") <= F.col("apart")).select("all"), "one-list")
    joint = held.join(one, "all", "left_semi").groupBy(F.col("all").alias("gid"), "node").agg(F.bool_or("probe").alias("probe"))
    out = written(held.join(one, "all", "left_anti").select("gid", "node", "probe").unionByName(joint), "probed-lists")
    for x in (held, one):
        forget(x)
    return out


def possible(a: dict[str, Column], b: dict[str, Column], percent: int) -> Column:
    """Whether two sets' sizes and sketches leave room for the similarity."""
    apart = F.lit(0)
    for c in SKETCH:
        apart = apart + F.bit_count(a[c].bitwiseXOR(b[c]))
    most = (100 - percent) * (a["size"] + b["size"])
    return ((100 + percent) * F.abs(a["size"] - b["size"]) <= most) & ((100 + percent) * apart <= most)


def linked(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """a, b, linked: the verified pairs, of a written table. texts: node, text; pairs counted to be few are sent to the
    texts, so that only theirs are dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text_a", 4 << 20):
                for both in slices(part, "text_b", 4 << 20):
                    x, y = Sets(both.column("text_a"), n), Sets(both.column("text_b"), n)
                    rows = both.num_rows
                    h = np.concatenate((x.h, y.h))
                    row = np.concatenate((x.row, y.row))
                    order = np.lexsort((h, row))
                    h, row = h[order], row[order]
                    common = np.bincount(row[1:][(h[1:] == h[:-1]) & (row[1:] == row[:-1])], minlength=rows) if len(h) else np.zeros(rows, np.int64)
                    union = x.size + y.size - common
                    yield pa.RecordBatch.from_arrays([both.column("a"), both.column("b"), pa.array((100 * common >= percent * union) & (common > 0))], ["a", "b", "linked"])

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    few = small(pairs)
    if few is not pairs:
        right = right.join(few.select("b"), "b", "left_semi")
    return few.join(left, "a").join(right, "b").mapInArrow(run, "a bigint, b bigint, linked boolean")


def against_all(docs: DataFrame, short: DataFrame, n: int, percent: int) -> DataFrame:
    """a, b: links between the sets in short (node, text) and all sets of docs, in blocks."""
    out = None
    spark = docs.sparkSession

    def block(rows: list) -> DataFrame:
        s = Sets(pa.array([r["text"] for r in rows]), n)
        order = np.argsort(s.h, kind="stable")
        sent = spark.sparkContext.broadcast((s.h[order], s.row[order], s.size, s.key))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            h, row, size, key = sent.value
            for batch in batches:
                for part in slices(batch, "text"):
                    x = Sets(part.column("text"), n)
                    lo, hi = np.searchsorted(h, x.h, "left"), np.searchsorted(h, x.h, "right")
                    k = hi - lo
                    at = np.repeat(lo - np.cumsum(k) + k, k) + np.arange(k.sum())
                    pair, common = np.unique(np.repeat(x.row, k).astype(np.int64) * len(size) + row[at], return_counts=True)
                    r, c = pair // len(size), pair % len(size)
                    ok = 100 * common >= percent * (x.size[r] + size[c] - common)
                    yield pa.RecordBatch.from_arrays([pa.array(x.key[r[ok]].view(np.int64)), pa.array(key[c[ok]].view(np.int64))], ["a", "b"])

        return docs.select("text").mapInArrow(run, "a bigint, b bigint").distinct()

    rows: list = []
    for r in short.toLocalIterator():
        rows.append(r)
        if len(rows) == BLOCK_SETS:
            out = block(rows) if out is None else out.unionByName(block(rows))
            rows = []
    if rows:
        out = block(rows) if out is None else out.unionByName(block(rows))
    return out


def joined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """For each row of docs its id, n_shingles, and component_id, the least id that links reach.

    Defined cases: null and empty texts have no shingles and no links; a row without an id links nothing
    and has no component; rows with equal sets are linked; rows of one id with different sets are
    different documents; an empty table stays empty; other columns are not read.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    table = written(measured(base, n, percent), "sets")
    sized = table.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)).alias("s")).first()["s"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a bucket names each of its rows once: few buckets, so that names don't outgrow the signatures
    buckets = max(min(parts, LEAST_BUCKETS), -(-int(sized) // BUCKET_ROWS))
    made = written(lists(base.where("doc IS NOT NULL"), n, percent, buckets), "lists")

    sets = table.where("doc IS NOT NULL AND n_shingles > 0").groupBy("key", "key2").agg(F.min("doc").alias("rep"), F.first("n_shingles").alias("size"), F.first("spare").alias("spare"), *[F.first(c).alias(c) for c in SKETCH])
    lacking = written(made.where("gid IS NULL").select("node").distinct(), "lacking")
    state = probed(made, sets)

    nodes = state.select("node").unionByName(lacking).distinct()
    traits = written(sets.join(nodes.withColumnRenamed("node", "key"), "key").select(F.col("key").alias("node"), "rep", "size", *SKETCH), "nodes")
    # a row for each set: of several rows of the id the one with this set
    holders = written(traits.select(F.col("rep").alias("doc"), "node"), "holders")
    texts = written(_keyed(base.join(small(holders), "doc"), n), "node-texts")
    forget(holders)

    verified = label = None
    spent = []  # tables that the result doesn't read
    pivots_a_round, alone = 1, False
    while True:
        last = state
        if label is not None:
            state = state.join(label, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        else:
            state = state.withColumn("comp", F.col("node"))
        open_ = state.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count_if("probe").alias("n"), F.min(F.when(F.col("probe"), F.col("node"))).alias("first")).where("lo < hi AND n > 0")
        # the pivots: one of the list's probing members at least, and by a hash about pivots_a_round of them
        unit = F.xxhash64("gid", "node").bitwiseAND(F.lit((1 << 30) - 1)) / F.lit(float(1 << 30))
        pivot = F.col("probe") & ((F.col("node") == F.col("first")) | (unit * F.col("n") < pivots_a_round - 1))
        state = written(state.join(open_.select("gid", "n", "first"), "gid").select("gid", "node", "probe", "comp", pivot.alias("pivot")), "open-lists")
        forget(last)
        if state.isEmpty():
            break
        if verified is not None and not alone:
            last, pivots_a_round, alone = state, 1, True
            state = by_elements(last, texts, traits, n, percent, buckets)
            forget(last)
            continue
        first, other = state.where("pivot").select("gid", "node", "comp"), state.select("gid", "node", "comp")
        near = F.lit(True)
        if verified is not None:  # lists that are still open are long, or of sets that are not similar
            first, other = (x.join(traits.drop("rep"), "node") for x in (first, other))
            near = possible({c: F.col(c) for c in ("size", *SKETCH)}, {c: F.col(f"b_{c}") for c in ("size", *SKETCH)}, percent)
        other = other.withColumnsRenamed({c: f"b_{c}" for c in other.columns if c != "gid"})
        pairs = first.join(other, "gid").where((F.col("comp") != F.col("b_comp")) & near).select(F.least("node", "b_node").alias("a"), F.greatest("node", "b_node").alias("b")).distinct()
        if verified is None:
            x, y = (traits.select(*[F.col(c).alias(f"{side}_{c}") for c in ("node", "size", *SKETCH)]) for side in "ab")
            near = possible({c: F.col(f"a_{c}") for c in ("size", *SKETCH)}, {c: F.col(f"b_{c}") for c in ("size", *SKETCH)}, percent)
            pairs = pairs.join(x, F.col("a") == F.col("a_node")).join(y, F.col("b") == F.col("b_node")).where(near).select("a", "b")
        else:
            pairs = pairs.join(verified.select("a", "b"), ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        checked = written(linked(pairs, texts, n, percent), "checked-pairs")
        forget(pairs)
        spent.append(checked)
        verified = checked if verified is None else verified.unionByName(checked)
        if label is None or not checked.where("linked").isEmpty():
            forget(label)
            label = components(verified.where("linked").select("a", "b"))
        state = state.where("NOT pivot").drop("comp", "pivot")
        pivots_a_round *= 4

    forget(state)
    lacking_texts = written(texts.join(lacking, "node"), "lacking-texts")
    if not lacking_texts.isEmpty():
        more = against_all(base.where("doc IS NOT NULL"), lacking_texts, n, percent)
        links = more if verified is None else more.unionByName(verified.where("linked").select("a", "b"))
        forget(label)
        label = components(links)
    for x in (*spent, texts, traits, lacking, lacking_texts):
        forget(x)

    sets = sets.select("key", "rep")
    least = sets if label is None else sets.join(label, sets["key"] == label["node"], "left").select("key", "rep", "comp")
    if label is not None:
        comp = least.where("comp IS NOT NULL").groupBy("comp").agg(F.min("rep").alias("c"))
        least = least.join(comp, "comp", "left").select("key", F.coalesce("c", "rep").alias("c"))
    else:
        least = least.withColumnRenamed("rep", "c")
    out = table.select("doc", "key", "n_shingles").join(least, "key", "left")
    component = F.when((F.col("n_shingles") == 0) | F.col("doc").isNull(), F.col("doc")).otherwise(F.col("c"))
    return out.select(F.col("doc").alias(id_col), "n_shingles", component.alias("component_id"))


def _keyed(rows: DataFrame, n: int) -> DataFrame:
    """node, text of the rows (node, text) whose text has the set named node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                ok = Sets(part.column("text"), n).key.view(np.int64) == np.asarray(part.column("node"))
                yield part.filter(pa.array(ok))

    return rows.select("node", "text").mapInArrow(run, "node bigint, text string").dropDuplicates(["node"])


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """One row of each component, the one with the least id, with the columns of docs; rows without an id
    stay."""
    classes = joined(docs, id_col, text_col, n, percent)
    rest = written(classes.where(F.col("component_id") < F.col(id_col)).select(F.col(id_col)).distinct(), "copies")
    return docs.join(small(rest), id_col, "left_anti").select(*docs.columns)
