"""Sharding through a permutation-filled lookup table.

Shards take turns claiming free slots of a prime-sized table, each in its own preference order
(offset + j * skip modulo the prime), so every shard gets within a few slots of its share and few
slots move when a shard joins or leaves. The table has `size` entries whatever the data: it is
broadcast, and a row's shard costs one hash and one look-up. Nothing is shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARDS = tuple(f"shard-{i:03d}" for i in range(64))
SIZE = 65537
MOST_SLOTS = 1 << 20


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _number(shard: str, salt: str) -> int:
    return int.from_bytes(hashlib.md5(f"{salt}:{shard}".encode()).digest()[:8], "big")


def lookup(shards: list[str] | tuple[str, ...] = SHARDS, size: int = SIZE) -> np.ndarray:
    """The table: slot -> index of a shard. Shards claim in the order of their names, so the table
    does not depend on the order in which they are listed."""
    if len(set(shards)) != len(shards) or not shards:
        raise ValueError("shards must be distinct, one at least")
    if not is_prime(size) or size <= len(shards) or size > MOST_SLOTS:
        raise ValueError(f"size must be a prime over the number of shards and at most {MOST_SLOTS}")
    order = sorted(range(len(shards)), key=lambda i: shards[i])
    start = {i: _number(shards[i], "offset") % size for i in order}
    skip = {i: _number(shards[i], "skip") % (size - 1) + 1 for i in order}
    at = dict(start)
    out = np.full(size, -1, np.int32)
    left = size
    while left:
        for i in order:
            while out[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % size
            out[at[i]] = i
            left -= 1
            if not left:
                break
    return out


def slot(key: Column, size: int = SIZE) -> Column:
    """The slot of a key: its MD5's first 32 bits modulo the size. A null key counts as ''."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % size).cast("int")


def assign(df: DataFrame, key: str = "doc_id", shards=SHARDS, size: int = SIZE, slot_as: str = "slot", shard_as: str = "shard") -> DataFrame:
    """Adds the slot (int) and shard (string) of each row.

    Defined cases: a null key is placed like the empty string; equal keys share a shard; an empty
    table stays empty; a column named like an added one is replaced; all else passes unchanged.
    """
    table = lookup(shards, size)
    places = F.broadcast(
        df.sparkSession.createDataFrame([(i, shards[s]) for i, s in enumerate(table.tolist())], f"`{slot_as}` int, `{shard_as}` string")
    )
    bare = df.drop(slot_as, shard_as)
    return bare.withColumn(slot_as, slot(bare[key], size)).join(places, slot_as, "left").select(*[bare[c] for c in bare.columns], slot_as, shard_as)


def moved(before, after, size: int = SIZE) -> float:
    """The share of slots whose shard differs between two sets of shards."""
    a, b = lookup(before, size), lookup(after, size)
    return float(np.mean([before[i] != after[j] for i, j in zip(a, b, strict=True)]))
