"""Shard placement by a lookup table that shards fill in turns, each by its own permutation of the slots.

Each shard's preference order is a permutation of a prime number of slots (offset and skip from its name's hash); shards
take turns, a shard of weight k taking k turns a round, each time claiming its next free slot. A key goes to the shard
that holds slot hash(key) mod table size. Adding or removing a shard moves few keys. The table's size is fixed by the
caller, so its broadcast has a known bound of about 20 bytes a slot.

Defined cases: a null key hashes as the empty string; equal keys share a shard; an empty table gives an empty one;
columns of the input named slot or shard are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLE_SIZE = 65_537


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: list[str], size: int = TABLE_SIZE, weights: list[int] | None = None) -> np.ndarray:
    """Index of the shard of each slot. The result doesn't depend on the order in which shards are listed but by their names."""
    if not is_prime(size) or not shards or len(set(shards)) != len(shards) or len(shards) > size:
        raise ValueError("the table's size must be a prime number, with at least one shard of its own name for it")
    turns = weights or [1] * len(shards)
    if len(turns) != len(shards) or min(turns) < 1:
        raise ValueError("each shard takes at least one turn")
    offset = [_hash(f"offset {s}") % size for s in shards]
    skip = [_hash(f"skip {s}") % (size - 1) + 1 for s in shards]
    table, tried, free = np.full(size, -1, np.int32), [0] * len(shards), size
    order = sorted(range(len(shards)), key=lambda i: shards[i])
    while True:
        for i in order:
            for _ in range(turns[i]):
                while table[slot := (offset[i] + tried[i] * skip[i]) % size] >= 0:
                    tried[i] += 1
                table[slot] = i
                tried[i] += 1
                free -= 1
                if not free:
                    return table


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """The key's slot: 15 hex digits of its MD5 as a number, modulo the table's size."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")


def placed(df: DataFrame, key: str, shards: list[str], size: int = TABLE_SIZE, weights: list[int] | None = None) -> DataFrame:
    """df with slot (int) and shard (the name), by a broadcast of the table; no shuffle."""
    table = lookup_table(shards, size, weights)
    rows = df.sparkSession.createDataFrame(pd.DataFrame({"slot": np.arange(size, dtype=np.int32), "shard": np.array(shards, object)[table]}), "slot int, shard string")
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("slot", "shard")]
    with_slot = df.select(*kept, slot_of(F.col(f"`{key}`"), size).alias("slot"))
    return with_slot.join(F.broadcast(rows), "slot").select(*kept, "slot", "shard")
