"""Sharding by a permutation-filled lookup table (native DataFrame functions only).

Each shard has its own permutation of the slots of a prime-sized table: offset, offset + skip, offset + 2 skip, ...
Shards take turns, each claiming the next slot of its permutation that is still free, until the table is full; so
shares differ by one slot at most, and when a shard leaves, few other slots change hands. The table has as many entries as
the prime, whatever the data; it is broadcast, and a document is placed by one hash and one look-up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


@cache
def lookup_table(shards: tuple[str, ...], slots: int) -> list[int]:
    """For each slot the index of the shard that claimed it. slots is prime and above the number of shards."""
    if not shards or len({*shards}) < len(shards):
        raise ValueError("shards must be named, each once")
    if slots < len(shards) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be a prime, not below that of shards")
    offset = [_number(f"offset:{s}") % slots for s in shards]
    skip = [_number(f"skip:{s}") % (slots - 1) + 1 for s in shards]
    taken, step, left = [-1] * slots, [0] * len(shards), slots
    while True:
        for k in range(len(shards)):
            while taken[at := (offset[k] + step[k] * skip[k]) % slots] >= 0:
                step[k] += 1
            taken[at] = k
            left -= 1
            if not left:
                return taken


def slot_of(key: Column, slots: int) -> Column:
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long") % slots).cast("int")


def shard(docs: DataFrame, key_col: str = "doc_id", shards: Sequence[str] = tuple(f"shard-{i:03}" for i in range(64)), slots: int = 4099) -> DataFrame:
    """All rows and columns of docs with slot and shard (columns of these names are replaced).

    Equal keys go to the same shard; a null key is placed like the empty string. An empty table stays empty.
    """
    owners = F.split(F.lit(",".join(map(str, lookup_table(tuple(shards), slots)))), ",")
    table = docs.sparkSession.range(1).select(F.posexplode(owners).alias("slot", "_k"))
    table = table.select("slot", F.element_at(F.array(*map(F.lit, shards)), F.col("_k").cast("int") + 1).alias("shard"))
    return docs.drop("slot", "shard").withColumn("slot", slot_of(F.col(key_col), slots)).join(F.broadcast(table), "slot")
