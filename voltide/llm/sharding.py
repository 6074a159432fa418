"""Sharding by a permutation-filled lookup table.

Every shard has an order of preference over the slots of a table of prime size: slot (offset +
j * skip) mod size for j = 0, 1, ... The shards take turns, each claiming the first slot of its
order that is still free, until the table is full. A document goes to the shard that owns the slot
of its key's hash. The table has a fixed size, so broadcasting it is bounded; adding or removing a
shard moves few keys.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltide.llm.common import unused

SIZE = 2039  # prime, over a hundred slots per shard for 16 shards


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:12], 16)


def fill(shards: list[str], size: int = SIZE) -> list[int]:
    """The owner of each slot, as a position in `shards`."""
    if size < 2 or any(size % k == 0 for k in range(2, int(size**0.5) + 1)):
        raise ValueError("the table's size must be prime")
    if not 0 < len(shards) <= size:
        raise ValueError("needs at least one shard and no more than slots")
    offset = [_number(f"{s}/offset") % size for s in shards]
    skip = [_number(f"{s}/skip") % (size - 1) + 1 for s in shards]
    at, owner = [0] * len(shards), [-1] * size
    for turn in range(size):
        k = turn % len(shards)
        while owner[slot := (offset[k] + at[k] * skip[k]) % size] >= 0:
            at[k] += 1
        owner[slot] = k
    return owner


def lookup_table(spark: SparkSession, shards: list[str], size: int = SIZE) -> DataFrame:
    """slot, shard: `size` rows, whatever the data."""
    owners = ",".join(str(k) for k in fill(shards, size))
    names = F.array(*map(F.lit, shards))
    return spark.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("slot", "k")).select("slot", F.element_at(names, F.col("k").cast("int") + 1).alias("shard"))


def assign(df: DataFrame, key: str, shards: list[str], size: int = SIZE) -> DataFrame:
    """Add slot and shard to the key of every row: key, slot, shard (with underscores in front where
    the key has that name).

    The slot is the number in the first 12 hex digits of the key's MD5 modulo `size`; a null key
    counts as an empty text. Equal keys share a shard; an empty table gives an empty result.
    """
    slot = F.pmod(F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("long"), F.lit(size)).cast("int")
    placed = df.select(F.col(key).alias("key"), slot.alias("slot"))
    own = df.select(key)
    names = [F.col("key").alias(key), F.col("slot").cast("long").alias(unused(own, "slot")), F.col("shard").alias(unused(own, "shard"))]
    return placed.join(F.broadcast(lookup_table(df.sparkSession, shards, size)), "slot").select(*names)
