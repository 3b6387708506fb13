"""Sharding by a permutation-filled lookup table.

Every shard has its own preference order over the slots of a prime-sized table.  The
shards take turns: each claims the first free slot of its order until the table is full,
so shares differ by one slot at most, and removing a shard moves few keys besides its
own.  A row finds its shard by one hash and one lookup in the broadcast table.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmill.llm.common import without

#: The table travels to every executor; this bounds it to a few MB whatever the input.
MOST_SLOTS = 1 << 18


def _digits(name: str, begin: int) -> int:
    return int(hashlib.md5(name.encode()).hexdigest()[begin : begin + 15], 16)


def lookup_table(shards: list[str], slots: int) -> list[int]:
    """The number of the owning shard for each slot.

    A shard starts at one hash of its name and steps by another; as ``slots`` is prime,
    the steps reach every slot.  Raises ValueError for no shard, repeated names, more
    shards than slots, a size that is not prime or a table over MOST_SLOTS.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be there and differ")
    if not len(shards) <= slots <= MOST_SLOTS:
        raise ValueError(f"between {len(shards)} and {MOST_SLOTS} slots are needed")
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    at = [_digits(name, 0) % slots for name in shards]
    step = [_digits(name, 15) % (slots - 1) + 1 for name in shards]
    owner = [-1] * slots
    for turn in range(slots):
        shard = turn % len(shards)
        while owner[at[shard]] >= 0:
            at[shard] = (at[shard] + step[shard]) % slots
        owner[at[shard]] = shard
    return owner


def table_frame(spark: SparkSession, shards: list[str], slots: int) -> DataFrame:
    """(slot, shard) rows of the lookup table."""
    owners = ",".join(map(str, lookup_table(shards, slots)))
    names = F.split(F.lit("\x1f".join(shards)), "\x1f")
    return (
        spark.range(1)
        .select(F.posexplode(F.split(F.lit(owners), ",")).alias("slot", "owner"))
        .select("slot", F.element_at(names, F.col("owner").cast("int") + 1).alias("shard"))
    )


def slot_of(key: Column, slots: int) -> Column:
    """The slot of a key: 60 bits of the MD5 of its text; null hashes as the empty text."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15)
    return (F.conv(digits, 16, 10).cast("long") % slots).cast("int")


def place(df: DataFrame, key: str, shards: list[str], slots: int = 4099) -> DataFrame:
    """``df`` with ``slot`` and ``shard``; columns of these names are replaced.

    One row in, one row out: equal keys get equal shards, null keys share the empty
    text's shard, an empty table stays empty.  No shuffle: a hot key costs nothing.
    """
    keyed = without(df, "slot", "shard") if key.lower() not in ("slot", "shard") else df
    if keyed is df:
        raise ValueError(f"the key may not be named {key}")
    keyed = keyed.withColumn("slot", slot_of(F.col(f"`{key}`"), slots))
    found = F.broadcast(table_frame(df.sparkSession, shards, slots))
    return keyed.join(found, "slot", "left").select(*keyed.columns, "shard")
