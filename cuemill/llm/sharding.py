"""Placement of documents on shards by a permutation-filled lookup table.

Each shard ranks all slots of a prime-sized table by an offset and a step drawn from its name. The shards take turns
claiming the free slot they like best until the table is full. Shares differ by one slot at most, and when a shard
comes or goes few slots change hands. A key's slot is its hash modulo the table size.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.llm.shared import Carried

#: Prime number of slots; over a hundred for each of up to 600 shards.
SLOTS = 65_537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def preferences(shard: str, slots: int) -> tuple[int, int]:
    """First choice and step of a shard's walk over the slots; the step has no factor with a prime table size."""
    digest = hashlib.md5(shard.encode()).hexdigest()
    return int(digest[:15], 16) % slots, int(digest[15:30], 16) % (slots - 1) + 1


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """Index of the shard that owns each slot."""
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct, at least one and at most as many as slots")
    if not _is_prime(slots):
        raise ValueError("the number of slots must be prime")
    walks = [preferences(s, slots) for s in shards]
    owner, tried, filled = [-1] * slots, [0] * len(shards), 0
    while True:
        for k, (first, step) in enumerate(walks):
            while owner[slot := (first + tried[k] * step) % slots] >= 0:
                tried[k] += 1
            owner[slot] = k
            tried[k] += 1
            filled += 1
            if filled == slots:
                return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key: 60 bits of the MD5 of its text; a null key counts as the empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(slots))


def place(docs: DataFrame, shards: list[str], key: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """`docs` with `slot` and `shard`, which replace columns of those names.

    The lookup table has `slots` rows of two small columns, about a megabyte whatever the corpus, so it is broadcast
    and each row is placed by one hash lookup, without a shuffle: a hot source or group of copies spreads by its keys.
    Rows with a null key share a slot (theirs is the empty text's); equal keys share one; an empty table stays empty.
    """
    owners = lookup_table(shards, slots)
    spark: SparkSession = docs.sparkSession
    table = spark.createDataFrame([(slot, shards[k]) for slot, k in enumerate(owners)], "slot long, shard string")
    own = Carried(docs, key)
    held = F.struct("slot", "shard").alias("at")
    keyed = own.df.select(F.col(f"`{key}`").alias("key"), "carried", slot_of(F.col(f"`{key}`"), slots).alias("slot"))
    placed = keyed.join(F.broadcast(table.select("slot", held)), "slot")
    return placed.select(*own.restored(("slot", "shard"), **{key: F.col("key")}), "at.slot", "at.shard")
