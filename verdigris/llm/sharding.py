"""Consistent placement by a permutation-filled lookup table.

The shards take turns; each claims the next free slot of its own preference
order, (offset + j * skip) modulo a prime, until every slot is taken. Shares then
differ by one slot at most, and a change of shards moves few slots. A document's
key hashes to a slot, and a broadcast of the table (its size is the prime, not
the data) gives the shard at once. Rows are never dealt by source or text, so a
hot source spreads over all shards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Prime number of slots: over 1,000 for each of up to 64 shards.
SLOTS = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def preference(name: str, slots: int) -> tuple[int, int]:
    """Offset and skip of a shard's preference order; the skip is never 0 modulo the prime."""
    digest = hashlib.sha256(name.encode()).digest()
    return int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:16], "big") % (slots - 1) + 1


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """The index of the shard that owns each slot."""
    if not _is_prime(slots):
        raise ValueError(f"{slots} is not prime")
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct, at least one and at most one for each slot")
    owner = [-1] * slots
    orders = [preference(s, slots) for s in shards]
    at = [offset for offset, _ in orders]
    left = slots
    while True:
        for i, (_, skip) in enumerate(orders):
            slot = at[i]
            while owner[slot] >= 0:
                slot = (slot + skip) % slots
            owner[slot] = i
            at[i] = (slot + skip) % slots
            left -= 1
            if not left:
                return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """60 bits of the key's MD5 modulo the prime; a null key counts as the empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("bigint") % slots


def place(df: DataFrame, key: str, shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Adds slot (long) and shard (string); columns of these names are replaced.

    Equal keys share a shard; a null key has the empty string's. Repeated rows
    stay. The table is broadcast: its rows are the prime's, whatever the data.
    """
    owners = lookup_table(shards, slots)
    spark = df.sparkSession
    names = F.split(F.lit("\u0001".join(shards)), "\u0001")
    table_df = spark.range(1).select(F.posexplode(F.split(F.lit(",".join(map(str, owners))), ",")).alias("slot", "owner"))
    table_df = table_df.select(F.col("slot").cast("bigint").alias("slot"), F.element_at(names, F.col("owner").cast("int") + 1).alias("shard"))
    keyed = df.drop("shard").withColumn("slot", slot_of(F.col(key), slots)) if key != "shard" else df.withColumn("slot", slot_of(F.col(key), slots)).drop("shard")
    return keyed.join(F.broadcast(table_df), "slot").select(*[c for c in df.columns if c not in ("slot", "shard")], "slot", "shard")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's slot and shard: doc_id, source, slot, shard. A null doc_id has the empty string's; repeated rows stay."""
    return place(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
