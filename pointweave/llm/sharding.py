"""Consistent sharding by a permutation-filled lookup table.

Every shard has a permutation of the table's slots, an offset and a stride from
its name's hash.  Shards take turns claiming their next free slot until the
table, whose size is prime, is full.  A key's shard is then one look at the
broadcast table, whose size is fixed by ``slots`` and not by the data.  Removing
a shard moves the keys of its own slots and few others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The largest prime below 2 ** 14: 256 slots a shard at 64 shards.
SLOTS = 16381
MOST_SLOTS = 1 << 20
SHARDS = tuple(f"shard-{k:03d}" for k in range(64))


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """The shard's position in ``shards`` for every slot."""
    if not shards or len(set(shards)) != len(shards) or not _is_prime(slots) or not len(shards) <= slots <= MOST_SLOTS:
        raise ValueError(f"shards must be distinct and fewer than slots, a prime of {MOST_SLOTS} at most")
    moves = []
    for name in shards:
        h = int.from_bytes(hashlib.sha256(name.encode()).digest()[:16], "big")
        moves.append([h % slots, (h >> 64) % (slots - 1) + 1])
    table, left = [-1] * slots, slots
    while left:
        for k, move in enumerate(moves):
            while table[move[0]] >= 0:
                move[0] = (move[0] + move[1]) % slots
            table[move[0]] = k
            left -= 1
            if not left:
                break
    return table


def table_frame(spark: SparkSession, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """(slot, shard) for every slot, from one literal."""
    owners = F.split(F.lit(",".join(map(str, lookup_table(shards, slots)))), ",")
    return spark.range(1).select(F.posexplode(owners).alias("slot", "owner")).select("slot", F.col("owner").cast("int").alias("shard"))


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The key's slot: 60 bits of the MD5 of its text, modulo the table's size; null counts as empty text."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15)
    return (F.conv(digits, 16, 10).cast("long") % slots).cast("int")


def place(rows: DataFrame, key_col: str, shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``key_col``, slot and shard of every row.

    Equal keys share a shard; null is a key like any other.  Other columns are
    not read, so none can clash.  An empty table gives an empty result.
    """
    keys = rows.select(F.col(key_col).alias("key")).withColumn("slot", slot_of(F.col("key"), slots))
    table = F.broadcast(table_frame(rows.sparkSession, shards, slots))
    return keys.join(table, "slot").select(F.col("key").alias(key_col), "slot", "shard")


def oracle(key: str, source: str, shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> str:
    """DuckDB's form of ``place``."""
    owners = ",".join(map(str, lookup_table(shards, slots)))
    return f"""
WITH owners AS (SELECT string_split('{owners}', ',') AS o),
lookup AS (SELECT unnest(range(len(o)))::INT AS slot, unnest(o)::INT AS shard FROM owners),
keys AS (SELECT {key}, (('0x' || substr(md5(coalesce({key}::VARCHAR, '')), 1, 15))::BIGINT % {slots})::INT AS slot FROM {source})
SELECT {key}, slot, shard FROM keys JOIN lookup USING (slot)"""
