"""Sharding through a permutation-filled lookup table."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A prime, far above the number of shards: shares differ by about shards / slots.
SLOTS = 65_537
MAX_SLOTS = 1 << 20


def _number(text: str, modulus: int) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16) % modulus


def fill_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """Shard index of every slot.

    Each shard prefers the slots ``offset + i * skip`` modulo the prime number of slots, both numbers hashed
    from its name. In turns, every shard claims its best slot that is free, until none is. Names decide, not
    positions in the list, so adding or removing a shard moves little else.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be given once each")
    if not len(shards) <= slots <= MAX_SLOTS or any(slots % p == 0 for p in range(2, int(slots ** 0.5) + 1)):
        raise ValueError(f"slots must be a prime of at most {MAX_SLOTS}, not below the number of shards")
    order = sorted(range(len(shards)), key=lambda i: shards[i])
    at = [_number(f"offset {s}", slots) for s in shards]
    skip = [1 + _number(f"skip {s}", slots - 1) if slots > 2 else 1 for s in shards]
    table, free = [-1] * slots, slots
    while free:
        for i in order:
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            table[at[i]] = i
            free -= 1
            if not free:
                break
    return table


def table_frame(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """``slot, shard``: the lookup table as a frame of ``slots`` rows, at most ``MAX_SLOTS``."""
    numbers = ",".join(map(str, fill_table(shards, slots)))
    names = ", ".join("'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'" for s in shards)
    return spark.sql(f"SELECT pos AS slot, element_at(array({names}), col + 1) AS shard"
                     f" FROM (SELECT posexplode(from_json('[{numbers}]', 'array<int>')))")


def slot_of(key: str, slots: int = SLOTS) -> str:
    """Slot of a string expression; null is the empty string."""
    return f"CAST(CAST(conv(substring(md5(coalesce({key}, '')), 1, 15), 16, 10) AS BIGINT) % {slots} AS INT)"


def place(df: DataFrame, shards: list[str], *, id_col: str = "doc_id", text_col: str = "text",
          slots: int = SLOTS, slot_name: str = "slot", shard_name: str = "shard") -> DataFrame:
    """``df`` with the slot and shard of every row: one hash and one lookup in a broadcast table.

    The key is the id; rows with a null id are placed by their text, so they do not gather in one shard.
    The table has ``slots`` rows whatever the input, hence the broadcast; rows are not moved. Repeated rows
    share a shard. Columns that already have a name of the two results are replaced; an empty table gives no rows.
    """
    lookup = table_frame(df.sparkSession, shards, slots).toDF("__slot", "__shard")
    keyed = df.drop(slot_name, shard_name).withColumn("__slot", F.expr(slot_of(
        f"coalesce(CAST(`{id_col}` AS STRING), CAST(`{text_col}` AS STRING))", slots)))
    return (keyed.join(F.broadcast(lookup), "__slot", "left")
            .withColumnsRenamed({"__slot": slot_name, "__shard": shard_name}))
