"""Sharding by a permutation-filled lookup table: shards take turns claiming slots of a prime-sized table, each in the order
of its own preference; a document's hash picks a slot, the slot names the shard. Placement is one lookup in a broadcast
table of fixed size, and a shard that leaves or joins moves little besides its own share.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots: a prime, large against the number of shards. The table depends on parameters alone, never on the data.
SLOTS = 65_537


def _hash(*parts: object) -> int:
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def lookup_table(shards: list[str], slots: int = SLOTS, weights: dict[str, int] | None = None) -> list[int]:
    """For each slot the number of its shard. A shard of weight w has w turns a round, none of weight 0. Names must differ; weights
    of other names, negative ones, and no turns at all are errors."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards need different names")
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    if weights and (set(weights) - set(shards) or min(weights.values()) < 0 or not any(weights.get(s, 1) for s in shards)):
        raise ValueError("weights are for shards, not negative, and not all 0")
    at = [_hash("offset", s) % slots for s in shards]
    skip = [_hash("skip", s) % (slots - 1) + 1 for s in shards]
    turns = [i for i, s in enumerate(shards) for _ in range((weights or {}).get(s, 1))]
    table, left = [-1] * slots, slots
    while left:
        for i in turns:
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            table[at[i]] = i
            left -= 1
            if not left:
                break
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key by the first 60 bits of its MD5; null counts as the empty string."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long"), F.lit(slots))


def table_rows(spark: SparkSession, table: list[int]) -> DataFrame:
    """(slot, shard) rows of a table, as one literal in the plan."""
    text = F.lit(",".join(map(str, table)))
    return spark.range(1).select(F.posexplode(F.split(text, ",")).alias("slot", "shard")).select(F.col("slot").cast("long"), F.col("shard").cast("long"))


def place(docs: DataFrame, shards: list[str], id_col: str = "doc_id", slots: int = SLOTS, weights: dict[str, int] | None = None) -> DataFrame:
    """For each row of ``docs``: its id, slot, shard_id (number in ``shards``). Rows with the same id go to the same shard;
    rows without one go where the empty string goes. An empty table gives an empty result. Other columns are ignored."""
    side = F.broadcast(table_rows(docs.sparkSession, lookup_table(shards, slots, weights)).withColumnsRenamed({"slot": "__slot", "shard": "shard_id"}))
    rows = docs.select(F.col(id_col), slot_of(F.col(id_col), slots).alias("slot"))
    return rows.join(side, F.col("slot") == F.col("__slot")).drop("__slot")
