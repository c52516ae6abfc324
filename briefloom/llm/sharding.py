"""Sharding by a permutation-filled lookup table: shards take turns claiming slots of a prime-sized table.

Each shard has its own order of preference over all slots, (offset + j * skip) mod size, and claims its best free slot
when its turn comes, until the table is full. A row's slot is the hash of its key modulo the size. When a shard leaves,
nearly all slots of the others stay. The table has a fixed size that does not grow with the data, so it is broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from briefloom.llm.common import hash60

#: Slots of the table: a prime, over 100 times the number of shards, so that shares differ by less than about 1 %.
TABLE_SIZE = 2039


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: Sequence[str], size: int = TABLE_SIZE) -> list[int]:
    """The shard's index for each slot."""
    if not shards or len(set(shards)) != len(shards) or len(shards) > size:
        raise ValueError("shards must be distinct, at least one, and no more than slots")
    if size < 2 or any(size % p == 0 for p in range(2, int(size ** 0.5) + 1)):
        raise ValueError("the table's size must be a prime")
    place = [_number(f"offset|{s}") % size for s in shards]
    skip = [_number(f"skip|{s}") % (size - 1) + 1 for s in shards]
    owner = [-1] * size
    for turn in range(size):
        i = turn % len(shards)
        while owner[place[i]] >= 0:
            place[i] = (place[i] + skip[i]) % size
        owner[place[i]] = i
    return owner


def place(df: DataFrame, key_cols: Sequence[str], shards: Sequence[str], size: int = TABLE_SIZE) -> DataFrame:
    """``df`` with ``slot`` and ``shard``, from the columns ``key_cols``; columns of these names are replaced.

    Null keys hash as the word null; equal keys meet in one shard, so choose keys of which none is frequent (ids).
    No shuffle: the table of ``size`` rows is broadcast. Empty input gives no rows.
    """
    spark: SparkSession = df.sparkSession
    owner = lookup_table(shards, size)
    table = spark.createDataFrame([(i, shards[o]) for i, o in enumerate(owner)], "__slot long, __shard string")
    slot = F.pmod(hash60("key", *(F.col(c) for c in key_cols)), F.lit(size))
    out = df.drop("slot", "shard").withColumn("__at", slot).join(F.broadcast(table), F.col("__at") == F.col("__slot"))
    return out.withColumns({"slot": F.col("__slot"), "shard": F.col("__shard")}).drop("__at", "__slot", "__shard")
