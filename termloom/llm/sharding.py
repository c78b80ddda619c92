"""Operator 1: permutation-filled lookup table (native).

Shards take turns claiming slots of a prime-sized table, each by its own
preference order, until the table is full. A key hashes to a slot; the slot
names the shard. Shares differ by at most one slot, and a shard that leaves or
joins moves little more than its own share. The table has a fixed size
(``slots`` rows, whatever the input), so its broadcast is bounded and a row is
placed by one hash and one lookup, with no shuffle.

Defined cases: a null key is placed as the empty string; an empty table gives
an empty result; equal keys always share a shard; input columns named as the
output columns (``slot``, ``shard``) are refused.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARDS = [f"shard-{i:02d}" for i in range(32)]
SLOTS = 5003


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _number(text: str) -> int:
    """First 60 bits of the MD5, the same number ``key_number`` gives in SQL."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def key_number(key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """Slot -> index of the shard that claimed it."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct and at least one")
    if not _is_prime(slots) or slots < len(shards):
        raise ValueError("slots must be a prime of at least the number of shards")
    offset = [_number(f"offset:{s}") % slots for s in shards]
    skip = [_number(f"skip:{s}") % (slots - 1) + 1 for s in shards]
    table, turn, claimed = [-1] * slots, [0] * len(shards), 0
    while True:
        for i in range(len(shards)):
            while table[at := (offset[i] + turn[i] * skip[i]) % slots] >= 0:
                turn[i] += 1
            table[at] = i
            claimed += 1
            if claimed == slots:
                return table


def assign_shards(df: DataFrame, key: str, shards: list[str] | None = None, slots: int = SLOTS) -> DataFrame:
    """``df`` with ``slot`` and ``shard``; narrow, no shuffle."""
    shards = shards or SHARDS
    if clash := {"slot", "shard"} & set(df.columns):
        raise ValueError(f"input already has {sorted(clash)}")
    rows = [(i, shards[s]) for i, s in enumerate(lookup_table(shards, slots))]
    table = df.sparkSession.createDataFrame(rows, "slot int, shard string")
    placed = df.withColumn("slot", (key_number(F.col(f"`{key}`")) % slots).cast("int"))
    return placed.join(F.broadcast(table), "slot").select(*[F.col(f"`{c}`") for c in df.columns], "slot", "shard")


def write_shards(df: DataFrame, key: str, path: str, shards: list[str] | None = None, files_per_shard: int = 8) -> None:
    """Write one folder per shard; each shard is salted over ``files_per_shard`` tasks."""
    out = assign_shards(df, key, shards)
    salt = F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(files_per_shard))
    out.repartition(len(shards or SHARDS) * files_per_shard, "shard", salt).write.partitionBy("shard").parquet(path)
