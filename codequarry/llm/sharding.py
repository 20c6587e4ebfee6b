"""Sharding by a permutation-filled lookup table (DataFrame operations only).

Each shard has a permutation of the slots 0 .. size-1 given by an offset and a stride; size is prime, so every stride visits
all slots. The shards take turns, each claiming the first unclaimed slot of its permutation, until none is left. A row goes
to the shard that owns the slot of its key's hash. The table has `size` rows whatever the data, so it is broadcast;
placement is one hash and one lookup per row, without a shuffle. When a shard leaves, nearly all other rows stay.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import hash_bucket

#: Production parameters: shard names and a prime of at least 100 slots a shard.
SHARDS, SLOTS = tuple(f"shard-{i:02d}" for i in range(16)), 2039


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:7], 16)


def fill_table(shards: tuple[str, ...], slots: int) -> list[int]:
    """Owner (index into shards) of each slot. Work on the driver is bounded by shards and slots, both parameters."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct and not empty")
    if slots < len(shards) or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime no less than the number of shards")
    place = [_number(f"offset:{s}") % slots for s in shards]
    stride = [_number(f"stride:{s}") % (slots - 1) + 1 for s in shards]
    owner, claimed = [-1] * slots, 0
    while claimed < slots:
        for k in range(len(shards)):
            while owner[place[k]] >= 0:
                place[k] = (place[k] + stride[k]) % slots
            owner[place[k]] = k
            claimed += 1
            if claimed == slots:
                break
    return owner


def lookup_table(spark: SparkSession, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """slot, shard: one row for each of the slots."""
    owners = F.split(F.lit(",".join(map(str, fill_table(shards, slots)))), ",")
    names = F.array(*[F.lit(s) for s in shards])
    table = spark.range(1).select(F.posexplode(owners).alias("slot", "owner"))
    return table.select(F.col("slot").cast("long"), F.element_at(names, F.col("owner").cast("int") + 1).alias("shard"))


def place(rows: DataFrame, key: Column, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """rows with slot and shard (replacing columns of those names).

    A null key hashes as the empty text; equal keys, and so repeated rows, share a slot. Every row of the input keeps one row. key may read the
    columns that are replaced.
    """
    slotted = rows.select(*[F.col(f"`{c}`") for c in rows.columns if c not in ("slot", "shard")], hash_bucket(key, slots).alias("slot"))
    return slotted.join(F.broadcast(lookup_table(rows.sparkSession, shards, slots)), "slot")


#: The turns in SQL: one claim an iteration; the state is the owners so far and each shard's place in its permutation.
SHARD_SQL = f"""
WITH RECURSIVE p AS (
  SELECT list(CAST(('0x' || substr(md5('offset:shard-' || lpad(CAST(i AS VARCHAR), 2, '0')), 1, 7)) AS BIGINT) % {SLOTS} ORDER BY i) AS o,
         list(CAST(('0x' || substr(md5('stride:shard-' || lpad(CAST(i AS VARCHAR), 2, '0')), 1, 7)) AS BIGINT) % {SLOTS - 1} + 1 ORDER BY i) AS s
  FROM range({len(SHARDS)}) AS r(i)),
pref AS (
  SELECT k, list((o[k + 1] + s[k + 1] * j) % {SLOTS} ORDER BY j) AS slots
  FROM p, range({len(SHARDS)}) AS a(k), range({SLOTS}) AS b(j) GROUP BY k),
turns(t, slot, taken) AS (
  SELECT CAST(-1 AS BIGINT), CAST(-1 AS BIGINT), list_transform(range({SLOTS}), lambda x: false)
  UNION ALL
  SELECT t + 1, got, list_transform(taken, lambda v, i: v OR i - 1 = got)
  FROM (SELECT t, taken, list_filter(pref.slots, lambda x: NOT taken[x + 1])[1] AS got
        FROM turns JOIN pref ON pref.k = (turns.t + 1) % {len(SHARDS)} WHERE t + 1 < {SLOTS})),
owners AS (SELECT slot, 'shard-' || lpad(CAST(t % {len(SHARDS)} AS VARCHAR), 2, '0') AS shard FROM turns WHERE t >= 0)
SELECT doc_id, slot, shard
FROM (SELECT doc_id, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 7)) AS BIGINT) % {SLOTS} AS slot FROM documents)
JOIN owners USING (slot)
"""
