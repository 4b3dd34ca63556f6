"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Records are hashed into ``N_SLOTS`` slots; bytes and rows are summed per slot,
and a small map (slot -> shard, with a version) says which shard holds a slot.
The map is filled heaviest slot first into the lightest shard.  Rebalancing
edits the map: only the slots named by the edit move, every other record stays
where it is; each edit is a new version of the same table.

The query follows the law ``bytes``: sizes near equal.  A record's place in its
shard (``slot``, gapless from 0) is its rank within its virtual slot plus the
rows of the slots before it in that shard, so no task ranks a whole shard.

Defined results: a null text counts as empty (16 bytes, crc32 0); a null doc_id
is hashed as a value of its own; equal texts and repeated rows are separate
records with places of their own; an empty table gives no rows and an empty
map.  Only doc_id and text are read, other columns cannot clash.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from retentia.llm._store import stored

N_SLOTS = 16_384
CELLS = 4          # parts of a slot that are ranked apart
MAP_SCHEMA = "version int, virtual_slot int, shard int, bytes long, rows long"


def records(documents: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, virtual_slot, cell."""
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    crc = F.crc32(data)
    hashed = F.xxhash64(F.col("doc_id"), crc)
    return documents.select(
        "doc_id", (F.octet_length(data) + F.lit(16)).cast("long").alias("size"), crc.alias("text_crc32"),
        F.pmod(hashed, F.lit(n_slots)).cast("int").alias("virtual_slot"),
        F.pmod(F.shiftrightunsigned(hashed, 40), F.lit(CELLS)).cast("int").alias("cell"))


def slot_bytes(recs: DataFrame) -> DataFrame:
    """(virtual_slot, bytes, rows): at most as many rows as there are slots."""
    return recs.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def first_map(stats: list, n_shards: int) -> list[tuple]:
    """Version 1: heaviest slot first into the lightest shard; stats holds (slot, bytes, rows)."""
    loads = [(0, shard) for shard in range(n_shards)]
    out = []
    for slot, size, rows in sorted(stats, key=lambda s: (-s[1], s[0])):
        load, shard = heapq.heappop(loads)
        heapq.heappush(loads, (load + size, shard))
        out.append((1, slot, shard, size, rows))
    return sorted(out, key=lambda m: m[1])


def edit_map(shard_map: list[tuple], moves: dict[int, int]) -> list[tuple]:
    """The next version: the slots in ``moves`` go to the shard given there, all others stay."""
    return [(v + 1, slot, moves.get(slot, shard), size, rows) for v, slot, shard, size, rows in shard_map]


def balancing_moves(shard_map: list[tuple], n_shards: int) -> dict[int, int]:
    """Slots to move so that ``n_shards`` shards are near equal: each shard above the mean sheds slots.

    With more shards than before, the new ones fill from what the others shed,
    so nothing moves between old shards unless they were uneven.
    """
    load = [0] * n_shards
    for _, _, shard, size, _ in shard_map:
        load[shard] += size
    mean = sum(load) / n_shards
    moves: dict[int, int] = {}
    light = [(b, s) for s, b in enumerate(load)]
    heapq.heapify(light)
    for _, slot, shard, size, _ in sorted(shard_map, key=lambda m: (-m[3], m[1])):
        if load[shard] - size < mean or not size:
            continue
        while light[0][0] != load[light[0][1]]:
            heapq.heapreplace(light, (load[light[0][1]], light[0][1]))
        to = light[0][1]
        if load[to] + size <= mean + size / 2:
            load[shard] -= size
            load[to] += size
            heapq.heapreplace(light, (load[to], to))
            moves[slot] = to
    return moves


def place(recs: DataFrame, shard_map: DataFrame) -> DataFrame:
    """Records with shard and slot; the map has at most one row per virtual slot."""
    where = F.broadcast(shard_map.select("virtual_slot", "shard"))
    sizes = recs.groupBy("virtual_slot", "cell").agg(F.count("*").alias("n")).join(where, "virtual_slot")
    before = W.partitionBy("shard").orderBy("virtual_slot", "cell").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("virtual_slot", "cell", "shard",
                          F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    rank = W.partitionBy("virtual_slot", "cell").orderBy("doc_id", "text_crc32", "size")
    return (recs.withColumn("rank", F.row_number().over(rank) - 1)
            .join(F.broadcast(starts), ["virtual_slot", "cell"])   # bounded: N_SLOTS * CELLS rows
            .withColumn("slot", (F.col("first") + F.col("rank")).cast("long")).drop("first", "rank", "cell"))


def shard(documents: DataFrame, n_shards: int = 40, n_slots: int = N_SLOTS) -> tuple[DataFrame, DataFrame]:
    """(placed records, the stored map of version 1)."""
    spark = documents.sparkSession
    recs = stored(records(documents, n_slots), "shard-records")
    stats = [tuple(r) for r in slot_bytes(recs).collect()]   # at most n_slots rows
    shard_map = stored(spark.createDataFrame(first_map(stats, n_shards), MAP_SCHEMA).coalesce(1), "shard-map")
    return place(recs, shard_map), shard_map
