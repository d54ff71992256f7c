"""Sharding by fixed virtual slots.

Each record hashes into one of `SLOTS` virtual slots for good; bytes and rows are added up per slot, and a versioned
table maps slots to shards. Maps change, the hash never does: version 0 deals slots out evenly, `rebalanced` edits a map
by moving few slots, `balanced` deals them anew by their bytes where edits do not come near enough to equal (`evened`),
`grown` gives a new shard slots from the others only. What reaches the driver is one row per slot.

Defined cases: a null text counts no bytes, a null doc_id hashes by the text, repeated doc_ids share a slot and keep
their own rows. Ties go to the smaller slot or shard. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import bisect
import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barweave.llm.common import stored, table

SLOTS = 4096
SHARDS = 24
MAP_SCHEMA = "version int, slot int, shard int, bytes long, rows long, first_place long"


def slot_of(doc_id: Column, text: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(F.when(doc_id.isNull(), text), doc_id), F.lit(slots)).cast("int")


def slot_sizes(records: DataFrame) -> dict[int, tuple[int, int]]:
    """slot -> (bytes, rows), one entry per slot at most."""
    rows = records.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    return {r.virtual_slot: (r.b, r.n) for r in rows}


def uniform(slots: int = SLOTS, shards: int = SHARDS) -> dict[int, int]:
    return {slot: slot % shards for slot in range(slots)}


def balanced(slot_map: dict[int, int], bytes_of: dict[int, int], shards: int = SHARDS) -> dict[int, int]:
    """A map that deals the slots anew, the largest first and each to the lightest shard.

    Slots without records keep their shard. The largest difference between two shards is at most the size of the
    slot dealt last to the larger one.
    """
    out = dict(slot_map)
    load = [(0, shard) for shard in range(shards)]
    for slot in sorted((s for s in slot_map if bytes_of.get(s)), key=lambda s: (-bytes_of[s], s)):
        size, shard = heapq.heappop(load)
        out[slot] = shard
        heapq.heappush(load, (size + bytes_of[slot], shard))
    return out


def rebalanced(slot_map: dict[int, int], bytes_of: dict[int, int], spread: float = 0.01) -> dict[int, int]:
    """An edited map: the heaviest shard gives slots to the lightest until they differ by at most `spread` of the mean.

    Each move takes the largest slot that is no more than half of the difference, so few slots move; it ends early where
    the heaviest shard has no slot as small as that.
    """
    out = dict(slot_map)
    load = dict.fromkeys(slot_map.values(), 0)
    members: dict[int, list[tuple[int, int]]] = {shard: [] for shard in load}
    for slot, shard in slot_map.items():
        load[shard] += bytes_of.get(slot, 0)
        if bytes_of.get(slot):
            bisect.insort(members[shard], (bytes_of[slot], slot))
    most = spread * sum(load.values()) / max(len(load), 1)
    while load:
        light, heavy = min(load, key=lambda s: (load[s], s)), max(load, key=lambda s: (load[s], s))
        gap = load[heavy] - load[light]
        at = bisect.bisect_right(members[heavy], (gap // 2, max(slot_map)))
        if gap <= most or not at:
            break
        size, slot = members[heavy].pop(at - 1)
        bisect.insort(members[light], (size, slot))
        out[slot] = light
        load[heavy] -= size
        load[light] += size
    return out


def spread_of(slot_map: dict[int, int], bytes_of: dict[int, int]) -> int:
    """The bytes between the heaviest and the lightest shard of the map."""
    load = dict.fromkeys(slot_map.values(), 0)
    for slot, shard in slot_map.items():
        load[shard] += bytes_of.get(slot, 0)
    return max(load.values(), default=0) - min(load.values(), default=0)


def evened(slot_map: dict[int, int], bytes_of: dict[int, int], shards: int = SHARDS, spread: float = 0.01) -> dict[int, int]:
    """The edited map, or one dealt anew where edits end above `spread` of the mean and dealing comes nearer to equal."""
    edited = rebalanced(slot_map, bytes_of, spread)
    if spread_of(edited, bytes_of) <= spread * sum(bytes_of.values()) / shards:
        return edited
    anew = balanced(slot_map, bytes_of, shards)
    return anew if spread_of(anew, bytes_of) < spread_of(edited, bytes_of) else edited


def grown(slot_map: dict[int, int], bytes_of: dict[int, int], new_shard: int) -> dict[int, int]:
    """A map with one more shard that takes slots only into itself, until it holds its even share of the bytes."""
    out = dict(slot_map)
    load: dict[int, int] = {}
    members: dict[int, list[int]] = {}
    for slot, shard in sorted(slot_map.items()):
        load[shard] = load.get(shard, 0) + bytes_of.get(slot, 0)
        members.setdefault(shard, []).append(slot)
    share, got = sum(load.values()) / (len(load) + 1), 0
    heaviest = [(-size, shard) for shard, size in load.items()]
    heapq.heapify(heaviest)
    while heaviest and got < share:
        size, shard = heapq.heappop(heaviest)
        slot = next((s for s in members[shard] if 0 < bytes_of.get(s, 0) <= share - got), None)
        if slot is None:
            continue
        members[shard].remove(slot)
        out[slot] = new_shard
        got += bytes_of[slot]
        heapq.heappush(heaviest, (size + bytes_of[slot], shard))
    return out


def map_table(spark: SparkSession, versions: list[dict[int, int]], sizes: dict[int, tuple[int, int]]) -> DataFrame:
    """The stored map: a row per version and slot, with the rows that come before the slot in its shard."""
    rows = []
    for version, slot_map in enumerate(versions):
        before: dict[int, int] = {}
        for slot in sorted(slot_map):
            b, n = sizes.get(slot, (0, 0))
            shard = slot_map[slot]
            rows.append((version, slot, shard, b, n, before.get(shard, 0)))
            before[shard] = before.get(shard, 0) + n
    return stored(spark.createDataFrame(rows, MAP_SCHEMA), "slot-map")


def place(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Shard and place of each record. The map has one row per slot, so Spark broadcasts it by its size.

    Places are counted inside a virtual slot and moved up by the rows of the earlier slots of its shard: no task ever
    orders a whole shard.
    """
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    placed = records.withColumn("place", F.row_number().over(inside))
    chosen = slot_map.select(F.col("slot").alias("virtual_slot"), "shard", "first_place")
    return placed.join(chosen, "virtual_slot").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("first_place") + F.col("place") - 1).alias("slot"), "virtual_slot"
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """(placed records, stored map with version 0 uniform and version 1 edited from it by bytes) of (doc_id, text)."""
    text = F.col("text").cast("binary")
    records = docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(b""))).alias("text_crc32"), slot_of(F.col("doc_id"), F.col("text"), slots).alias("virtual_slot"),
    )
    records = stored(records, "sizes")
    sizes = slot_sizes(records)
    start = uniform(slots, shards)
    slot_map = map_table(docs.sparkSession, [start, evened(start, {s: b for s, (b, _) in sizes.items()}, shards)], sizes)
    return place(records, slot_map.where("version = 1")), slot_map


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, _ = shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot"
    )
