"""Sharding by fixed virtual slots: records hash into thousands of slots, bytes are aggregated per slot, and a versioned map from slots to shards is edited when rebalancing. DataFrame operations only.

Nulls: a null key hashes as any other value; a null text has no bytes. An empty table gives an empty assignment. Repeated keys share a slot. Other columns of the input are not read. A very long text is one row.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage, table

#: Virtual slots. Fixed for the life of a data set: records never change slots, slots change shards.
VIRTUAL_SLOTS = 8192


def virtual_slot(key: Column, slots: int = VIRTUAL_SLOTS) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit("\x00null"))), F.lit(slots)).cast("int")


def slot_bytes(sized: DataFrame) -> DataFrame:
    """vslot, n_rows, n_bytes: at most VIRTUAL_SLOTS rows, whatever the input."""
    return sized.groupBy("vslot").agg(F.count("*").alias("n_rows"), F.sum("size").alias("n_bytes"))


def first_map(weights: dict[int, tuple[int, int]], shards: int) -> dict[int, int]:
    """Version 1: slots by falling bytes, each to the shard with the fewest bytes so far."""
    heap = [(0, 0, s) for s in range(shards)]
    out = {}
    for slot, (n_rows, n_bytes) in sorted(weights.items(), key=lambda x: (-x[1][1], x[0])):
        b, r, s = heapq.heappop(heap)
        out[slot] = s
        heapq.heappush(heap, (b + n_bytes, r + n_rows, s))
    return out


def rebalanced(slot_map: dict[int, int], weights: dict[int, tuple[int, int]], shards: int) -> dict[int, int]:
    """The next version of a map: only as many slots move as new shards need to reach the mean, each from the fullest shard."""
    out, load = dict(slot_map), {s: 0 for s in range(shards)}
    held: dict[int, list[tuple[int, int]]] = {s: [] for s in range(shards)}
    for slot, s in slot_map.items():
        load[s] += weights.get(slot, (0, 0))[1]
        held[s].append((weights.get(slot, (0, 0))[1], slot))
    mean = sum(load.values()) / max(1, shards)
    for rows in held.values():
        rows.sort()
    for new in sorted(load, key=load.get):
        while load[new] < mean:
            full = max(load, key=lambda s: (load[s], -s))
            fits = [x for x in held[full] if load[new] + x[0] <= mean and x[0]]
            if full == new or load[full] <= mean or not fits:
                break
            b, slot = fits[-1]
            held[full].remove((b, slot))
            held[new].append((b, slot))
            load[full] -= b
            load[new] += b
            out[slot] = new
    return out


def map_table(spark: SparkSession, versions: list[dict[int, int]]) -> DataFrame:
    """version, vslot, shard: the stored map, one set of rows per version (VIRTUAL_SLOTS rows each at most)."""
    rows = [(v, int(k), int(s)) for v, m in enumerate(versions, 1) for k, s in m.items()]
    return spark.createDataFrame(rows, "version int, vslot int, shard int")


def newest(stored: DataFrame) -> tuple[int, dict[int, int]]:
    """(version, map) of the newest version of a stored map: VIRTUAL_SLOTS rows at most."""
    rows = stored.collect()
    version = max((r.version for r in rows), default=0)
    return version, {r.vslot: r.shard for r in rows if r.version == version}


def rebalance(stored: DataFrame, weights: dict[int, tuple[int, int]], shards: int) -> DataFrame:
    """The stored map with its next version, edited for so many shards and written again."""
    version, slots = newest(stored)
    edited = map_table(stored.sparkSession, [rebalanced(slots, weights, shards)]).withColumn("version", F.lit(version + 1))
    return stage(stored.unionByName(edited), "slot-map")


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", slots: int = VIRTUAL_SLOTS) -> DataFrame:
    """Adds size (UTF-8 bytes plus 1), text_crc32 and vslot."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.withColumns({"size": (F.octet_length(raw) + 1).cast("long"), "text_crc32": F.crc32(raw), "vslot": virtual_slot(F.col(key), slots)})


def shard(docs: DataFrame, shards: int, slots: int = VIRTUAL_SLOTS, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(assignment, stored map). The map is written to the shared folder as version 1 and read back for the assignment. assignment: key, size, text_crc32, vslot, shard, slot (place of the record in its shard, gapless from 0). Law: shards have nearly equal bytes.

    Only `slots` rows reach the driver. Places are counted within virtual slots and shifted by the sizes of the shard's slots before, so no task holds a whole shard.
    """
    spark = docs.sparkSession
    rows = stage(sized(docs, key, slots=slots).select(key, "size", "text_crc32", "vslot"), "sharding")
    weights = {r.vslot: (r.n_rows, r.n_bytes) for r in slot_bytes(rows).collect()}
    stored = stage(map_table(spark, [first_map(weights, shards)]), "slot-map")
    _, slot_map = newest(stored)
    before, placed = {s: 0 for s in range(shards)}, []
    for slot in sorted(slot_map):
        s = slot_map[slot]
        placed.append((slot, s, before[s]))
        before[s] += weights[slot][0]
    places = spark.createDataFrame(placed, "vslot int, shard int, place long")
    within = F.row_number().over(Window.partitionBy("vslot").orderBy(F.col(key), "size", "text_crc32")) - 1
    out = rows.withColumn("within", within).join(F.broadcast(places), "vslot")  # at most `slots` rows
    return out.select(key, "size", "text_crc32", "vslot", "shard", (F.col("place") + F.col("within")).alias("slot")), stored


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = shard(table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")
