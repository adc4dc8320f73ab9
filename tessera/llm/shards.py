"""Sharding by fixed virtual slots: records are hashed into thousands of slots, the bytes of each slot are added up,
and a stored, versioned map says which shard holds which slot. Rebalancing edits the map and stores the next version.

The law that holds is `bytes`: the bytes of the shards are near equal. Slots are dealt by size, largest first, to the
shard with the least bytes. Only the slot totals (at most `SLOTS` rows) come to the driver. A record's slot is a hash
of its doc_id, so neither hot sources nor copies of a text meet in one slot. A slot that holds over `HOT` times the mean
(rows without a doc_id, or one doc_id repeated) is dealt anew, its records by their number in the table, over all slots.

A null text has the size of its 16 bytes of framing and crc32 0; repeated rows get places of their own. Extra columns
are ignored; an empty table gives an empty result and a map of empty slots.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import folder, materialize

SLOTS = 8192
FRAME = 16
HOT = 8


@dataclass(frozen=True)
class SlotMap:
    """shard_of[v] is the shard of virtual slot v; version counts the edits."""

    version: int
    shards: int
    shard_of: tuple[int, ...]

    def write(self, spark: SparkSession, path: str) -> None:
        """Store this version beside the earlier ones."""
        rows = [(v, s) for v, s in enumerate(self.shard_of)]
        df = spark.createDataFrame(rows, "vslot int, shard int").withColumn("shards", F.lit(self.shards))
        df.coalesce(1).write.mode("overwrite").parquet(f"{path}/version={self.version}")

    @staticmethod
    def read(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """A stored version, by default the last."""
        df = spark.read.parquet(path)
        if version is None:
            version = df.agg(F.max("version")).first()[0]
        rows = df.where(F.col("version") == version).orderBy("vslot").collect()  # SLOTS rows
        return SlotMap(version, rows[0]["shards"], tuple(r["shard"] for r in rows))


def build_map(sizes: dict[int, int], shards: int, slots: int = SLOTS) -> SlotMap:
    """Deal the slots by size, largest first, each to the shard with the least bytes."""
    heap = [(0, s) for s in range(shards)]
    out = [0] * slots
    for v in sorted(range(slots), key=lambda v: (-sizes.get(v, 0), v)):
        held, s = heapq.heappop(heap)
        out[v] = s
        heapq.heappush(heap, (held + sizes.get(v, 0), s))
    return SlotMap(1, shards, tuple(out))


def rebalance(old: SlotMap, sizes: dict[int, int], shards: int | None = None, slack: float = 0.01) -> SlotMap:
    """Edit the map with few moves: slots leave shards that hold over (1 + slack) of the mean, and shards that are no
    more, for the shard with the least bytes."""
    shards = shards or old.shards
    out, held = list(old.shard_of), [0] * shards
    for v, s in enumerate(out):
        if s < shards:
            held[s] += sizes.get(v, 0)
    most = sum(sizes.values()) / shards * (1 + slack)
    moving = [v for v, s in enumerate(out) if s >= shards]
    for v in sorted(range(len(out)), key=lambda v: (sizes.get(v, 0), v)):
        s = out[v]
        if s < shards and sizes.get(v, 0) and held[s] > most:
            held[s] -= sizes[v]
            moving.append(v)
    heap = [(b, s) for s, b in enumerate(held)]
    heapq.heapify(heap)
    for v in sorted(moving, key=lambda v: (-sizes.get(v, 0), v)):
        b, s = heapq.heappop(heap)
        out[v] = s
        heapq.heappush(heap, (b + sizes.get(v, 0), s))
    return SlotMap(old.version + 1, shards, tuple(out))


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, number and virtual slot of each record; hot slots dealt anew."""
    own = materialize(docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + FRAME).cast("bigint").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("bigint").alias("text_crc32"),
        F.monotonically_increasing_id().alias("number"),
        F.pmod(F.xxhash64("doc_id"), F.lit(slots)).cast("int").alias("vslot"),
    ), "records")
    totals = slot_sizes(own)
    rows, size = sum(n for _, n in totals.values()), sum(b for b, _ in totals.values())
    hot = [v for v, (b, n) in totals.items() if n > HOT and (n * slots > HOT * rows or b * slots > HOT * size)]  # at most slots / HOT * 2
    if not hot:
        return own
    again = F.pmod(F.xxhash64("vslot", "number"), F.lit(slots)).cast("int")
    return own.withColumn("vslot", F.when(F.array_contains(F.lit(hot), F.col("vslot")), again).otherwise(F.col("vslot")))


def slot_sizes(recs: DataFrame) -> dict[int, tuple[int, int]]:
    """(bytes, rows) of each virtual slot that has any: at most as many rows as slots."""
    rows = recs.groupBy("vslot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    return {r["vslot"]: (r["b"], r["n"]) for r in rows}


def stored_map(spark: SparkSession, path: str, sizes: dict[int, int], shards: int) -> SlotMap:
    """The last version of the map at path; stored first where there is none, edited where its shards are others."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        build_map(sizes, shards).write(spark, path)
    last = SlotMap.read(spark, path)
    if last.shards != shards:
        rebalance(last, sizes, shards).write(spark, path)
        last = SlotMap.read(spark, path)
    return last


def assign(docs: DataFrame, shards: int = 40, path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (place in the shard, gapless from 0), grown_shard (null), vslot and
    map_version, by the map stored at path (default: a new one in the shared folder)."""
    spark = docs.sparkSession
    recs = records(docs)
    totals = slot_sizes(recs)
    slot_map = stored_map(spark, path or folder(spark, "slot-map"), {v: b for v, (b, _) in totals.items()}, shards)
    used, first = [0] * slot_map.shards, []
    for v, s in enumerate(slot_map.shard_of):
        first.append((v, s, used[s]))
        used[s] += totals.get(v, (0, 0))[1]
    places = F.broadcast(spark.createDataFrame(first, "vslot int, shard int, first bigint"))  # SLOTS rows
    within = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "size", "text_crc32", "number")) - 1
    out = recs.withColumn("within", within).join(places, "vslot")
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("first") + F.col("within")).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot", F.lit(slot_map.version).alias("map_version"),
    )
