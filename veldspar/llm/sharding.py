"""Fixed virtual slots: records hash into thousands of slots, a versioned map gives each slot its shard.

Version 1 of the map deals the slots out evenly.  Bytes and rows of each slot are aggregated in one pass (a few
thousand rows, whatever the input); rebalancing edits the map on them, moving only the slots that must move, and
the next version is stored beside the one before.  A record's slot is a hash of its id and its text's CRC.  A
slot that outweighs ``HOT`` average ones, such as one that a repeated row fills, is split: its rows are dealt to
slots of its own by where they were read, so that copies of one row spread as well.

The law is ``bytes``: shard sizes near equal.  A slot is the unit of balance, so no shard exceeds the mean by
more than its slack and the heaviest slot.  Equal texts are not kept in one shard: one text may make up a third
of all rows, and then no shard that holds all of it can be near the others in size.

Defined results for odd input: a null or empty text has size 1 and CRC 0; a null doc_id hashes as such; repeated
rows each have a place of their own; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, stored

SLOTS = 4096
HOT, PART = 32, 4
MAP_SCHEMA = "version int, slot int, shard int"


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, and place and partition of reading; the text itself goes no further.

    Store the result: places are fixed only then.
    """
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "utf-8")).cast("long").alias("text_crc32"),
        F.monotonically_increasing_id().alias("at"),
        F.spark_partition_id().alias("read_by"),
    ).withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int"))


def slot_stats(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows by slot: at most as many rows reach the driver as there are slots."""
    return {r[0]: (r[1], r[2]) for r in rows.groupBy("virtual_slot").agg(F.sum("size"), F.count("*")).collect()}


def split(rows: DataFrame, stats: dict[int, tuple[int, int]], slots: int = SLOTS) -> tuple[DataFrame, int]:
    """(rows, number of slots): slots that outweigh ``HOT`` average ones get slots of their own, of some ``PART`` average ones each."""
    mean = sum(b for b, _ in stats.values()) / slots
    hot = sorted((k, int(min(n, b / (PART * mean)))) for k, (b, n) in stats.items() if n > 1 and b > HOT * mean)
    first, split_ = slots, []
    for k, parts in hot:
        split_.append((k, first, parts))
        first += parts
    if not split_:
        return rows, slots
    known = rows.sparkSession.createDataFrame(split_, "virtual_slot int, first int, parts int")  # at most slots / HOT rows
    own = F.col("first") + F.pmod(F.xxhash64("at"), F.col("parts")).cast("int")
    rows = rows.join(F.broadcast(known), "virtual_slot", "left").withColumn("virtual_slot", F.coalesce(own, "virtual_slot"))
    return rows.drop("first", "parts"), first


def balance(weights: dict[int, int], shards: int, slots: int = SLOTS) -> dict[int, int]:
    """A first map: heaviest slots first, each to the lightest shard; empty slots are spread evenly."""
    heap = [(0, 0, s) for s in range(shards)]
    out = {}
    for slot in sorted(range(slots), key=lambda k: (-weights.get(k, 0), k)):
        load, n, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + weights.get(slot, 0), n + 1, shard))
    return out


def rebalance(old: dict[int, int], weights: dict[int, int], shards: int, slack: float = 0.002) -> dict[int, int]:
    """Edit a map for new weights or another number of shards, moving slots only out of overloaded or closed shards."""
    out = dict(old)
    mean = sum(weights.values()) / shards
    load = {s: 0 for s in range(shards)}
    held: dict[int, list[int]] = {}
    for slot, shard in old.items():
        held.setdefault(shard, []).append(slot)
        if shard < shards:
            load[shard] += weights.get(slot, 0)
    loose = [k for shard, ks in held.items() if shard >= shards for k in ks]
    for shard in range(shards):
        for k in sorted(held.get(shard, ()), key=lambda k: (-weights.get(k, 0), k)):
            w = weights.get(k, 0)
            if load[shard] <= mean * (1 + slack) or load[shard] - w < mean * (1 - slack) or not w:
                continue
            loose.append(k)
            load[shard] -= w
    for k in sorted(loose, key=lambda k: (-weights.get(k, 0), k)):
        to = min(load, key=lambda s: (load[s], s))
        out[k] = to
        load[to] += weights.get(k, 0)
    return out


class SlotMaps:
    """Versions of a slot-to-shard map, one Parquet folder each, under a folder that the cluster shares."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def commit(self, version: int, shard_of: dict[int, int]) -> DataFrame:
        """Write a version; one that exists is never overwritten."""
        rows = [(version, k, s) for k, s in sorted(shard_of.items())]
        self.spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("error").parquet(f"{self.root}/version={version}")
        return self.read(version)

    def read(self, version: int) -> DataFrame:
        return self.spark.read.schema("slot int, shard int").parquet(f"{self.root}/version={version}")

    def load(self, version: int) -> dict[int, int]:
        return {r.slot: r.shard for r in self.read(version).collect()}


def place(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Rows with their shard and their place in it (``slot``, gapless from 0).

    Rows of one shard and one partition of reading are numbered together, from where the partitions before it
    end; so no task holds a whole shard or slot.
    """
    # As many map rows as there are slots: the bound that makes the broadcast safe.
    rows = rows.join(F.broadcast(slot_map.withColumnRenamed("slot", "virtual_slot")), "virtual_slot")
    many = rows.groupBy("shard", "read_by").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("read_by").rowsBetween(Window.unboundedPreceding, -1)
    begins = many.select("shard", "read_by", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    own = Window.partitionBy("shard", "read_by").orderBy("at")
    rows = rows.withColumn("nth", F.row_number().over(own))
    return rows.join(begins, ["shard", "read_by"]).withColumn("slot", F.col("begin") + F.col("nth") - 1)


def sharded(docs: DataFrame, shards: int, slots: int = SLOTS) -> tuple[DataFrame, SlotMaps]:
    """(doc_id, size, text_crc32, shard, slot, virtual_slot of every row; the map's versions 1 and 2)."""
    spark = docs.sparkSession
    rows = stored(records(docs, slots), "shard-records")
    stats = slot_stats(rows)
    rows, used = split(rows, stats, slots)
    weights = {k: b for k, (b, _) in (stats if used == slots else slot_stats(rows)).items()}
    maps = SlotMaps(spark, f"{shared_dir(spark)}/veldspar/slot-maps-{uuid.uuid4().hex}")
    even = balance({}, shards, used)
    maps.commit(1, even)
    slot_map = maps.commit(2, rebalance(even, weights, shards))
    return place(rows, slot_map).select("doc_id", "size", "text_crc32", "shard", "slot", "virtual_slot"), maps


def query(spark: SparkSession, sf_dir: str, shards: int = 8) -> DataFrame:
    out, _ = sharded(spark.read.parquet(f"{sf_dir}/documents.parquet"), shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
