"""Sharding over fixed virtual slots, in DataFrame functions only.

Every record hashes to one of a fixed number of virtual slots (thousands, whatever the shard
count). A small table, the slot map, says which shard holds each slot. It is written as
versions: growing or rebalancing edits the map of the version before, so only the slots that
the edit names move. Bytes per slot are summed to drive the rebalancing.

Nulls: a null text has size 8 (none of its own) and an empty-text checksum; a null id hashes
by its text. Repeated ids fall in the same slot; equal rows get neighbouring places. An empty
table gives no rows. Other columns of the input, whatever their names, are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.llm.common import materialise, table, text_or_empty

#: Virtual slots; the slot map has as many rows, so it may be broadcast.
SLOTS = 4096
#: Parts of a virtual slot that are ranked by themselves, so that no task ranks a whole shard.
PARTS = 8
MAP_SCHEMA = "version int, vslot int, shard int"


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def base_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1: slots dealt out in turn; ``slots`` rows."""
    return spark.range(slots).select(F.lit(1).alias("version"), F.col("id").cast("int").alias("vslot"),
                                     F.pmod("id", F.lit(shards)).cast("int").alias("shard"))


def grow_map(slot_map: DataFrame, slots: int = SLOTS) -> DataFrame:
    """The next version with one more shard: each shard hands over the slots above its new share, no others move."""
    whole = Window.partitionBy(F.lit(0))  # over the slot map, of fixed size
    rank = F.row_number().over(Window.partitionBy("shard").orderBy("vslot"))
    ranked = slot_map.withColumn("rank", rank).withColumn("n", F.max("shard").over(whole) + 1)
    share = F.floor(F.lit(slots) / (F.col("n") + 1)) + (F.col("shard") < F.pmod(F.lit(slots), F.col("n") + 1)).cast("int")
    return ranked.select((F.col("version") + 1).alias("version"), "vslot",
                         F.when(F.col("rank") <= share, F.col("shard")).otherwise(F.col("n")).cast("int").alias("shard"))


def rebalance_map(slot_map: DataFrame, slot_bytes: DataFrame) -> DataFrame:
    """The next version by bytes: shards above the mean hand slots over, shards below it take them.

    In each shard slots stay, largest first, while they fit the mean. The slots handed over are
    laid end to end, as are the gaps of the shards; a slot goes to the gap where its middle falls.
    """
    sized = slot_map.join(F.broadcast(slot_bytes), "vslot", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)).cast("double"))
    whole = Window.partitionBy(F.lit(0))  # over the slot map, of fixed size
    n = F.max("shard").over(whole) + 1
    kept = F.sum("bytes").over(Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot").rowsBetween(Window.unboundedPreceding, 0))
    sized = sized.withColumn("mean", F.sum("bytes").over(whole) / n).withColumn("stays", kept <= F.col("mean"))
    laid = Window.orderBy("shard", "vslot").rowsBetween(Window.unboundedPreceding, 0)
    moved = sized.filter(~F.col("stays")).withColumn("middle", F.sum("bytes").over(laid) - F.col("bytes") / 2)
    gaps = sized.groupBy("shard").agg((F.max("mean") - F.sum(F.when(F.col("stays"), F.col("bytes")).otherwise(0.0))).alias("gap"))
    ends = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    gaps = gaps.select(F.col("shard").alias("to"), F.sum("gap").over(ends).alias("end"))
    gaps = gaps.withColumn("start", F.lag("end", 1, -1.0).over(Window.orderBy("to"))).withColumn("last", F.max("to").over(Window.partitionBy(F.lit(0))))
    hit = (F.col("middle") > F.col("start")) & ((F.col("middle") <= F.col("end")) | (F.col("to") == F.col("last")))
    goes = moved.join(F.broadcast(gaps), hit).groupBy("vslot").agg(F.min("to").alias("to"))
    return sized.join(F.broadcast(goes), "vslot", "left").select(
        (F.col("version") + 1).alias("version"), "vslot", F.coalesce("to", "shard").cast("int").alias("shard"))


def with_slots(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """``(doc_id, size, text_crc32, vslot)`` of every row; texts are read once and go no further."""
    text = text_or_empty(text_col)
    return rows.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"),
                       F.when(F.col(id_col).isNull(), slot_of(text, slots)).otherwise(slot_of(F.col(id_col), slots)).alias("vslot"))


def bytes_per_slot(slotted: DataFrame) -> DataFrame:
    """``(vslot, rows, bytes)``: at most one row per virtual slot."""
    return slotted.groupBy("vslot").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))


def assign(slotted: DataFrame, slot_map: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Adds ``shard``, ``map_version``, ``slot_bytes`` and ``slot``, the gapless place of a row in its shard.

    Places: rows of one virtual slot are ranked in ``PARTS`` parts; the counts of the parts,
    at most ``PARTS`` a virtual slot, give where each part starts in its shard.
    """
    part = F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(PARTS)).cast("int")
    split = slotted.withColumn("part", part)
    counts = split.groupBy("vslot", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"))
    before = Window.partitionBy("shard").orderBy("vslot", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.join(F.broadcast(slot_map), "vslot").select(
        "vslot", "part", "shard", F.col("version").alias("map_version"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"),
        F.sum("b").over(Window.partitionBy("vslot")).alias("slot_bytes"))
    rank = F.row_number().over(Window.partitionBy("vslot", "part").orderBy("doc_id", "text_crc32", "size"))
    return (split.withColumn("rank", rank - 1).join(F.broadcast(starts), ["vslot", "part"])  # at most slots x PARTS rows
            .withColumn("slot", F.col("first") + F.col("rank")).drop("first", "rank", "part"))


def op3_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards by law ``key``; the map's versions are a table in the shared folder."""
    first = base_map(spark, 24)
    versions = materialise(first.unionByName(grow_map(first)), "slot-map")
    now = versions.filter("version = 1")
    grown = versions.filter("version = 2").select("vslot", F.col("shard").alias("grown_shard"))
    rows = assign(with_slots(table(spark, sf_dir, "documents")), now)
    return rows.join(F.broadcast(grown), "vslot").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard",
        F.col("vslot").alias("virtual_slot"), "slot_bytes", "map_version")
