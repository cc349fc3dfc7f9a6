"""Sharding by fixed virtual slots, with DataFrame operations only.

Records hash into a fixed number of slots (thousands, whatever the input's
size). Bytes are summed per slot, and a versioned map says which shard holds
each slot. Rebalancing edits the map: a new version lists only the slots that
move, and the latest version of each slot holds. Nothing else has to be
rehashed, and the map stays at `slots` rows.

Law of `assign`: `bytes`. After rebalancing, shards' bytes differ by about the
size of a small slot (or of the largest record, where one record outweighs a
shard's share).

Defined results: null text has size 1 and checksum 0, like empty text apart
from nothing; null doc_id is a key like any other; repeated rows are counted
once with their number and given out again at the end, COPIES at a time over
all tasks, so a third of all rows may be the same row; an empty table gives no rows; other columns are ignored
by `assign` and kept by `with_shard`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.session import scratch_path

SLOTS = 8192
#: Copies of a row that are given out at a time.
COPIES = 1000


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def crc_of(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def slot_of(slots: int, *key: Column) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(slots)).cast("int")


def slot_bytes(rows: DataFrame) -> DataFrame:
    """(slot, bytes, rows): at most one row per slot. rows: slot, size, n."""
    return rows.groupBy("slot").agg(F.sum(F.col("size") * F.col("n")).alias("bytes"), F.sum("n").alias("rows"))


def first_map(sums: DataFrame, shards: int) -> DataFrame:
    """Version 1: slots dealt out in turn, whatever they hold."""
    return sums.select(F.lit(1).alias("version"), "slot", F.pmod("slot", F.lit(shards)).cast("int").alias("shard"))


def current(slot_map: DataFrame) -> DataFrame:
    """The latest version of each slot."""
    return slot_map.groupBy("slot").agg(F.max_by("shard", "version").alias("shard"))


def rebalance(slot_map: DataFrame, sums: DataFrame, shards: int) -> DataFrame:
    """The next version of the map: the slots that must move for bytes to be near equal.

    Each shard keeps its largest slots up to its share; the surplus, largest
    first, goes to whichever shard has least. Surplus slots that stay where
    they were are no edit. Works on at most `slots` rows, folded in one row.
    """
    share = sums.agg(F.sum("bytes") / shards).scalar()
    held = current(slot_map).join(sums, "slot").withColumn("share", share)
    run = F.sum("bytes").over(Window.partitionBy("shard").orderBy(F.desc("bytes"), "slot"))
    held = held.withColumn("stays", (F.col("shard") < shards) & (run <= F.col("share")))
    kept = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda i: F.aggregate(
            F.filter("mine", lambda m: m["shard"] == i), F.lit(0).cast("long"), lambda a, m: a + m["bytes"]
        ),
    )
    folded = held.agg(
        F.collect_list(F.when(F.col("stays"), F.struct("shard", "bytes"))).alias("mine"),
        F.array_sort(
            F.collect_list(F.when(~F.col("stays"), F.struct((-F.col("bytes")).alias("less"), "slot", "shard")))
        ).alias("pool"),
    ).select("pool", kept.alias("loads"))
    start = F.struct(
        F.col("loads").alias("loads"), F.expr("cast(array() as array<struct<slot:int,shard:int,was:int>>)").alias("moves")
    )

    def put(acc, x):
        to = (F.array_position(acc["loads"], F.array_min(acc["loads"])) - 1).cast("int")
        return F.struct(
            F.transform(acc["loads"], lambda v, i: F.when(i == to, v - x["less"]).otherwise(v)).alias("loads"),
            F.concat(
                acc["moves"], F.array(F.struct(x["slot"].alias("slot"), to.alias("shard"), x["shard"].alias("was")))
            ).alias("moves"),
        )

    edits = folded.select(F.explode(F.aggregate("pool", start, put)["moves"]).alias("m"))
    edits = edits.filter("m.shard <> m.was").select("m.slot", "m.shard")
    return edits.select(slot_map.agg(F.max("version") + 1).scalar().alias("version"), "slot", "shard")


def store_map(slot_map: DataFrame, path: str) -> DataFrame:
    """Append versions to the stored map at path and return all that is stored there."""
    slot_map.coalesce(1).write.mode("append").parquet(path)
    return slot_map.sparkSession.read.schema("version int, slot int, shard int").parquet(path)


def with_shard(df: DataFrame, slot_map: DataFrame, key: Column, slots: int = SLOTS) -> DataFrame:
    """df with `virtual_slot` and `shard`; a map of at most `slots` rows is broadcast."""
    at = current(slot_map).select(F.col("slot").alias("virtual_slot"), "shard")
    return df.withColumn("virtual_slot", slot_of(slots, key)).join(F.broadcast(at), "virtual_slot", "left")


def assign(docs: DataFrame, shards: int = 8, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (place in the shard), grown_shard, virtual_slot.

    Places are gapless from 0 in each shard: rows are numbered inside their
    virtual slot, and slots of a shard follow one another, so no task ever
    holds a whole shard.
    """
    keyed = docs.select("doc_id", size_of(F.col("text")).alias("size"), crc_of(F.col("text")).alias("text_crc32"))
    rows = (
        keyed.groupBy("doc_id", "size", "text_crc32")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("slot", slot_of(slots, F.col("doc_id"), F.col("text_crc32")))
    )
    path = map_path or scratch_path(docs.sparkSession, "slot-map")
    sums = docs.sparkSession.read.schema("slot int, bytes long, rows long").parquet(_stored(slot_bytes(rows), path + "-sums"))
    slot_map = store_map(first_map(sums, shards), path)
    slot_map = store_map(rebalance(slot_map, sums, shards), path)
    of_slot = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    places = (
        current(slot_map)
        .join(sums, "slot")
        .withColumnRenamed("slot", "virtual_slot")
        .withColumn("first", F.coalesce(F.sum("rows").over(of_slot), F.lit(0)))
        .select("virtual_slot", "shard", "first")
    )
    before = Window.partitionBy("slot").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumnRenamed("slot", "virtual_slot")
        .join(F.broadcast(places), "virtual_slot")
        .withColumn("some", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))))
        .repartition("doc_id", "text_crc32", "some")
        .withColumn("copy", F.explode(F.sequence(F.col("some") * COPIES, F.least((F.col("some") + 1) * COPIES, F.col("n")) - 1)))
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("first") + F.col("before") + F.col("copy")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "virtual_slot",
        )
    )


def _stored(df: DataFrame, path: str) -> str:
    df.write.parquet(path)
    return path
