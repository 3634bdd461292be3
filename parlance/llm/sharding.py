"""Shards by fixed virtual slots.

Records are hashed into a fixed number of virtual slots (thousands).  Bytes are
summed for each slot, and a slot-to-shard map deals whole slots to shards,
heaviest first, each to the lightest shard so far.  The map is a small table
with versions: rebalancing edits the map and so moves whole slots, never single
records.  Everything here is DataFrame operations; only slots (a fixed number,
never rows) are gathered into one row.

Equal texts are no unit of placement: a record's slot comes from its ``doc_id`` and its
text's checksum, so copies spread over the shards.  A group of copies may hold a third of all
bytes; kept together it would fill a third of one shard's worth many times over, and
the law ``bytes`` (sizes near equal) could not hold.

Defined cases: a null text weighs 16 bytes; a null ``doc_id`` is hashed like any
value; repeated rows are placed one by one; an empty table gives no rows and a
map whose slots are all empty; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import scratch_dir, stored

#: Virtual slots; fixed for the life of a sharded corpus.
SLOTS = 8192
#: Bytes that a record costs besides its text.
RECORD_BYTES = 16


def virtual_slot(*keys: Column, slots: int = SLOTS) -> Column:
    """The slot that a record's key hashes to."""
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


def slot_bytes(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``vslot, bytes, records`` for each slot, empty ones included."""
    spark = records.sparkSession
    sums = records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("records"))
    every = spark.range(0, slots, 1, 1).select(F.col("id").cast("int").alias("vslot"))
    return every.join(sums, "vslot", "left").select(
        "vslot", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("records", F.lit(0)).alias("records")
    )


def _deal(ordered: Column, loads: Column) -> Column:
    """Fold over slots, heaviest first: each goes to the lightest shard so far."""

    def step(acc: Column, slot: Column) -> Column:
        lightest = F.array_position(acc["loads"], F.array_min(acc["loads"])).cast("int")
        return F.struct(
            F.transform(
                acc["loads"], lambda x, i: F.when(i + 1 == lightest, x + slot["bytes"]).otherwise(x)
            ).alias("loads"),
            F.concat(acc["shards"], F.array(lightest - 1)).alias("shards"),
        )

    start = F.struct(loads.alias("loads"), F.array().cast("array<int>").alias("shards"))
    return F.aggregate(ordered, start, step, lambda acc: acc["shards"])


def first_map(weights: DataFrame, shards: int) -> DataFrame:
    """Version 1: ``version, vslot, bytes, shard`` from the slots' bytes."""
    one = weights.groupBy().agg(
        F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "vslot", "bytes"))).alias("s")
    )
    dealt = one.withColumn("shards", _deal(F.col("s"), F.array_repeat(F.lit(0).cast("long"), shards)))
    return dealt.select(F.posexplode("s").alias("i", "slot"), "shards").select(
        F.lit(1).alias("version"),
        F.col("slot.vslot").alias("vslot"),
        F.col("slot.bytes").alias("bytes"),
        F.get("shards", F.col("i")).alias("shard"),
    )


def rebalanced_map(current: DataFrame, weights: DataFrame, shards: int) -> DataFrame:
    """The next version for ``shards`` shards and new weights.

    A slot stays on its shard while the bytes of the slots before it there (in
    the order of a hash) stay below the fair share; the others are dealt out
    again, heaviest first, over the loads of those that stay.  Growing by one
    shard therefore moves about a share of one in ``shards`` of the bytes.
    """
    fresh = current.select("version", "vslot", "shard").join(weights.select("vslot", "bytes"), "vslot")
    total = fresh.groupBy().agg((F.sum("bytes") / shards).alias("fair"), (F.max("version") + 1).alias("next"))
    before = W.partitionBy("shard").orderBy(F.xxhash64("vslot"), "vslot").rowsBetween(W.unboundedPreceding, 0)
    marked = fresh.withColumn("upto", F.sum("bytes").over(before)).join(F.broadcast(total))
    marked = marked.withColumn("stays", (F.col("shard") < shards) & (F.col("upto") <= F.col("fair")))
    kept = marked.filter("stays")
    loads = kept.groupBy().agg(
        *[F.coalesce(F.sum(F.when(F.col("shard") == k, F.col("bytes"))), F.lit(0)).alias(f"l{k}") for k in range(shards)]
    ).select(F.array(*[f"l{k}" for k in range(shards)]).alias("loads"))
    moved = marked.filter(~F.col("stays")).groupBy().agg(
        F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "vslot", "bytes"))).alias("s"),
        F.first("next").alias("next"),
    )
    dealt = moved.join(F.broadcast(loads)).withColumn("shards", _deal(F.col("s"), F.col("loads")))
    moved = dealt.select(F.posexplode("s").alias("i", "slot"), "shards", "next").select(
        F.col("next").alias("version"), F.col("slot.vslot").alias("vslot"), F.col("slot.bytes").alias("bytes"),
        F.get("shards", F.col("i")).alias("shard"),
    )
    return kept.select(F.col("next").alias("version"), "vslot", "bytes", "shard").unionByName(moved)


def store_map(slot_map: DataFrame, path: str) -> None:
    """Adds a version to the map's table; older versions stay readable."""
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of a stored map, the newest if none is named."""
    table = spark.read.parquet(path)
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    return table.filter(F.col("version") == version)


def place(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Adds ``shard, slot``: the shard and the place in it, gapless from 0.

    A shard's places run through its virtual slots one after another, so rows
    are numbered within a virtual slot (thousands of small groups) and shifted
    by the records of the slots before it.
    """
    counts = records.groupBy("vslot").agg(F.count(F.lit(1)).alias("records"))
    starts = slot_map.select("vslot", "shard").join(counts, "vslot").select(
        "vslot", "shard",
        (F.sum("records").over(W.partitionBy("shard").orderBy("vslot")) - F.col("records")).alias("start"),
    )
    in_slot = W.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    # The map has SLOTS rows at most, whatever the input: broadcasting it is bounded.
    return records.withColumn("at", F.row_number().over(in_slot) - 1).join(F.broadcast(starts), "vslot").select(
        *records.columns, "shard", (F.col("start") + F.col("at")).alias("slot")
    )


def shard_documents(docs: DataFrame, shards: int = 40, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Rows of ``docs`` with shard and place; the map is stored at ``map_path``."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    records = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + RECORD_BYTES).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
        ).withColumn("vslot", virtual_slot(F.col("doc_id"), F.col("text_crc32"), slots=slots)),
        "shard-records",
    )
    path = map_path or scratch_dir(spark, "slot-map")
    store_map(first_map(slot_bytes(records, slots), shards), path)
    return place(records, load_map(spark, path))


def op4_virtual_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39, law ``bytes``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard_documents(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"),
    )
