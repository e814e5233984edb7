"""Sharding by fixed virtual slots.

Records are hashed into a fixed number of slots (thousands, whatever the number
of shards).  Bytes are summed per slot, and a small slot-to-shard map decides
where a slot lives.  Rebalancing edits the map and raises its version: records
are never hashed again.  The map has ``slots`` rows, so it is small by
construction; everything else is one scan and one partial aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkgrid.session import run_dir

SLOTS = 4096


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 16 for the record's header."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16


def slot_of(slots: int, *keys: Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


def slot_bytes(records: DataFrame, slots: int) -> DataFrame:
    """``slot, bytes, rows`` for every slot, empty ones included."""
    sums = records.groupBy("slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    every = records.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot"))
    return every.join(sums, "slot", "left").select("slot", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("rows", F.lit(0)).alias("rows"))


def first_map(spark: SparkSession, slots: int, shards: int) -> DataFrame:
    """Version 0: slots dealt in turn."""
    return spark.range(slots).select(F.lit(0).alias("version"), F.col("id").cast("int").alias("slot"), (F.col("id") % shards).cast("int").alias("shard"))


def _least_loaded(loads: Column) -> Column:
    return (F.array_position(loads, F.array_min(loads)) - 1).cast("int")


def _add(loads: Column, shard: Column, amount: Column) -> Column:
    return F.transform(loads, lambda v, i: F.when(i == shard, v + amount).otherwise(v))


def rebalanced(current: DataFrame, sums: DataFrame, shards: int) -> DataFrame:
    """The next version of the map: the edits that make the shards' bytes near equal.

    Slots are taken from the heaviest down.  A slot stays where it is while its
    shard is within an equal share; the others are lifted out and then put, again
    from the heaviest down, on the shard with the fewest bytes.  Ties go to the
    smaller slot and the smaller shard.  The fold runs over the map's fixed number
    of slots as one expression.
    """
    rows = current.join(sums, "slot").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "slot", "shard"))).alias("all"),
        F.sum("bytes").alias("total"), F.max("version").alias("version"),
    )
    share = F.ceil(F.col("total") / shards).cast("long")
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"), F.array().cast("array<struct<less:bigint,slot:int,shard:int>>").alias("stay"),
                     F.array().cast("array<struct<less:bigint,slot:int,shard:int>>").alias("loose"))

    def keep(state: Column, x: Column) -> Column:
        fits = (x["shard"] < shards) & (F.coalesce(F.get(state["loads"], x["shard"]), F.lit(0)) - x["less"] <= share)
        return F.struct(
            F.when(fits, _add(state["loads"], x["shard"], -x["less"])).otherwise(state["loads"]).alias("loads"),
            F.when(fits, F.concat(state["stay"], F.array(x))).otherwise(state["stay"]).alias("stay"),
            F.when(fits, state["loose"]).otherwise(F.concat(state["loose"], F.array(x))).alias("loose"),
        )

    def place(state: Column, x: Column) -> Column:
        to = _least_loaded(state["loads"])
        put = F.struct(x["less"].alias("less"), x["slot"].alias("slot"), to.alias("shard"))
        return F.struct(_add(state["loads"], to, -x["less"]).alias("loads"), F.concat(state["stay"], F.array(put)).alias("stay"), state["loose"].alias("loose"))

    first = rows.select("version", F.aggregate("all", start, keep).alias("s"))
    done = first.select("version", F.aggregate(F.col("s.loose"), F.col("s"), place).alias("s"))
    return done.select((F.col("version") + 1).alias("version"), F.explode("s.stay").alias("x")).select("version", "x.slot", "x.shard")


def with_shard(current: DataFrame, sums: DataFrame, shards: int) -> DataFrame:
    """The next version with one shard more (number ``shards``): slots move only into the new shard.

    Every shard hands over its slots in slot order once the slots before them
    hold the part of its bytes that it keeps, ``shards / (shards + 1)``.
    """
    mine = W.partitionBy("shard").orderBy("slot")
    rows = current.join(sums, "slot").withColumn("before", F.sum("bytes").over(mine) - F.col("bytes")).withColumn("all", F.sum("bytes").over(W.partitionBy("shard")))
    goes = F.col("before") * (shards + 1) >= F.col("all") * shards
    return rows.select((F.col("version") + 1).alias("version"), "slot", F.when(goes & (F.col("bytes") > 0), F.lit(shards)).otherwise(F.col("shard")).alias("shard"))


def save_map(version: DataFrame, folder: str) -> None:
    """Add one version to the stored maps; earlier versions stay readable."""
    version.coalesce(1).write.mode("append").partitionBy("version").parquet(folder)


def load_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """One stored version, the latest by default."""
    stored = spark.read.schema("slot int, shard int, version int").parquet(folder)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    return stored.where(F.col("version") == version).select("version", "slot", "shard")


def shard_records(docs: DataFrame, shards: int, slots: int = SLOTS, folder: str | None = None) -> DataFrame:
    """All columns of ``docs`` plus ``_size, _crc, _slot, _shard, _map_version``; sizes of the shards are near equal.

    The slot is hashed from ``doc_id`` and the text's checksum, so equal ids or
    null ids with different texts spread; rows equal in both share a slot.  The
    map's versions are stored in ``folder`` (by default below the shared folder).
    Null texts have size 16 and checksum 0.  A column of ``docs`` that has the name of
    an added one is replaced.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    records = docs.withColumns({"_size": size_of(F.col("text")), "_crc": crc}).withColumn("_slot", slot_of(slots, F.col("doc_id"), F.col("_crc")))
    folder = folder or run_dir(spark, "slot-map")
    sums = slot_bytes(records.select(F.col("_slot").alias("slot"), F.col("_size").alias("size")), slots)
    save_map(first_map(spark, slots, shards), folder)
    save_map(rebalanced(load_map(spark, folder), sums, shards), folder)
    placed = load_map(spark, folder).select(F.col("slot").alias("_slot"), F.col("shard").alias("_shard"), F.col("version").alias("_map_version"))
    return records.join(F.broadcast(placed), "_slot")  # `slots` rows, whatever the input


def number_rows(sharded: DataFrame) -> DataFrame:
    """Adds ``_place``: 0, 1, 2, ... within every shard.  Rows are numbered within their slot and the slots' counts are summed up."""
    counts = sharded.groupBy("_shard", "_slot").agg(F.count(F.lit(1)).alias("n"))
    ahead = counts.select("_slot", (F.sum("n").over(W.partitionBy("_shard").orderBy("_slot")) - F.col("n")).alias("_ahead"))
    inside = F.row_number().over(W.partitionBy("_slot").orderBy(F.col("doc_id").asc_nulls_last(), "_crc", "_size"))
    return sharded.withColumn("_in", inside).join(F.broadcast(ahead), "_slot").withColumn("_place", F.col("_ahead") + F.col("_in") - 1).drop("_in", "_ahead")
