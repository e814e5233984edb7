"""Streaming forms of ingest and latest-version upkeep.

State that has to be kept for ever is a table of one row per key, cut into buckets
by key.  A batch merges into the buckets it touches and writes them anew as
``out/rows/batch=N/bucket=B``; ``out/places/batch=N`` says for each bucket which
batch holds it.  So a batch reads the last generation of its own buckets and
nothing else, and what two generations have replaced is deleted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkgrid.functions import text
from inkgrid.operators.history import idempotent_ingest, latest_version


def idempotent_stream(uploads: DataFrame, key: str, ts: str | None = None, delay: str | None = None) -> DataFrame:
    """First upload per key on a stream; blank keys pass through.

    Without ``delay`` every key is remembered for ever, as in the catalogue.
    With ``delay`` keys are forgotten after it, which bounds the state but lets
    a later repeat in.
    """
    blank = text.blank(key)
    keyed = uploads.where(~blank)
    if delay is None:
        first = keyed.dropDuplicates([key])
    else:
        first = keyed.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])
    return first.unionByName(uploads.where(blank))


Fold = Callable[[DataFrame], DataFrame]


def stream_latest(
    spark: SparkSession, folder: str, schema: T.StructType, keys: list[str], version: str, out: str, checkpoint: str, buckets: int = 64
):
    """Keeps the newest version per key from JSON records that arrive in ``folder``.

    A batch that is run again writes the same files.
    """
    def fold(rows: DataFrame) -> DataFrame:
        return latest_version(rows.where(F.col(version).isNotNull()), keys, version)

    return _keep(spark, folder, schema, F.xxhash64(*keys), fold, out, checkpoint, buckets)


def stream_earliest(
    spark: SparkSession, folder: str, schema: T.StructType, key: str, order: list[str], out: str, checkpoint: str, buckets: int = 64
):
    """Keeps the earliest upload per key, by ``order``, from JSON records that arrive in ``folder``.

    Keys are kept for ever, and an earlier upload that arrives late takes the place
    of the one kept so far.  Uploads with a blank key are all kept.
    """
    place = F.when(text.blank(key), F.xxhash64(*order)).otherwise(F.xxhash64(key))
    return _keep(spark, folder, schema, place, lambda rows: idempotent_ingest(rows, key, order), out, checkpoint, buckets)


def _keep(spark: SparkSession, folder: str, schema: T.StructType, place: Column, fold: Fold, out: str, checkpoint: str, buckets: int):
    records = spark.readStream.schema(schema).option("recursiveFileLookup", "true").json(folder)

    def merge(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        fresh = fold(batch.select(*schema.names)).withColumn("bucket", F.pmod(place, F.lit(buckets)).cast("int"))
        touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # at most `buckets` numbers
        before = _places(session, out, number - 1)
        held = _rows(session, schema, out, {b: before[b] for b in touched if b in before})
        merged = fresh if held is None else fold(held.unionByName(fresh.select(*schema.names))).withColumn("bucket", F.pmod(place, F.lit(buckets)).cast("int"))
        merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/rows/batch={number}")
        after = {**before, **dict.fromkeys(touched, number)}
        session.createDataFrame(list(after.items()), PLACES).coalesce(1).write.mode("overwrite").parquet(f"{out}/places/batch={number}")
        _drop_replaced(session, out, number, before, after)

    return records.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


PLACES = "bucket int, holder int"


def _places(spark: SparkSession, out: str, number: int) -> dict[int, int]:
    """Which batch holds each bucket, as of a batch."""
    if number < 0:
        return {}
    return {r["bucket"]: r["holder"] for r in spark.read.schema(PLACES).parquet(f"{out}/places/batch={number}").collect()}


def _rows(spark: SparkSession, schema: T.StructType, out: str, places: dict[int, int]) -> DataFrame | None:
    """The rows of some buckets, each read from the one folder that holds it."""
    if not places:
        return None
    return spark.read.schema(schema).parquet(*[f"{out}/rows/batch={holder}/bucket={bucket}" for bucket, holder in places.items()])


def _drop_replaced(spark: SparkSession, out: str, number: int, before: dict[int, int], after: dict[int, int]) -> None:
    """Deletes what neither this batch nor the one before refers to; the one before is what this batch starts from if it is run again."""
    if number < 2:
        return
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(out).getFileSystem(spark._jsc.hadoopConfiguration())
    oldest = _places(spark, out, number - 2) if files.exists(path(f"{out}/places/batch={number - 2}")) else {}
    for bucket, holder in oldest.items():
        if holder not in (before.get(bucket), after.get(bucket)):
            files.delete(path(f"{out}/rows/batch={holder}/bucket={bucket}"), True)
    files.delete(path(f"{out}/places/batch={number - 2}"), True)


def latest_snapshot(spark: SparkSession, schema: T.StructType, out: str) -> DataFrame:
    """The row of every key so far."""
    newest = spark.read.parquet(f"{out}/places").agg(F.max("batch")).first()[0]
    rows = None if newest is None else _rows(spark, schema, out, _places(spark, out, newest))
    return spark.createDataFrame([], schema) if rows is None else rows.select(*schema.names)
