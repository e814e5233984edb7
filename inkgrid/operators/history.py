"""Append-only version histories: latest rows, numbering, reuse, lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgrid.functions import text
from inkgrid.session import cut_lineage

ColumnOrName = Column | str


def latest_version(history: DataFrame, keys: list[str], version: str = "version") -> DataFrame:
    """Last row per key; of rows with the same version the one with the largest other columns.

    The newest version is a hash aggregate on one plain column.  Only its rows, one
    per key but for repeats, go through the second aggregate, which compares rows.
    """
    rest = [c for c in history.columns if c not in keys and c != version]
    if not rest:
        return history.groupBy(*keys).agg(F.max(version).alias(version))
    top = history.groupBy(*keys).agg(F.max(version).alias(version))
    newest = history.join(top, [*keys, version], "left_semi")
    return newest.groupBy(*keys, version).agg(F.max(F.struct(*rest)).alias("last")).select(*keys, version, "last.*")


def running_total(df: DataFrame, keys: list[str], order: list[ColumnOrName], value: str, name: str) -> DataFrame:
    """Running sum per key that does not sort a hot key in one task.

    Rows are dealt by ranges of (key, order), so a busy key runs over several
    parts.  Sums run inside a part; the totals of the key's earlier parts are
    added.  The parts are written, since the totals must see the same ones.
    """
    ranged = df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    cut = cut_lineage(ranged)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy(*keys, "_part").agg(F.sum(value).alias("_n")).select(
        *keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumn("_local", F.sum(value).over(inside))
    return local.join(offsets, [*keys, "_part"]).select(
        *df.columns, (F.col("_local") + F.col("_offset")).alias(name)
    )


def numbered(df: DataFrame, keys: list[str], order: list[ColumnOrName], name: str) -> DataFrame:
    """Row number per key, cut into parts like :func:`running_total`."""
    ones = running_total(df.withColumn("_one", F.lit(1)), keys, order, "_one", name)
    return ones.drop("_one")


def assign_versions(new: DataFrame, history: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Version numbers of new rows: the key's previous maximum plus the arrival position."""
    top = history.groupBy(*keys).agg(F.max("version").alias("_top"))
    return numbered(new, keys, order, "_n").join(top, keys, "left").select(
        *new.columns, (F.col("_n") + F.coalesce("_top", F.lit(0))).alias("version")
    )


def cache_hits(requests: DataFrame, source_keys: list[str], order: list[str], artifact: str) -> DataFrame:
    """Artefact each request ends up with: the first one computed for its source and parameters.

    A reused artefact still gives the request a version of its own.
    """
    keys = [*source_keys, "cache_key"]
    first = requests.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"))
    joined = requests.join(first, keys)
    return joined.select(
        *requests.columns, F.col(f"_first.{artifact}").alias("used_artifact"),
        (F.struct(*order) != F.col("_first")).alias("from_cache"),
    )


def lineage(stages: dict[str, DataFrame]) -> DataFrame:
    """Joins stage tables (``id, source_id``) down the chain in the given order.

    The first stage has only ``id``; each later one points to the one before.
    Rows whose source is unknown get status ``not_found`` at their own stage.
    """
    names = list(stages)
    chain = stages[names[0]].select(F.col("id").alias(names[0]))
    out = None
    for parent, name in zip(names, names[1:]):
        step = stages[name].select(F.col("id").alias(name), F.col("source_id").alias(parent))
        dangling = step.join(chain.select(parent), parent, "left_anti").select(
            F.lit(name).alias("stage"), F.col(name).cast("string").alias("id"),
            F.col(parent).cast("string").alias("source_id"), F.lit("not_found").alias("status"),
        )
        found = step.join(chain.select(parent), parent, "left_semi").select(
            F.lit(name).alias("stage"), F.col(name).cast("string").alias("id"),
            F.col(parent).cast("string").alias("source_id"), F.lit("ok").alias("status"),
        )
        both = found.unionByName(dangling)
        out = both if out is None else out.unionByName(both)
        chain = chain.join(step, parent)
    return out


def idempotent_ingest(uploads: DataFrame, key: str, order: list[str]) -> DataFrame:
    """First upload per idempotency key; blank keys are never taken for repeats."""
    blank = text.blank(key)
    rest = [c for c in uploads.columns if c not in (key, *order)]
    first = uploads.where(~blank).groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("first"))
    return first.select(key, "first.*").select(uploads.columns).unionByName(uploads.where(blank))
