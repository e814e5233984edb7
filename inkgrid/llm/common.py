"""Helpers shared by the corpus operators: words, hashes, written tables, fixed-size sketches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkgrid.session import run_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\x0b\f\r"
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {_BASE: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; the slower character map runs only where other letters occur."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    folder = run_dir(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in views of few rows, so that a task holds Python objects and results of one view only, not of a whole batch of long texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def payloads(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column as UTF-8 bytes; null counts as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def _power_table(base: int, n: int) -> np.ndarray:
    table = _powers[base]
    while len(table) <= n:
        step = np.uint64(pow(base, len(table), 1 << 64))
        table = np.concatenate([table, table * step])
    _powers[base] = table
    return table


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def span_hashes(buffer: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of many byte ranges of one buffer, equal for equal bytes, by prefix sums of a polynomial."""
    data = np.frombuffer(buffer, np.uint8).astype(np.uint64) + np.uint64(1)
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(data * _power_table(_BASE, n)[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * _power_table(_INVERSE, n)[starts])


def word_spans(words: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Words joined by one space, with the start and end of each."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    return b" ".join(words), ends - lengths, ends


def word_hashes(words: list[bytes]) -> np.ndarray:
    if not words:
        return np.zeros(0, np.uint64)
    return span_hashes(*word_spans(words))


def fixed_table(rows: DataFrame, fold: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> dict[int, bytes]:
    """Sum ``part, cells`` rows of a sketch of fixed size by part and bring the (fixed number of) parts to the driver."""
    parts = rows.repartition("part").mapInArrow(fold, schema)
    return {r["part"]: bytes(r["cells"]) for r in parts.collect()}


def numbered(df: DataFrame, keys: list[str], order: list[Column], label: str) -> DataFrame:
    """Adds ``pos`` (0, 1, 2, ... within ``keys`` by ``order``) and ``n`` (rows of the key); keys must not be null.

    Rows are dealt by ranges of key and order, sorted within their range and written,
    so no key is sorted in one task; a range's first place follows from the counts
    of the ranges before it.  The order should end in a column that differs in
    every row, otherwise equal rows share a range.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    by = [*[F.col(k).asc() for k in keys], *order]
    ranged = df.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    rows = written(ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), label)
    counts = rows.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_count"), F.min("_at").alias("_first"))
    key = W.partitionBy(*keys)  # at most one row per range
    counts = counts.select(*keys, "_part", "_first", F.sum("_count").over(key).alias("n"),
                           (F.sum("_count").over(key.orderBy("_part")) - F.col("_count")).alias("_ahead"))
    return rows.join(counts, [*keys, "_part"]).withColumn("pos", F.col("_at") - F.col("_first") + F.col("_ahead")).drop("_at", "_part", "_first", "_ahead")
