"""Lines that many documents share are dropped.

Text is exploded into lines, every line hashed after normalising, distinct
documents counted per hash, and the lines over the threshold removed while the
others are put back by position.  Only hashes and positions are shuffled for the
counting; the text itself moves once, to meet a mask of the lines to drop, so a
text is taken apart and put together in time linear in its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgrid.llm.common import SPACES, lower_ascii, written


def line_key(line: Column) -> Column:
    """ASCII white space stripped at both ends, A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.lit(SPACES)))


def _hashes(value: Column) -> Column:
    """128 bits as two longs."""
    return F.struct(F.xxhash64(value).alias("a"), F.xxhash64(value, F.lit(1)).alias("b"))


def shared_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """Hashes found in at least ``min_docs`` distinct documents (``doc_id``, ``key``)."""
    once = lines.select("doc_id", "key").distinct()
    return once.groupBy("key").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= min_docs).select("key")


def mask_of(positions: Column) -> Column:
    """Ascending distinct positions as an array that is true at each of them and false before."""
    before = F.slice(F.concat(F.array(F.lit(-1)), positions), 1, F.size(positions))
    return F.flatten(F.zip_with(positions, before, lambda at, last: F.concat(F.array_repeat(F.lit(False), at - last - 1), F.array(F.lit(True)))))


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``doc_id, text, n_lines, n_dropped``: every document without its lines found in ``min_docs`` documents or more.

    A null or empty text is one empty line.  Keys shorter than ``min_chars``
    code points are never dropped.  Documents are told apart by ``doc_id``; all
    null ids count as one document.  Repeated rows come out as often as they
    come in.  Other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", text.alias("text"), _hashes(text).alias("_of"))
    lines = (
        base.select("doc_id", "_of", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .select("doc_id", "_of", "pos", line_key(F.col("line")).alias("norm"))
        .where(F.length("norm") >= min_chars)
        .select("doc_id", "_of", "pos", _hashes(F.col("norm")).alias("key"))
    )
    # What is dropped depends on the text alone, so the positions are keyed by its hash, not by an id that may repeat.
    # The small sides of both joins are written first: then a hot line or a hot text can be split between tasks.
    shared = written(shared_lines(lines, min_docs), "shared-lines")
    gone = lines.select("_of", "pos", "key").join(shared, "key").groupBy("_of").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    drops = written(gone.select("_of", F.size("gone").cast("long").alias("n_gone"), mask_of(F.col("gone")).alias("mask")), "line-drops")
    split = F.split("text", "\n", -1)
    kept = F.when(F.col("mask").isNull(), F.col("text")).otherwise(F.array_join(F.filter(split, lambda _, i: ~F.coalesce(F.get(F.col("mask"), i), F.lit(False))), "\n"))
    joined = base.join(drops, "_of", "left")
    return joined.select("doc_id", kept.alias("text"), F.size(split).cast("long").alias("n_lines"), F.coalesce("n_gone", F.lit(0).cast("long")).alias("n_dropped"))
