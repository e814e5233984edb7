"""Mixing sources to target weights by weighted sampling without replacement.

Every document gets an exponential key -ln(u)/w with a repeatable u and a quality
weight w (Efraimidis and Spirakis); small keys come first.  Per source, complete
epochs come before the fractional one, which takes documents in key order until
the budget is reached.  Keys are cut into ranges, so the prefix sum of a source is
a sum over ranges plus a sort of the one range where the budget ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkgrid.llm.common import written

RANGES = 1024
#: Weights are brought into this interval, so that no key range holds more than about 1 / (LEAST * ranges) of a source.
LEAST, MOST = 0.25, 1.0


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """Between 0.25 and 1: the share of letters and blanks among the text's characters."""
    plain = F.length(F.regexp_replace(text, r"[^\p{L}\s]+", "")) / F.greatest(F.length(text), F.lit(1))
    return F.greatest(F.coalesce(plain, F.lit(0.0)), F.lit(LEAST))


def source_targets(totals: DataFrame, weights: Column, cap: float = 3.0) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    All sizes together are shared by weight; what goes beyond ``cap`` times a
    source's size is shared again among the others.  The capped sources are the
    first ones by cap/weight, so prefix sums find the common level at once.
    There is one row per source: the list of sources is a setting of the mix.
    """
    ranked = totals.withColumn("_rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))).withColumn("_w", weights).withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    order = W.orderBy((F.col("_cap") / F.col("_w")), "_rank")
    every = W.partitionBy()
    before = ranked.withColumns({"_caps": F.sum("_cap").over(order) - F.col("_cap"), "_left": F.sum("_w").over(every) - F.sum("_w").over(order) + F.col("_w"),
                                 "_all": F.sum("source_size").over(every)})
    level = (F.col("_all") - F.col("_caps")) / F.col("_left")
    open_level = F.min(F.when(level * F.col("_w") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("_w"), F.col("_rank"), level.alias("level")))).over(every)["level"]
    return before.withColumn("_level", open_level).select("source", "source_size", F.coalesce(F.least("_cap", F.col("_level") * F.col("_w")), F.col("_cap")).alias("target"))


def repeated(docs: DataFrame, seed: int = 17, cap: float = 3.0, weight: str | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it; ``weight`` names a column of qualities."""
    numbered = written(docs.select(F.monotonically_increasing_id().alias("uid"), F.struct("*").alias("row")), "mix-rows")
    told = [] if weight is None else [F.col(f"row.{weight}").alias("_weight")]
    times = mix_sources(numbered.select("uid", "row.doc_id", "row.source", "row.text", *told), seed, cap, uid="uid", weight=F.col("_weight") if told else None)
    times = times.select("uid", (F.col("epochs") + F.col("picked").cast("long")).cast("int").alias("times")).where("times > 0")
    return numbered.join(times, "uid").select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def mix_sources(docs: DataFrame, seed: int = 17, cap: float = 3.0, ranges: int = RANGES, uid: str | None = None, weight: Column | None = None) -> DataFrame:
    """``uid, doc_id, source, size, source_size, target, epochs, picked, taken``: how often each document enters the mix.

    Sources by code point (null last) weigh 1, 2, 3, 1, 2, 3, ...  ``epochs``
    complete passes precede the fractional one; ``picked`` says whether the
    fractional one takes the document.  Null texts have size 0 and are never
    picked.  Ties in the key are broken by ``doc_id`` and checksum; rows equal in
    both are taken in the order of ``uid``, a number given to each row of the
    table that is written on the way.  Other columns are ignored.

    ``weight`` is the quality of a document, such as a score that a quality model
    gave it; null counts as ``LEAST``.  Without it the share of letters stands in.
    """
    quality = quality_weight(F.col("text")) if weight is None else F.greatest(F.least(F.coalesce(weight.cast("double"), F.lit(LEAST)), F.lit(MOST)), F.lit(LEAST))
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("_crc")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    keyed = docs.select((F.col(uid) if uid else F.monotonically_increasing_id()).alias("uid"), "doc_id", "source", count_words(F.col("text")).alias("size"), quality.alias("_q"), crc.alias("_crc"))
    keyed = keyed.withColumn("_key", -F.log(u) / F.col("_q")).withColumn("_range", F.floor((1 - F.exp(-F.col("_key") * LEAST)) * ranges).cast("int"))
    keyed = written(keyed.drop("_q"), "mix-keys")
    sums = keyed.groupBy("source", "_range").agg(F.sum("size").alias("_sum"))
    totals = sums.groupBy("source").agg(F.sum("_sum").alias("source_size"))
    targets = source_targets(totals, 1 + (F.col("_rank") - 1) % 3, cap)
    budget = F.col("target") - F.col("epochs") * F.col("source_size")
    targets = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)).withColumn("_budget", budget)
    starts = sums.withColumn("_start", F.sum("_sum").over(W.partitionBy("source").orderBy("_range")) - F.col("_sum")).alias("s")
    starts = starts.join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select("s.source", "_range", "_sum", "_start", "source_size", "target", "epochs", "_budget")
    rows = keyed.alias("k").join(starts.alias("s"), F.col("k.source").eqNullSafe(F.col("s.source")) & (F.col("k._range") == F.col("s._range"))).select("k.*", "_sum", "_start", "source_size", "target", "epochs", "_budget")
    ends_here = (F.col("_start") < F.col("_budget")) & (F.col("_start") + F.col("_sum") > F.col("_budget"))
    inside = W.partitionBy("source", "_range").orderBy("_key", F.col("doc_id").asc_nulls_last(), "_crc", "uid").rowsBetween(W.unboundedPreceding, -1)
    cut = rows.where(ends_here).withColumn("_ahead", F.col("_start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    cut = cut.withColumn("picked", F.col("_ahead") + F.col("size") / 2 <= F.col("_budget")).drop("_ahead")
    whole = rows.where(~ends_here).withColumn("picked", F.col("_start") < F.col("_budget"))
    both = whole.unionByName(cut).withColumn("picked", F.col("picked") & (F.col("size") > 0))
    taken = F.col("size") * (F.col("epochs") + F.col("picked").cast("long"))
    return both.select("uid", "doc_id", "source", "size", "source_size", "target", "epochs", "picked", taken.cast("long").alias("taken"))
