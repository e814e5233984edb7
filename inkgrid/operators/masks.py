"""Sets of mask pixels (``image_id, mask_id, y, x``, foreground only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CELL = ["image_id", "mask_id", "y", "x"]


def empty_masks(mask_pixels: DataFrame, masks: DataFrame) -> DataFrame:
    """Requested masks without any foreground pixel."""
    return masks.join(mask_pixels.select("image_id", "mask_id").distinct(), ["image_id", "mask_id"], "left_anti").select(
        "image_id", "mask_id", F.lit("empty_mask").alias("reason")
    )


def union_masks(mask_pixels: DataFrame, selection: DataFrame) -> DataFrame:
    """OR of the selected masks (``image_id, mask_id, new_id``)."""
    return mask_pixels.join(selection, ["image_id", "mask_id"]).select(
        "image_id", F.col("new_id").alias("mask_id"), "y", "x"
    ).distinct()


def intersect_masks(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pixels in both mask sets (same image and mask id)."""
    return a.select(*_CELL).intersect(b.select(*_CELL))


def xor_masks(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pixels in exactly one of two mask sets, in one shuffle."""
    tagged = a.select(*_CELL, F.lit(1).alias("side")).unionByName(b.select(*_CELL, F.lit(2).alias("side")))
    return tagged.groupBy(*_CELL).agg(F.bit_or("side").alias("sides")).where("sides <> 3").select(*_CELL)


def layer_fidelity(reconstructed: DataFrame, own: DataFrame, tolerance: float = 0.15) -> DataFrame:
    """Differing pixels per pixel of the source mask."""
    keys = ["image_id", "mask_id", "y", "x"]
    sides = reconstructed.select(*keys, F.lit(1).alias("side")).unionByName(own.select(*keys, F.lit(2).alias("side")))
    cells = sides.groupBy(*keys).agg(F.bit_or("side").alias("sides"))
    own_count = F.count_if(F.col("sides") >= 2)
    ratio = F.count_if(F.col("sides") != 3) / F.greatest(own_count, F.lit(1))
    return cells.groupBy("image_id", "mask_id").agg(
        own_count.alias("own_pixels"), F.count_if(F.col("sides") != 2).alias("reconstructed_pixels"),
        ratio.alias("own_mismatch_ratio"), (ratio <= tolerance).alias("own_mismatch_within_tolerance"),
    )


def layer_contamination(reconstructed: DataFrame, masks: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Share of each reconstructed layer lying on other masks of its image."""
    mine, other = reconstructed.alias("r"), masks.alias("m")
    on_other = (
        (F.col("r.image_id") == F.col("m.image_id")) & (F.col("r.y") == F.col("m.y"))
        & (F.col("r.x") == F.col("m.x")) & (F.col("r.mask_id") != F.col("m.mask_id"))
    )
    hit = mine.join(other, on_other, "left_semi").groupBy("image_id", "mask_id").agg(F.count("*").alias("hit"))
    size = reconstructed.groupBy("image_id", "mask_id").agg(F.count("*").alias("size"))
    ratio = F.coalesce("hit", F.lit(0)) / F.col("size")
    return size.join(hit, ["image_id", "mask_id"], "left").select(
        "image_id", "mask_id", ratio.alias("contamination_ratio"),
        (ratio <= tolerance).alias("contamination_within_tolerance"),
    )


def layer_warnings(fidelity: DataFrame, contamination: DataFrame) -> DataFrame:
    """Both ratios of a layer and the list of exceeded tolerances; nothing is rejected."""
    both = fidelity.join(contamination, ["image_id", "mask_id"], "left").na.fill(0.0, ["contamination_ratio"])
    return both.select(
        "image_id", "mask_id", "own_mismatch_ratio", "contamination_ratio",
        F.concat_ws(
            ",",
            F.when(~F.col("own_mismatch_within_tolerance"), "own_mismatch"),
            F.when(~F.coalesce("contamination_within_tolerance", F.lit(True)), "contamination"),
        ).alias("warnings"),
    )
