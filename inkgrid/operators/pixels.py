"""Pixel projections, stencils and per-image statistics.

Pixel tables have the columns ``image_id, y, x, b, g, r, a``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgrid.functions.colour import bgr_to_lab, contrast_brightness_value, luma, posterize_value

PIXEL_SCHEMA = "image_id long, y int, x int, b int, g int, r int, a int"
_CHANNELS = ("b", "g", "r")
#: Slices of one shape are unpacked together up to so many bytes.
_FRAME_BYTES = 4 * 1024 * 1024


def explode_pixels(images: DataFrame, rows_per_slice: int = 64, keep_alpha: bool = True) -> DataFrame:
    """Image bytes to one row per pixel; one channel is repeated to three.

    The bytes are cut into slices of whole pixel rows first, so that one huge
    image spreads over tasks instead of being reshaped in a single one.
    """
    stride = F.col("width") * F.col("n_channels")
    slices = (
        images.where("width > 0 and height > 0")
        .withColumn("y0", F.explode(F.sequence(F.lit(0), F.col("height") - 1, F.lit(rows_per_slice))))
        .select(
            "image_id", "width", "n_channels", "y0",
            F.substring("data", F.col("y0") * stride + 1, stride * rows_per_slice).alias("data"),
        )
        .repartition("image_id", "y0")
    )

    def reshape(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (width, channels, size), like in batch.groupby(["width", "n_channels", batch["data"].map(len)], sort=False, dropna=False):
                few = max(1, _FRAME_BYTES // max(1, size))  # slices of one shape are taken together
                for at in range(0, len(like), few):
                    s = like.iloc[at:at + few]
                    block = np.frombuffer(b"".join(s["data"]), np.uint8).reshape(len(s), -1, width, channels)
                    shape = block.shape[:3]
                    colour = np.repeat(block[..., :1], 3, axis=3) if channels < 3 else block[..., :3]
                    alpha = block[..., 3] if channels == 4 and keep_alpha else np.full(shape, 255, np.uint8)
                    y = s["y0"].to_numpy(np.int32)[:, None, None] + np.arange(shape[1], dtype=np.int32)[:, None]
                    yield pd.DataFrame({
                        "image_id": np.repeat(s["image_id"].to_numpy(), shape[1] * width),
                        "y": np.broadcast_to(y, shape).ravel(),
                        "x": np.broadcast_to(np.arange(width, dtype=np.int32), shape).ravel(),
                        "b": colour[..., 0].ravel().astype(np.int32),
                        "g": colour[..., 1].ravel().astype(np.int32),
                        "r": colour[..., 2].ravel().astype(np.int32),
                        "a": alpha.ravel().astype(np.int32),
                    })

    return slices.mapInPandas(reshape, PIXEL_SCHEMA)


def _recolour(px: DataFrame, value: dict[str, Column]) -> DataFrame:
    return px.select(*[value[c].alias(c) if c in value else F.col(c) for c in px.columns])


def grayscale(px: DataFrame) -> DataFrame:
    grey = luma(F.col("b"), F.col("g"), F.col("r"))
    return _recolour(px, {c: grey for c in _CHANNELS})


def contrast_brightness(px: DataFrame, contrast: float = 1.0, brightness: int = 0) -> DataFrame:
    return _recolour(px, {c: contrast_brightness_value(F.col(c), contrast, brightness) for c in _CHANNELS})


def posterize(px: DataFrame, step: int) -> DataFrame:
    return _recolour(px, {c: posterize_value(F.col(c), step) for c in _CHANNELS})


def to_lab(px: DataFrame) -> DataFrame:
    return px.withColumn("lab", bgr_to_lab(F.col("b"), F.col("g"), F.col("r"))).select("*", "lab.*").drop("lab")


def gaussian_kernel(strength: int) -> list[float]:
    """Weights at the offsets -s..s with sigma = s/2, summing to one."""
    sigma = strength * 0.5
    raw = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-strength, strength + 1)]
    return [w / sum(raw) for w in raw]


def _mirrored_positions(pos: Column, size: Column, reach: int) -> Column:
    """All positions in [-reach, size-1+reach] that a mirrored border maps to ``pos``."""
    period = F.greatest((size - 1) * 2, F.lit(1))
    turns = F.ceil(F.lit(reach) / period).cast("int") + 1
    images = F.flatten(
        F.transform(F.sequence(-turns, turns), lambda m: F.array(pos + m * period, m * period - pos))
    )
    wanted = F.array_distinct(F.filter(images, lambda p: (p >= -reach) & (p <= size - 1 + reach)))
    inner = (pos > reach) & (pos < size - 1 - reach)
    return F.when(inner, F.array(pos)).otherwise(wanted)


def per_image(rows: DataFrame, images: DataFrame, spread: list[str], salts: int = 32) -> DataFrame:
    """Rows joined to a table with few rows per image: those are repeated per salt, so a huge image does not meet in one task."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    repeated = images.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, ["image_id", "_salt"]).drop("_salt")


def _blur_pass(px: DataFrame, axis: str, other: str, strength: int) -> DataFrame:
    """One direction of the separable blur.

    Only border pixels are repeated (as their mirror images); the weighted sum
    is a row of lag/lead expressions over one window, so each pass costs one
    shuffle of the pixels and no fan-out by the kernel size.
    """
    extent = "width" if axis == "x" else "height"
    padded = px.withColumn("_n", F.col(f"_{extent}")).withColumn("_p", F.explode(_mirrored_positions(F.col(axis), F.col("_n"), strength)))
    line = Window.partitionBy("image_id", other).orderBy("_p")
    kernel = gaussian_kernel(strength)

    def blurred(c: str) -> Column:
        terms = [
            F.lag(c, -k).over(line) * F.lit(w) if k else F.col(c) * F.lit(w)
            for k, w in zip(range(-strength, strength + 1), kernel)
        ]
        return sum(terms[1:], terms[0]).alias(c)

    kept = [c for c in px.columns if c not in _CHANNELS]
    return padded.select(
        *kept, *[blurred(c) for c in _CHANNELS], "_p", "_n"
    ).where("_p between 0 and _n - 1 and _p = " + axis).select(*px.columns)


def denoise(px: DataFrame, canvas: DataFrame, strength: int) -> DataFrame:
    """Gaussian blur of width 2s+1; strength 0 changes nothing."""
    if strength <= 0:
        return px
    sized = per_image(px, canvas.select("image_id", F.col("width").alias("_width"), F.col("height").alias("_height")), ["y", "x"])
    both = _blur_pass(_blur_pass(sized, "x", "y", strength), "y", "x", strength).select(*px.columns)
    return _recolour(both, {
        c: F.least(F.greatest(F.floor(F.round(F.col(c), 6) + 0.5), F.lit(0)), F.lit(255)).cast("int")
        for c in _CHANNELS
    })


def preprocess(
    px: DataFrame, canvas: DataFrame, gray: bool = False, contrast: float = 1.0,
    brightness: int = 0, strength: int = 0,
) -> DataFrame:
    """Grey, then contrast and brightness, then denoise: always in this order."""
    if gray:
        px = grayscale(px)
    return denoise(contrast_brightness(px, contrast, brightness), canvas, strength)


def image_metrics(px: DataFrame) -> DataFrame:
    grey = luma(F.col("b"), F.col("g"), F.col("r"))
    return px.groupBy("image_id").agg(
        F.avg(grey).alias("mean_brightness"),
        F.stddev_pop(grey).alias("std_dev"),
        F.min(grey).alias("min_value"),
        F.max(grey).alias("max_value"),
    )


def threshold(px: DataFrame, value: int = 128, invert: bool = False) -> DataFrame:
    """Mask rows ``image_id, y, x, v`` with v 0 or 255."""
    above = luma(F.col("b"), F.col("g"), F.col("r")) > value
    inside = ~above if invert else above
    return px.select("image_id", "y", "x", F.when(inside, 255).otherwise(0).alias("v"), "a")


def alpha_background(mask: DataFrame, limit: int = 0) -> DataFrame:
    """Fully transparent pixels become background, whatever their colour."""
    return mask.withColumn("v", F.when(F.col("a") <= limit, 0).otherwise(F.col("v")))


def rebinarize(mask: DataFrame, above: int = 127) -> DataFrame:
    return mask.withColumn("v", F.when(F.col("v") > above, 255).otherwise(0))


def threshold_metrics(mask: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Share of foreground; images listed without any pixel count as 0 and 0."""
    share = F.count_if(F.col("v") == 255) / F.count("*") * 100.0
    found = mask.groupBy("image_id").agg(share.alias("foreground_percent"))
    found = found.withColumn("background_percent", F.lit(100.0) - F.col("foreground_percent"))
    if images is None:
        return found
    return images.select("image_id").join(found, "image_id", "left").na.fill(
        0.0, ["foreground_percent", "background_percent"]
    )


def mask_warnings(metrics: DataFrame, empty_at: float = 2.0, full_at: float = 98.0) -> DataFrame:
    share = F.col("foreground_percent")
    return metrics.withColumn(
        "warning", F.when(share <= empty_at, "near_empty").when(share >= full_at, "near_full")
    )
