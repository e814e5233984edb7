"""Colour arithmetic as column expressions (channels are INT 0..255)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def luma(b: Column, g: Column, r: Column) -> Column:
    """Rec.601 grey level in 14-bit fixed point."""
    return F.shiftright(r * 4899 + g * 9617 + b * 1868 + 8192, 14).cast("int")


def contrast_brightness_value(v: Column, contrast: float, brightness: int) -> Column:
    """Scaled, clipped to 0..255, then truncated."""
    if contrast == 1.0 and brightness == 0:
        return v
    scaled = F.round(v * F.lit(float(contrast)) + F.lit(float(brightness)), 9)
    return F.floor(F.least(F.greatest(scaled, F.lit(0.0)), F.lit(255.0))).cast("int")


def posterize_value(v: Column, step: Column | int) -> Column:
    step = F.lit(step) if isinstance(step, int) else step
    return (F.floor(v / step) * step).cast("int")


def encode_hex(b: Column, g: Column, r: Column) -> Column:
    return F.lower(F.concat(F.lit("#"), *[F.lpad(F.hex(c), 2, "0") for c in (r, g, b)]))


def parse_hex(text: Column) -> Column:
    """``#rrggbb`` to a (b, g, r) struct."""
    digits = F.ltrim(text, F.lit("#"))

    def channel(start: int) -> Column:
        return F.conv(F.substring(digits, start, 2), 16, 10).cast("int")

    return F.struct(channel(5).alias("b"), channel(3).alias("g"), channel(1).alias("r"))


def _linear(c: Column) -> Column:
    v = c / 255.0
    return F.when(v > 0.04045, F.pow((v + 0.055) / 1.055, F.lit(2.4))).otherwise(v / 12.92)


def _lab_root(t: Column) -> Column:
    return F.when(t > 0.008856, F.pow(t, F.lit(1.0 / 3.0))).otherwise(t * 7.787 + 16.0 / 116.0)


def lab_l(y: Column) -> Column:
    return F.when(y > 0.008856, F.pow(y, F.lit(1.0 / 3.0)) * 116.0 - 16.0).otherwise(y * 903.3)


def bgr_to_lab(b: Column, g: Column, r: Column) -> Column:
    """8-bit CIELAB (D65): L scaled to 0..255, a and b shifted by 128."""
    rl, gl, bl = _linear(r), _linear(g), _linear(b)
    x = (rl * 0.412453 + gl * 0.357580 + bl * 0.180423) / 0.950456
    y = rl * 0.212671 + gl * 0.715160 + bl * 0.072169
    z = (rl * 0.019334 + gl * 0.119193 + bl * 0.950227) / 1.088754
    fx, fy, fz = _lab_root(x), _lab_root(y), _lab_root(z)

    def byte(v: Column) -> Column:
        return F.least(F.greatest(F.round(F.round(v, 6), 0), F.lit(0.0)), F.lit(255.0)).cast("int")

    return F.struct(
        byte(lab_l(y) * 255.0 / 100.0).alias("lab_l"),
        byte((fx - fy) * 500.0 + 128.0).alias("lab_a"),
        byte((fy - fz) * 200.0 + 128.0).alias("lab_b"),
    )


def lab_distance(p: Column, q: Column) -> Column:
    """Euclidean distance of two Lab structs."""
    return F.sqrt(
        sum(((p[f] - q[f]) * (p[f] - q[f]) for f in ("lab_l", "lab_a", "lab_b")), F.lit(0.0))
    )


def round_half_even(v: Column) -> Column:
    return F.bround(v, 0)
