"""Validators: the first failing reason per row, in a fixed order (null when fine)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgrid.functions.text import EXTENSIONS, trimmed
from inkgrid.functions.text import blank as is_blank

MAX_UPLOAD_BYTES = 15 * 1024 * 1024
MAX_SIDE, MAX_PIXELS = 6000, 25_000_000

# Accepted file endings by content type, and the presets.
_ENDINGS = {"image/png": [".png"], "image/jpeg": [".jpg", ".jpeg"], "image/webp": [".webp"]}
_PRESETS = {"low": 0.0015, "medium": 0.004, "high": 0.012}


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^./\\]+)$", 1))


def signature_matches(content: Column, mime: Column) -> Column:
    """Do the first bytes belong to the declared image type?"""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(mime == "image/png", head.startswith("89504E470D0A1A0A")).when(mime == "image/jpeg", head.startswith("FFD8FF"))
        .when(mime == "image/webp", (F.substring(head, 1, 8) == "52494646") & (F.substring(head, 17, 8) == "57454250")).otherwise(False)
    )


def validate_uploads(files: DataFrame, max_bytes: int = MAX_UPLOAD_BYTES) -> DataFrame:
    """``name, mime, content`` (and ``decodable`` when a decode result was joined) with ``reason``."""
    mime, ending = F.lower(trimmed(F.col("mime"))), extension(F.col("name"))
    known = F.lit(False)
    for kind, endings in _ENDINGS.items():
        known = known | ((mime == kind) & ending.isin(endings))
    size = F.coalesce(F.octet_length("content"), F.lit(0))
    decodable = F.col("decodable") if "decodable" in files.columns else F.lit(True)
    reason = (
        F.when(size == 0, "empty_file").when(size > max_bytes, "file_too_large").when(~F.coalesce(known, F.lit(False)), "unsupported_format")
        .when(~signature_matches(F.col("content"), mime), "corrupt_file").when(~F.coalesce(decodable, F.lit(False)), "corrupt_file")
    )
    return files.withColumn("reason", reason)


def validate_assets(assets: DataFrame, max_bytes: int = MAX_UPLOAD_BYTES) -> DataFrame:
    """``type, mime, size`` with ``reason``: type name, empty, too large, content type."""
    kind = F.lower(trimmed(F.coalesce("type", F.lit(""))))
    mime = F.lower(trimmed(F.coalesce("mime", F.lit(""))))
    reason = (
        F.when(~kind.rlike("^[a-z0-9_-]{1,40}$"), "invalid_type").when(F.coalesce("size", F.lit(0)) == 0, "empty_file")
        .when(F.col("size") > max_bytes, "file_too_large").when(~mime.isin(list(EXTENSIONS)), "unsupported_format")
    )
    return assets.withColumn("reason", reason)


def dimension_guard(images: DataFrame, max_side: int = MAX_SIDE, max_pixels: int = MAX_PIXELS) -> DataFrame:
    w, h = F.col("width"), F.col("height")
    too_big = (w > max_side) | (h > max_side) | (w.cast("long") * h > max_pixels)
    return images.withColumn("reason", F.when(too_big, "dimensions_exceeded"))


def _inside(v: Column, lo: float, hi: float) -> Column:
    """Finite and within [lo, hi]; null is not inside."""
    d = v.cast("double")
    return F.coalesce(~F.isnan(d) & d.between(float(lo), float(hi)), F.lit(False))


def _above(v: Column, lo: float, hi: float) -> Column:
    return _inside(v, lo, hi) & (v > lo)


def resolve_preset(preset: Column) -> Column:
    name, value = F.lower(trimmed(preset)), F.lit(None).cast("double")
    for key, ratio in _PRESETS.items():
        value = F.when(name == key, F.lit(ratio)).otherwise(value)
    return value


def validate_params(requests: DataFrame, kind: str) -> DataFrame:
    """Fills the defaults of a request table and adds ``reason``."""
    bad = "invalid_parameters"
    if kind == "preprocess":
        rows = requests.withColumns({
            "contrast": F.coalesce("contrast", F.lit(1.0)), "brightness": F.coalesce("brightness", F.lit(0)), "denoise": F.coalesce("denoise", F.lit(0)),
        })
        fine = _inside(F.col("contrast"), 0.5, 3.0) & _inside(F.col("brightness"), -100, 100) & _inside(F.col("denoise"), 0, 10)
    elif kind == "threshold":
        rows = requests.withColumn("value", F.coalesce("value", F.lit(128)))
        fine = _inside(F.col("value"), 0, 255)
    elif kind == "palette":
        rows = requests.withColumns({"tolerance": F.coalesce("tolerance", F.lit(12.0)), "tiny_ratio": F.coalesce("tiny_ratio", F.lit(0.001))})
        limit = F.col("max_colors").isNull() | F.coalesce(F.col("max_colors").between(1, 64), F.lit(False))
        fine = _inside(F.col("tolerance"), 0, 100) & limit & _inside(F.col("tiny_ratio"), 0, 0.5)
    elif kind == "check":
        rows = requests.withColumns({"gap_ratio": F.coalesce("gap_ratio", F.lit(0.005)), "duplicate_ratio": F.coalesce("duplicate_ratio", F.lit(0.002))})
        fine = _above(F.col("gap_ratio"), 0, 0.5) & _above(F.col("duplicate_ratio"), 0, 0.5)
    elif kind == "simplify":
        named = ~is_blank(F.col("preset"))
        rows = requests.withColumn("epsilon", F.when(named, resolve_preset(F.col("preset"))).otherwise(F.col("tolerance")))
        fine = (named != F.col("tolerance").isNotNull()) & _above(F.col("epsilon"), 0, 0.5)
    else:
        raise ValueError(f"unknown request kind {kind}")
    return rows.withColumn("reason", F.when(~fine, bad))


def physical_size(requests: DataFrame, lo: float = 1.0, hi: float = 1000.0) -> DataFrame:
    """Width and height in mm from ``width_mm, height_mm, lock, width_px, height_px``.

    Locked (the default): exactly one is given and the other follows the pixel
    aspect; unlocked: both are given.
    """
    lock = F.coalesce("lock", F.lit(True))
    w, h = F.col("width_mm"), F.col("height_mm")
    count = w.isNotNull().cast("int") + h.isNotNull().cast("int")
    aspect = F.col("width_px") / F.col("height_px").cast("double")
    width = F.when(lock & w.isNull(), h * aspect).otherwise(w)
    height = F.when(lock & h.isNull(), w / aspect).otherwise(h)
    given_ok = (w.isNull() | _inside(w, lo, hi)) & (h.isNull() | _inside(h, lo, hi))
    reason = (
        F.when(lock & (count != 1), "one_side_required").when(~lock & (count != 2), "both_sides_required")
        .when(~given_ok, "invalid_parameters").when(~_inside(width, lo, hi) | ~_inside(height, lo, hi), "dimension_out_of_range")
    )
    return requests.withColumns({"out_width_mm": width, "out_height_mm": height, "reason": reason})


def result_quality(results: DataFrame, max_bytes: int = 10 * 1024 * 1024) -> DataFrame:
    """First broken rule of a produced vector: size, root, dimensions, counts, bounds, content type."""
    finite = F.lit(True)
    for c in ("min_x", "min_y", "max_x", "max_y", "bounds_width", "bounds_height"):
        v = F.col(c).cast("double")
        finite = finite & ~F.isnan(v) & (F.abs(v) < float("inf"))
    reason = (
        F.when(F.octet_length("svg") > max_bytes, "too_large").when(~F.lower("svg").rlike(r"^\s*(<\?xml[^>]*>\s*)?<([\w.-]+:)?svg[\s/>]"), "not_svg")
        .when((F.col("width") <= 0) | (F.col("height") <= 0), "bad_dimensions")
        .when((F.col("path_count") < 0) | (F.col("node_count") < 0), "negative_counts").when(~finite, "bounds_not_finite")
        .when((F.col("max_x") < F.col("min_x")) | (F.col("max_y") < F.col("min_y")), "bounds_reversed")
        .when((F.abs(F.col("max_x") - F.col("min_x") - F.col("bounds_width")) > 0.01) | (F.abs(F.col("max_y") - F.col("min_y") - F.col("bounds_height")) > 0.01), "bounds_size")
        .when(F.lower("content_type") != "image/svg+xml", "content_type")
    )
    return results.withColumn("reason", reason)


def summary_quality(rows: DataFrame, summary: DataFrame, key: str, count: str) -> DataFrame:
    """Summaries whose stated count is not the number of rows."""
    found = rows.groupBy(key).agg(F.count("*").alias("found"))
    return summary.join(found, key, "left").na.fill(0, ["found"]).where(F.col(count) != F.col("found")).select(key, count, "found")


def batch_complete(requested: DataFrame, produced: DataFrame, key: str, item: str) -> DataFrame:
    """All-or-nothing sets: every requested item came back once and nothing else did."""
    keys = [key, item]
    want = requested.groupBy(*keys).agg(F.count("*").alias("w"))
    got = produced.groupBy(*keys).agg(F.count("*").alias("g"))
    both = want.join(got, keys, "full_outer").na.fill(0, ["w", "g"])
    blank = is_blank(F.col(item).cast("string"))
    return both.groupBy(key).agg(
        F.sum("w").alias("requested"), F.sum("g").alias("produced"), F.bool_and((F.col("w") == F.col("g")) & ~blank).alias("complete")
    )


def large_designs(stats: DataFrame, paths: int = 500, nodes: int = 5000, area: int = 4_000_000) -> DataFrame:
    return stats.where((F.col("path_count") > paths) | (F.col("node_count") > nodes) | (F.col("width") * F.col("height") > area))


def export_manifest(requests: DataFrame, histories: dict[str, DataFrame], projects: DataFrame) -> DataFrame:
    """Storage key, content type, version and download name of each request (``kind, source_id``)."""
    from inkgrid.functions.text import parse_enum, safe_file_name

    stored = None
    for kind, rows in histories.items():
        part = rows.select(F.lit(kind).alias("kind"), "source_id", "project_id", "storage_key", "content_type", "version")
        stored = part if stored is None else stored.unionByName(part)
    asked = requests.withColumn("kind", parse_enum(F.col("kind"), list(histories)))
    joined = asked.join(stored, ["kind", "source_id"], "left").join(projects.select("project_id", "file_name"), "project_id", "left")
    name = safe_file_name(F.col("file_name"), F.concat(F.col("kind"), F.lit("-v"), F.col("version").cast("string")))
    reason = F.when(F.col("kind").isNull(), "invalid_parameters").when(F.col("storage_key").isNull(), "not_found")
    return joined.select("request_id", "storage_key", "content_type", "version", F.when(reason.isNull(), name).alias("download_name"), reason.alias("reason"))
