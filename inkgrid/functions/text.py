"""Names, keys, numbers and enumerations as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Device names no file may have.
_DEVICES = "(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])$"
_LONGEST_BASE = 80


def trimmed(value: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def blank(value: Column) -> Column:
    return F.coalesce(trimmed(value), F.lit("")) == ""


def finite_number(value: Column) -> Column:
    """A double written in digits; null for suffixes, words such as Infinity, and what overflows."""
    number = F.when(trimmed(value).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), trimmed(value)).try_cast("double")
    return F.when(F.abs(number) < float("inf"), number)


def safe_base_name(name: Column) -> Column:
    """Download-safe base name: no folders, extension, control or reserved characters."""
    last = F.regexp_replace(name, r"(?s)^.*[/\\]", "")
    stem = F.regexp_replace(last, r"(?s)(?<=.)\.[^.]*$", "")
    plain = F.regexp_replace(stem, r'[\x00-\x1f\x7f-\x9f<>:"/\\|?*]', "_")
    # one leading and trailing trim of blanks, then of dots and blanks
    core = F.regexp_replace(trimmed(plain), r"^[. ]+|[. ]+$", "")
    short = F.when(
        F.length(core) > _LONGEST_BASE, F.regexp_replace(F.substring(core, 1, _LONGEST_BASE), r"[. _]+$", "")
    ).otherwise(core)
    named = F.when(short.rlike(_DEVICES), F.concat(F.lit("_"), short)).otherwise(short)
    return F.when(name.isNull() | (F.coalesce(named, F.lit("")).rlike(r"(?U)^\s*$")), "export").otherwise(named)


def safe_file_name(name: Column, suffix: Column) -> Column:
    part = F.coalesce(F.nullif(trimmed(suffix), F.lit("")), F.lit("export"))
    return F.concat(safe_base_name(name), F.lit("-"), part, F.lit(".svg"))


def _fixed6(v: Column) -> Column:
    return F.format_string("%.6f", v.cast("double"))


def _plain(v: Column) -> Column:
    """A number without trailing zeros."""
    text = F.format_string("%.3f", v.cast("double"))
    return F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")


def preprocess_key(gray: Column, contrast: Column, brightness: Column, denoise: Column) -> Column:
    rounded = F.bround(contrast, 3)
    return F.concat(
        F.lit("gs="), F.initcap(gray.cast("string")), F.lit("|c="), _plain(rounded), F.lit("|b="), brightness.cast("string"),
        F.lit("|d="), denoise.cast("string"),
    )


def threshold_key(value: Column, invert: Column) -> Column:
    return F.concat(F.lit("v="), value.cast("string"), F.lit("|inv="), F.initcap(invert.cast("string")))


def palette_key(tolerance: Column, max_colors: Column, tiny_ratio: Column) -> Column:
    return F.concat(
        F.lit("tolerance="), _fixed6(tolerance), F.lit(";maxColors="), F.coalesce(max_colors.cast("string"), F.lit("none")),
        F.lit(";tinyAreaRatio="), _fixed6(tiny_ratio),
    )


def simplification_key(epsilon: Column) -> Column:
    return F.concat(F.lit("epsilon="), _fixed6(epsilon))


def vector_key() -> Column:
    """The vector stage has no settings yet; the key is a fixed value."""
    return F.lit("engine=vtracer")


def dimension_key(width: Column, height: Column, lock: Column) -> Column:
    return F.concat(
        F.lit("width="), _fixed6(width), F.lit("|height="), _fixed6(height), F.lit("|lock="), F.initcap(lock.cast("string"))
    )


def format_mm(v: Column) -> Column:
    """Up to three decimals without trailing zeros, then ``mm``."""
    return F.concat(_plain(v), F.lit("mm"))


def parse_mm(text: Column) -> Column:
    return finite_number(text)


def parse_enum(text: Column, allowed: list[str]) -> Column:
    """Trimmed, case-insensitive member of ``allowed``; null for anything else."""
    value = F.lower(trimmed(text))
    return F.when(value.isin(allowed), value)


def json_string_array(text: Column) -> Column:
    """A JSON array of non-empty strings, else null."""
    items = F.from_json(text, "array<string>")
    quoted = text.rlike(r'^\s*\[\s*("(?:[^"\\]|\\.)*"\s*(,\s*"(?:[^"\\]|\\.)*"\s*)*)?\]\s*$')
    return F.when(quoted & items.isNotNull() & F.forall(items, lambda s: F.length(s) > 0), items)


# File extension by content type.
EXTENSIONS = {"image/png": ".png", "image/jpeg": ".jpg", "image/webp": ".webp", "image/svg+xml": ".svg"}


def mime_extension(mime: Column) -> Column:
    table = F.create_map(*[F.lit(v) for pair in EXTENSIONS.items() for v in pair])
    return F.try_element_at(table, F.lower(trimmed(mime)))


def asset_key(project: Column, kind: Column, asset: Column, mime: Column) -> Column:
    return F.concat(
        F.lit("projects/"), project.cast("string"), F.lit("/"), kind, F.lit("/"), asset.cast("string"), mime_extension(mime)
    )
