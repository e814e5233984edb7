"""Reading SVG text with column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkgrid.functions.geometry import NUMBER
from inkgrid.functions.text import finite_number, trimmed

_COMMANDS = "MLHVCSQTAZmlhvcsqtaz"
PATH_TAG = r"(?i)<(?:[\w.-]+:)?path(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"


def without_comments(svg: Column) -> Column:
    return F.regexp_replace(svg, r"(?s)<!--.*?-->", "")


def attribute(tag: Column, name: str) -> Column:
    """Attribute value of a tag text; null when absent."""
    hit = F.regexp_extract_all(tag, F.lit(rf"\s{name}\s*=\s*(\"[^\"]*\"|'[^']*')"))
    raw = F.try_element_at(hit, F.lit(1))
    return F.substring(raw, F.lit(2), F.length(raw) - 2)


def numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(f"({NUMBER})")), lambda n: n.cast("double"))


def path_tokens(d: Column) -> Column:
    """Commands of path data: array of (command, numbers)."""
    parts = F.regexp_extract_all(d, F.lit(f"([{_COMMANDS}][^{_COMMANDS}]*)"))
    return F.transform(parts, lambda p: F.struct(
        F.substring(p, 1, 1).alias("command"), numbers(F.substring(p, 2, 2147483647)).alias("numbers")
    ))


def is_supported_path(d: Column) -> Column:
    """At least one command, and none but upper-case M, L and Z."""
    return d.rlike("[MLZ]") & ~d.rlike("[HVCSQTAmlhvcsqtaz]")


def parse_translate(transform: Column) -> Column:
    """(tx, ty) of an empty transform or a lone ``translate``; null for anything else."""
    text = trimmed(F.coalesce(transform, F.lit("")))
    pattern = rf"^translate\(\s*({NUMBER})(?:[\s,]+({NUMBER}))?\s*\)$"

    def part(group: int) -> Column:
        return F.coalesce(F.regexp_extract(text, pattern, group).try_cast("double"), F.lit(0.0))

    found = F.struct(part(1).alias("tx"), part(2).alias("ty"))
    zero = F.struct(F.lit(0.0).alias("tx"), F.lit(0.0).alias("ty"))
    return F.when(text == "", zero).when(text.rlike(pattern), found)


def translate_lenient(transform: Column) -> Column:
    """Statistics take the first ``translate(`` with a separator anywhere, else no shift."""
    # First the arguments of a call that is written as one or two decimals after which a separator stands, then the decimals in them.
    decimal = r"[-+]?(?:\d*\.)?\d+"
    call = F.regexp_extract(F.coalesce(transform, F.lit("")), rf"translate\((\s*{decimal}\s*[ ,]\s*(?:{decimal}\s*)?)\)", 1)
    found = F.transform(F.regexp_extract_all(call, F.lit(f"({decimal})")), lambda n: n.try_cast("double"))

    def part(at: int) -> Column:
        return F.coalesce(F.get(found, F.lit(at)), F.lit(0.0))

    return F.struct(part(0).alias("tx"), part(1).alias("ty"))


def local_name(tag: Column) -> Column:
    return F.lower(F.element_at(F.split(tag, "}"), -1))


def _pairs(values: Column) -> Column:
    """Consecutive numbers as points; an odd last number is dropped."""
    count = F.floor(F.size(values) / 2).cast("int")
    points = F.transform(F.sequence(F.lit(1), count), lambda k: F.struct(
        F.element_at(values, k * 2 - 1).alias("x"), F.element_at(values, k * 2).alias("y")
    ))
    return F.when(count >= 1, points).otherwise(F.array().cast("array<struct<x:double,y:double>>"))


def extract_subpaths(d: Column) -> Column:
    """Subpaths of supported path data: array of (closed, points), empty ones left out.

    The text before the first M may already hold points; every M starts anew.
    """
    pieces = F.concat(
        F.array(F.regexp_extract(d, r"^([^M]*)", 1)), F.regexp_extract_all(d, F.lit("(M[^M]*)"))
    )

    def subpath(piece: Column) -> Column:
        runs = F.regexp_extract_all(piece, F.lit("[ML]([^MLZ]*)"), F.lit(1))
        return F.struct(piece.contains("Z").alias("closed"), F.flatten(F.transform(runs, lambda r: _pairs(numbers(r)))).alias("points"))

    return F.filter(F.transform(pieces, subpath), lambda s: F.size(s["points"]) > 0)


def root_tag(svg: Column) -> Column:
    return F.regexp_extract(svg, r"(?i)(<(?:[\w.-]+:)?svg(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>)", 1)


def canvas_size(svg: Column) -> Column:
    """Rounded width and height of the root; both 0 when either is missing or no number."""
    tag = root_tag(svg)
    w, h = (finite_number(F.coalesce(attribute(tag, n), F.lit("0"))) for n in ("width", "height"))
    bad = w.isNull() | h.isNull() | (tag == "")

    def side(v: Column) -> Column:
        return F.when(bad, 0).otherwise(F.coalesce(F.bround(v, 0).try_cast("int"), F.lit(0)))

    return F.struct(side(w).alias("width"), side(h).alias("height"))


def parse_viewbox(text: Column) -> Column:
    parts = F.split(trimmed(text), r"\s+")
    names = ("min_x", "min_y", "width", "height")
    return F.struct(*[F.try_element_at(parts, F.lit(i + 1)).try_cast("double").alias(n) for i, n in enumerate(names)])


def point_text(x: Column, y: Column) -> Column:
    return F.format_string("%.3f,%.3f", x, y)
