"""Physical pieces and outline checks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgrid.operators.graph import connected_components
from inkgrid.operators.history import numbered
from inkgrid.operators.nesting import nesting
from inkgrid.operators.outlines import open_paths, subpaths, with_node
from inkgrid.operators.pairs import NODE, duplicate_links, outline_key, point_distances, shapes, touch_pairs
from inkgrid.session import cut_lineage

EXACT = 1e-9
_BOX = ["min_x", "min_y", "max_x", "max_y"]
#: Axes along which the extremes of a group's points are taken.
AXES = 16


def _ranked(roots: DataFrame, name: str) -> DataFrame:
    """Numbers the components of each document by their root; only roots are sorted, by ranges."""
    roots = cut_lineage(roots)
    order = numbered(roots.where("id = root").select("doc_id", "root"), ["doc_id"], ["root"], name)
    return roots.join(order.withColumn(name, F.col(name).cast("int")), ["doc_id", "root"])


def component_members(vertices: DataFrame, bounds: DataFrame, touch_ratio: float = 0.001) -> DataFrame:
    """Every outline with its piece: ``component_no``, role, depth and area.

    Holes join the outline directly around them; outlines that touch belong
    together.  Pieces are numbered by their first outline.  ``bounds`` spans the
    whole drawing (``drawing_bounds``).
    """
    vertices = cut_lineage(vertices)
    shaped = cut_lineage(shapes(vertices, either_way=False))
    nested = cut_lineage(nesting(vertices, shaped))
    to_parent = nested.where("depth % 2 = 1 and parent is not null").select("doc_id", F.col("node").alias("src"), F.col("parent").alias("dst"))
    touching = touch_pairs(vertices, bounds, touch_ratio, shaped).select("doc_id", "src", "dst")
    roots = connected_components(nested.select("doc_id", F.col("node").alias("id")), to_parent.unionByName(touching))
    ranked = _ranked(roots, "component_no")
    box = with_node(subpaths(vertices)).select(*NODE, "path_index", "subpath_index", "min_x", "min_y", "max_x", "max_y")
    return nested.join(ranked.withColumnRenamed("id", "node"), NODE).join(box, NODE).select(
        "doc_id", "component_no", "path_index", "subpath_index", "depth",
        F.when(F.col("depth") % 2 == 1, "hole").otherwise("solid").alias("role"), "area", "min_x", "min_y", "max_x", "max_y",
    )


def components(members: DataFrame, bounds: DataFrame, tiny_ratio: float = 0.0005) -> DataFrame:
    """Net area (solids minus holes, not below 0), bounds and the tiny flag of every piece."""
    net = F.greatest(F.sum(F.when(F.col("role") == "hole", -F.col("area")).otherwise(F.col("area"))), F.lit(0.0))
    pieces = members.groupBy("doc_id", "component_no").agg(
        net.alias("area"), F.count("*").alias("members"), *[F.min(f"min_{c}").alias(f"min_{c}") for c in "xy"],
        *[F.max(f"max_{c}").alias(f"max_{c}") for c in "xy"],
    )
    limit = F.col("box_area") * tiny_ratio
    return pieces.join(bounds.select("doc_id", "box_area"), "doc_id").withColumn("is_tiny", F.col("area") <= limit).drop("box_area").withColumn(
        "component_id", F.concat(F.lit("component-"), F.col("component_no").cast("string"))
    )


def component_summary(pieces: DataFrame) -> DataFrame:
    return pieces.groupBy("doc_id").agg(
        F.count("*").alias("component_count"), F.count_if("is_tiny").alias("tiny_component_count"), F.sum("area").alias("total_area")
    )


def group_width(distinct: DataFrame, vertices: DataFrame) -> DataFrame:
    """Largest distance of two shapes of a group (``doc_id, group_no, widest``), without comparing all of them.

    ``distinct``: doc_id, group_no, node, n.  All shapes are turned to the direction of
    the group's first.  Extremes of every point along a fan of axes give a width that
    two shapes surely have; only shapes that may reach beyond it, by the extremes
    against them, are paired, point by point.  Where the pairs found are closer in
    the other direction and fall below that width, all pairs of the group are compared.
    """
    group = ["doc_id", "group_no"]
    heads = distinct.groupBy(*group).agg(F.min("node").alias("head"), F.count("*").alias("k")).where("k > 1")
    rows = distinct.join(heads.drop("k"), group)
    v = with_node(vertices).select(*NODE, "i", "x", "y")
    first = v.select("doc_id", F.col("node").alias("head"), F.col("i").alias("_i"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    points = cut_lineage(rows.join(v, NODE))
    back = (F.col("n") - 1 - F.col("i")).cast("int")
    both_ways = points.withColumn("_w", F.explode(F.array(F.struct(F.lit(0).alias("way"), F.col("i").alias("_i")), F.struct(F.lit(1).alias("way"), back.alias("_i"))))).select(*group, "node", "head", "x", "y", "_w.*")
    ways = both_ways.join(first, ["doc_id", "head", "_i"]).groupBy(*group, "node", "way").agg(F.max(F.hypot(F.col("x") - F.col("_x"), F.col("y") - F.col("_y"))).alias("d"))
    turned = ways.groupBy(*group, "node").agg(F.min(F.struct("d", "way")).alias("b")).select(*group, "node", F.col("b.way").alias("way"))
    aligned = points.join(turned, [*group, "node"]).select(*group, "node", "n", F.when(F.col("way") == 1, back).otherwise(F.col("i")).alias("i"), "x", "y")
    axes = [(math.cos(math.pi * k / AXES), math.sin(math.pi * k / AXES)) for k in range(AXES)]

    def along(k: int) -> Column:
        return F.col("x") * axes[k][0] + F.col("y") * axes[k][1]

    aligned = cut_lineage(aligned)
    spans = cut_lineage(aligned.groupBy(*group, "i").agg(*[f(along(k)).alias(f"{n}{k}") for k in range(AXES) for n, f in (("lo", F.min), ("hi", F.max))]))
    # two shapes are at least so far apart in the direction all are turned to
    sure = spans.groupBy(*group).agg(F.max(F.greatest(*[F.col(f"hi{k}") - F.col(f"lo{k}") for k in range(AXES)])).alias("sure"))
    sure = sure.withColumn("sure", F.col("sure") * (1 - 1e-9) - 1e-12)
    reach = F.greatest(*[e for k in range(AXES) for e in (F.col(f"hi{k}") - along(k), along(k) - F.col(f"lo{k}"))]) / math.cos(math.pi / (2 * AXES))
    outer = cut_lineage(aligned.join(spans, [*group, "i"]).join(sure, group).where(reach >= F.col("sure")).select(*group, "i", "node", "n", "x", "y", "sure"))
    a, b = outer.withColumnsRenamed({"node": "src", "x": "ax", "y": "ay"}), outer.select(*group, "i", F.col("node").alias("dst"), F.col("x").alias("bx"), F.col("y").alias("by"))
    wide = a.join(b, [*group, "i"]).where((F.col("src") < F.col("dst")) & (F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")) >= F.col("sure")))
    pairs = wide.select(*group, "src", "dst", "n").distinct()

    def measured(pairs: DataFrame) -> DataFrame:
        pairs = cut_lineage(pairs)
        return pairs.join(point_distances(pairs.drop("group_no"), vertices), ["doc_id", "src", "dst"]).groupBy(*group).agg(F.max("distance").alias("widest"))

    found = cut_lineage(heads.select(*group).join(sure, group).join(measured(pairs), group, "left"))
    unsure = found.where("widest is null or widest < sure")
    if unsure.isEmpty():
        return found.select(*group, "widest")
    left = distinct.join(unsure.select(*group), group, "left_semi")
    ends = [left.select(*group, F.col("node").alias("src"), "n"), left.select(*group, F.col("node").alias("dst"))]
    opened = measured(ends[0].join(ends[1], group).where("src < dst"))
    return found.where("widest >= sure").select(*group, "widest").unionByName(opened)


def duplicate_groups(vertices: DataFrame, bounds: DataFrame, ratio: float = 0.002) -> tuple[DataFrame, DataFrame]:
    """Groups of duplicates (``id``, members, largest distance, exact, bounds) and their member rows."""
    vertices = cut_lineage(vertices)
    shaped = cut_lineage(shapes(vertices))
    edges = cut_lineage(duplicate_links(vertices, bounds, ratio, shaped))
    ends = edges.select("doc_id", F.explode(F.array("src", "dst")).alias("id")).distinct()
    roots = connected_components(ends, edges)
    members = cut_lineage(_ranked(roots, "group_no").withColumnRenamed("id", "node"))
    # copies are at distance 0, so only the distinct shapes of a group are compared
    distinct = cut_lineage(members.join(shaped.where("node = shape").select(*NODE, "n"), NODE))
    widest = group_width(distinct, vertices)
    box = with_node(subpaths(vertices)).select(*NODE, *_BOX)
    sizes = members.join(box, NODE).groupBy("doc_id", "group_no").agg(
        F.count("*").alias("members"), *[F.min(c).alias(c) for c in _BOX[:2]], *[F.max(c).alias(c) for c in _BOX[2:]]
    )
    worst = F.coalesce("widest", F.lit(0.0))
    groups = sizes.join(widest, ["doc_id", "group_no"], "left").select(
        "doc_id", "group_no", F.concat(F.lit("dup-"), F.col("group_no").cast("string")).alias("id"), "members",
        worst.alias("max_point_distance"), (worst <= EXACT).alias("exact"),
        F.when(worst <= EXACT, "error").otherwise("warning").alias("severity"), *_BOX,
    )
    return groups, outline_key(members, "node").select("doc_id", "group_no", "path_index", "subpath_index")


def all_issues(open_rows: DataFrame, groups: DataFrame) -> DataFrame:
    """One issue table: open outlines first, then duplicate groups, numbered per document.

    Open outlines carry their end points, duplicates their distance and number of
    members, both their bounds; which outlines belong to a group is a table of its own.
    """
    first = open_rows.select(
        "doc_id", "id", "type", "severity", "path_index", "subpath_index", "first_point", "last_point", "gap_distance", *_BOX, F.lit(0).alias("_kind")
    )
    second = groups.select(
        "doc_id", "id", F.lit("duplicate_path").alias("type"), "severity", "exact", "max_point_distance", "members", *_BOX,
        "group_no", F.lit(1).alias("_kind"),
    )
    both = first.unionByName(second, allowMissingColumns=True)
    order = ["_kind", "path_index", "subpath_index", "group_no"]
    return numbered(cut_lineage(both), ["doc_id"], order, "ordinal").withColumn("ordinal", F.col("ordinal").cast("int")).drop("_kind", "group_no")


def check(vertices: DataFrame, bounds: DataFrame, gap_ratio: float = 0.005, duplicate_ratio: float = 0.002) -> tuple[DataFrame, DataFrame]:
    """The issues of every document, and the outlines of each duplicate group (``doc_id, id, path_index, subpath_index``).

    Tolerances are shares of the drawing's diagonal: ``bounds`` covers all paths (``drawing_bounds``).
    """
    groups, members = duplicate_groups(vertices, bounds, duplicate_ratio)
    named = members.select("doc_id", F.concat(F.lit("dup-"), F.col("group_no").cast("string")).alias("id"), "path_index", "subpath_index")
    return all_issues(open_paths(vertices, bounds, gap_ratio), groups), named


def check_summary(issues: DataFrame, skipped: DataFrame) -> DataFrame:
    counts = issues.groupBy("doc_id").agg(
        F.count_if(F.col("type") == "open_path").alias("open_paths"), F.count_if(F.col("type") == "duplicate_path").alias("duplicate_groups")
    )
    return skipped.join(counts, "doc_id", "left").select(
        "doc_id", F.coalesce("open_paths", F.lit(0)).alias("open_paths"),
        F.coalesce("duplicate_groups", F.lit(0)).alias("duplicate_groups"), "skipped_path_count",
    )
