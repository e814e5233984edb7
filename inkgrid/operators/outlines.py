"""Outlines as vertex tables: edges, areas, bounds, open ends, inward points.

Vertices: ``doc_id, path_index, subpath_index, closed, i, x, y``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgrid.functions.geometry import crosses_right
from inkgrid.operators.svg import KEY
from inkgrid.session import cut_lineage, shuffled

MAX_SUBPATHS = 20_000
_CHUNK = 4096


def node_id(path: Column, sub: Column) -> Column:
    """One LONG per subpath that sorts in document order."""
    return F.shiftleft(path.cast("long"), 32) + sub.cast("long")


def with_node(df: DataFrame) -> DataFrame:
    return df.withColumn("node", node_id(F.col("path_index"), F.col("subpath_index")))


def subpaths(vertices: DataFrame) -> DataFrame:
    """One row per subpath: closed, number of points, bounds, first and last point."""
    point = F.struct("x", "y")
    return vertices.groupBy(*KEY).agg(
        F.first("closed").alias("closed"), F.count("*").cast("int").alias("n_points"),
        *[F.min(c).alias(f"min_{c}") for c in "xy"], *[F.max(c).alias(f"max_{c}") for c in "xy"],
        F.min_by(point, "i").alias("first_point"), F.max_by(point, "i").alias("last_point"),
    )


def subpath_bounds(vertices: DataFrame) -> DataFrame:
    return subpaths(vertices).select(*KEY, "min_x", "min_y", "max_x", "max_y")


def document_bounds(vertices: DataFrame) -> DataFrame:
    """Bounds, diagonal and area of everything drawn in a document."""
    box = vertices.groupBy("doc_id").agg(
        *[F.min(c).alias(f"min_{c}") for c in "xy"], *[F.max(c).alias(f"max_{c}") for c in "xy"]
    )
    w, h = F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")
    return box.select("doc_id", F.hypot(w, h).alias("diagonal"), (w * h).alias("box_area"))


def drawing_bounds(stats: DataFrame) -> DataFrame:
    """The same from document statistics (``svg_stats``), which cover curves and paths that are not analysed."""
    w, h = F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")
    return stats.select("doc_id", F.hypot(w, h).alias("diagonal"), (w * h).alias("box_area"))


def edges(vertices: DataFrame) -> DataFrame:
    """Consecutive vertices as ``i, x1, y1, x2, y2, closing``; the closing edge is always given.

    Long outlines are cut into chunks (the first vertex of a chunk is repeated
    in the one before), so one huge outline is not sorted in a single task.
    """
    chunk = F.floor(F.col("i") / _CHUNK)
    both = F.when((F.col("i") % _CHUNK == 0) & (F.col("i") > 0), F.array(chunk, chunk - 1)).otherwise(F.array(chunk))
    line = Window.partitionBy(*KEY, "_chunk").orderBy("i")
    forward = vertices.withColumn("_chunk", F.explode(both)).select(
        *KEY, "closed", "i", F.col("x").alias("x1"), F.col("y").alias("y1"),
        F.lead("x").over(line).alias("x2"), F.lead("y").over(line).alias("y2"), F.lit(False).alias("closing"),
    ).where("x2 is not null")
    ring = subpaths(vertices).where("n_points >= 2").select(
        *KEY, "closed", (F.col("n_points") - 1).alias("i"), F.col("last_point.x").alias("x1"), F.col("last_point.y").alias("y1"),
        F.col("first_point.x").alias("x2"), F.col("first_point.y").alias("y2"), F.lit(True).alias("closing"),
    )
    return forward.unionByName(ring)


def drawn_edges(vertices: DataFrame) -> DataFrame:
    """Edges a pen would draw: the closing one only for closed outlines."""
    return edges(vertices).where("closed or not closing")


def polygon_area(vertices: DataFrame) -> DataFrame:
    """Absolute shoelace area; outlines with fewer than three points have none."""
    cross = F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1"))
    summed = edges(vertices).groupBy(*KEY).agg(
        F.when(F.count("*") >= 3, F.abs(cross) / 2.0).otherwise(F.lit(0.0)).alias("area")
    )
    return vertices.select(*KEY).distinct().join(summed, KEY, "left").na.fill(0.0, ["area"])


def open_paths(vertices: DataFrame, bounds: DataFrame, ratio: float = 0.005) -> DataFrame:
    """Open outlines whose ends almost meet: at least three points, gap within the tolerance.

    ``bounds`` (``doc_id, diagonal``) spans the whole drawing, curves and skipped paths
    included: ``drawing_bounds``, or ``document_bounds`` where vertices are all there is.
    """
    diagonal = shuffled(bounds.select("doc_id", "diagonal"))
    gap = F.hypot(F.col("first_point.x") - F.col("last_point.x"), F.col("first_point.y") - F.col("last_point.y"))
    return (
        subpaths(vertices).where("not closed and n_points >= 3").join(diagonal, "doc_id")
        .withColumn("gap_distance", gap).where((F.col("diagonal") > 0) & (F.col("gap_distance") <= F.col("diagonal") * ratio))
        .select(
            "doc_id", F.concat_ws("-", F.lit("open"), F.col("path_index").cast("string"), F.col("subpath_index").cast("string")).alias("id"),
            F.lit("open_path").alias("type"), F.lit("error").alias("severity"), "path_index", "subpath_index",
            "first_point", "last_point", "gap_distance", "min_x", "min_y", "max_x", "max_y",
        )
    )


def subpath_guard(vertices: DataFrame, limit: int = MAX_SUBPATHS) -> DataFrame:
    """Documents with more analysable subpaths than the limit, with the reason: a filter for callers who want one; no operator applies it."""
    counts = vertices.where("i = 0").groupBy("doc_id").agg(F.count("*").alias("n_subpaths"))
    return counts.where(F.col("n_subpaths") > limit).select("doc_id", "n_subpaths", F.lit("too_many_subpaths").alias("reason"))


# ------------------------------------------------------------- point location

def inward_points(vertices: DataFrame) -> DataFrame:
    """A point inside each outline of three or more points (``px, py``).

    It is the midpoint of the first edge, in order, that can be nudged inside;
    the normal side is tried before the other; the vertex mean is the last
    resort.  Almost every outline is settled by its first edge, so edges are
    tried in batches of growing size, each batch only for what is left.
    """
    ring = with_node(edges(vertices)).withColumn(
        "length", F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    )
    sizes = with_node(vertices).groupBy("doc_id", "node").agg(
        F.count("*").alias("n"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y")
    ).where("n >= 3")
    ring = cut_lineage(ring.join(sizes.select("doc_id", "node"), ["doc_id", "node"], "left_semi").select(
        "doc_id", "node", "i", "x1", "y1", "x2", "y2", "length"
    ))
    usable = ring.where("length > 1e-9")
    left, found, low, high = sizes.select("doc_id", "node"), None, 0, 1
    while True:
        tried = usable.join(left, ["doc_id", "node"], "left_semi").where(F.col("i").between(low, high - 1))
        nx, ny = -(F.col("y2") - F.col("y1")) / F.col("length"), (F.col("x2") - F.col("x1")) / F.col("length")
        nudge = F.col("length") * 1e-3
        mid_x, mid_y = (F.col("x1") + F.col("x2")) / 2.0, (F.col("y1") + F.col("y2")) / 2.0
        spots = tried.select("doc_id", "node", F.explode(F.array(*[
            F.struct(
                (F.col("i") * 2 + k).alias("rank"), (mid_x + nx * nudge * s).alias("px"), (mid_y + ny * nudge * s).alias("py")
            ) for k, s in ((0, 1.0), (1, -1.0))
        ])).alias("s")).select("doc_id", "node", "s.*")
        hits = crosses_right((F.col("px"), F.col("py")), (F.col("x1"), F.col("y1")), (F.col("x2"), F.col("y2")))
        inside = spots.join(ring, ["doc_id", "node"]).groupBy("doc_id", "node", "rank", "px", "py").agg(
            F.count_if(hits).alias("hits")
        ).where("hits % 2 = 1")
        best = cut_lineage(inside.groupBy("doc_id", "node").agg(F.min(F.struct("rank", "px", "py")).alias("p")).select(
            "doc_id", "node", "p.px", "p.py"
        ))
        found = best if found is None else found.unionByName(best)
        left = cut_lineage(left.join(best, ["doc_id", "node"], "left_anti"))
        if usable.join(left, ["doc_id", "node"], "left_semi").where(F.col("i") >= high).isEmpty():
            break
        low, high = high, high * 4
    mean = sizes.join(left, ["doc_id", "node"], "left_semi").select(
        "doc_id", "node", F.col("mean_x").alias("px"), F.col("mean_y").alias("py")
    )
    return found.unionByName(mean)
