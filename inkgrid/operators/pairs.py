"""Pair operators on outlines: copies, near copies, touching, distances.

Exact copies are folded into one shape first.  A document in which a third of
the outlines are copies of one drawing then costs one outline in every pair
join, and the copies come back as a star of edges to their first member.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgrid.functions import geometry
from inkgrid.operators.graph import connected_components
from inkgrid.operators.grid import overlapping_boxes
from inkgrid.operators.outlines import drawn_edges, with_node
from inkgrid.session import cut_lineage, shuffled

NODE = ["doc_id", "node"]
_BOX = ["min_x", "min_y", "max_x", "max_y"]
#: Outlines that can be near copies lie in the same or a neighbouring cell.
_CELL = ["doc_id", "closed", "n", "cx", "cy"]
#: A cell with more distinct shapes than this is thinned out by pivots, about so many per round.
CROWD, PIVOTS = 64, 8
#: Members of a shape under one key when all pairs of its copies are listed.
BLOCK = 1024


def shapes(vertices: DataFrame, either_way: bool = True) -> DataFrame:
    """``doc_id, node, shape``: shape is the first outline with the same points, in either direction or only in the same one.

    An outline drawn backwards has another first edge, and so an inward point of its
    own: containment needs ``either_way=False``.

    Two 64-bit sums over the points, once per direction, identify a sequence;
    they are partial aggregates, so no outline is gathered anywhere.
    """
    v = shuffled(with_node(vertices))
    n = v.groupBy(*NODE).agg(F.count("*").alias("n"))
    rows = v.join(n, NODE)
    back = F.col("n") - 1 - F.col("i")

    def mark(position: Column, salt: int) -> Column:
        return F.bit_xor(F.xxhash64(position.cast("long"), F.col("x"), F.col("y"), F.lit(salt)))

    marks = rows.groupBy(*NODE).agg(
        F.first("closed").alias("closed"), F.first("n").alias("n"),
        F.struct(mark(F.col("i"), 1), mark(F.col("i"), 2)).alias("fore"), F.struct(mark(back, 1), mark(back, 2)).alias("aft"),
    ).select(*NODE, "closed", "n", (F.least("fore", "aft") if either_way else F.col("fore")).alias("mark"))
    same = ["doc_id", "closed", "n", "mark"]
    first = marks.groupBy(*same).agg(F.min("node").alias("shape"), F.count("*").alias("copies"))
    return marks.join(shuffled(first), same).select(*NODE, "shape", "copies", "closed", "n")


def shape_members(vertices: DataFrame, shaped: DataFrame) -> DataFrame:
    """The vertices of the first outline of every shape."""
    firsts = shaped.where("node = shape").select(*NODE)
    return with_node(vertices).join(shuffled(firsts), NODE, "left_semi").drop("node")


def copy_edges(shaped: DataFrame) -> DataFrame:
    return shaped.where("node <> shape").select("doc_id", F.col("shape").alias("src"), F.col("node").alias("dst"))


def member_pairs(shape_pairs: DataFrame, shaped: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs of shapes (``src, dst, distance``) as pairs of all their outlines, and all pairs of copies of one shape (distance 0), ``src < dst``.

    Shapes of many copies are cut into blocks of about ``block``, and two blocks meet under one key.
    """
    cuts = F.greatest(F.ceil(F.col("copies") / block), F.lit(1))
    members = shaped.select("doc_id", "shape", "node", F.pmod(F.xxhash64("node"), cuts).alias("block"))
    sizes = shaped.where("node = shape").select("doc_id", "node", "copies", cuts.alias("cuts"))
    own = sizes.where("copies > 1").select("doc_id", F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0.0).alias("distance"), F.col("cuts").alias("ka"), F.col("cuts").alias("kb"))
    ends = [shuffled(sizes.select("doc_id", F.col("node").alias(e), F.col("cuts").alias(f"k{e}"))) for e in "ab"]
    other = shape_pairs.select("doc_id", F.col("src").alias("a"), F.col("dst").alias("b"), "distance").join(ends[0], ["doc_id", "a"]).join(ends[1], ["doc_id", "b"])
    blocks = other.unionByName(own).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ka") - 1)))
    first = F.when(F.col("a") == F.col("b"), F.col("i")).otherwise(F.lit(0))
    blocks = blocks.withColumn("j", F.explode(F.sequence(first.cast("long"), F.col("kb") - 1))).drop("ka", "kb")
    left, right = (shuffled(members.select("doc_id", F.col("shape").alias(e), F.col("block").alias(at), F.col("node").alias(f"_{e}"))) for e, at in (("a", "i"), ("b", "j")))
    met = blocks.join(left, ["doc_id", "a", "i"]).join(right, ["doc_id", "b", "j"]).where("a <> b or i <> j or _a < _b")
    return met.select("doc_id", F.least("_a", "_b").alias("src"), F.greatest("_a", "_b").alias("dst"), "distance")


def _tolerance(bounds: DataFrame, ratio: float) -> DataFrame:
    return bounds.where("diagonal > 0").select("doc_id", (F.col("diagonal") * ratio).alias("tolerance"))


def point_distances(pairs: DataFrame, vertices: DataFrame) -> DataFrame:
    """Largest distance of corresponding points of ``src`` and ``dst``, in the better direction."""
    v = shuffled(with_node(vertices).select(*NODE, "i", "x", "y"))
    a = pairs.join(v.withColumnsRenamed({"node": "src", "x": "ax", "y": "ay"}), ["doc_id", "src"])
    b = v.withColumnsRenamed({"node": "dst", "i": "j", "x": "bx", "y": "by"})
    ways = a.withColumn("w", F.explode(F.array(
        F.struct(F.lit(0).alias("way"), F.col("i").alias("j")),
        F.struct(F.lit(1).alias("way"), (F.col("n") - 1 - F.col("i")).cast("int").alias("j")),
    ))).select("doc_id", "src", "dst", "ax", "ay", "w.way", "w.j")
    gap = F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))
    per_way = ways.join(b, ["doc_id", "dst", "j"]).groupBy("doc_id", "src", "dst", "way").agg(F.max(gap).alias("distance"))
    return per_way.groupBy("doc_id", "src", "dst").agg(F.min("distance").alias("distance"))


def duplicate_pairs(vertices: DataFrame, bounds: DataFrame, ratio: float = 0.002, shaped: DataFrame | None = None, every: bool = False) -> DataFrame:
    """Edges between duplicates: every copy with its first, and near copies among distinct shapes.

    Copies come as a star around their first outline instead of all pairs; the groups are
    the same.  ``every``: all pairs of outlines within the tolerance, copies included.
    """
    shaped = shapes(vertices) if shaped is None else shaped
    shaped = cut_lineage(shaped) if every else shaped
    tolerance = cut_lineage(_tolerance(bounds, ratio))
    cand = _filed_by_corner(vertices, tolerance, shaped)
    pairs = _meeting(cand, F.col("tolerance"))
    close = point_distances(pairs, vertices).join(tolerance, "doc_id").where("distance <= tolerance").drop("tolerance")
    if every:
        return member_pairs(cut_lineage(close), shaped.join(tolerance, "doc_id", "left_semi"))
    copies = copy_edges(shaped).join(tolerance, "doc_id", "left_semi").withColumn("distance", F.lit(0.0))
    return copies.unionByName(close)


def _filed_by_corner(vertices: DataFrame, tolerance: DataFrame, shaped: DataFrame) -> DataFrame:
    """The distinct shapes with bounds, tolerance and the cell of their lower corner (cells are as wide as the tolerance)."""
    corners = shuffled(with_node(vertices)).groupBy(*NODE).agg(
        *[F.min(c).alias(f"min_{c}") for c in "xy"], *[F.max(c).alias(f"max_{c}") for c in "xy"]
    )
    cand = shaped.where("node = shape").select(*NODE, "closed", "n").join(corners, NODE).join(tolerance, "doc_id")
    size = F.greatest(F.col("tolerance"), F.lit(1e-9))
    return cand.withColumns({"cx": F.floor(F.col("min_x") / size), "cy": F.floor(F.col("min_y") / size)})


def _meeting(cand: DataFrame, reach: Column, reach_cells: int = 1) -> DataFrame:
    """Pairs of filed shapes (``doc_id, src, dst, n``) whose bounds differ by at most ``reach``, which spans ``reach_cells`` cells."""
    steps = range(-reach_cells, reach_cells + 1)
    around = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in steps for dy in steps])
    probe = cand.withColumn("o", F.explode(around)).select(
        "doc_id", "closed", "n", (F.col("cx") + F.col("o.dx")).alias("cx"), (F.col("cy") + F.col("o.dy")).alias("cy"),
        F.col("node").alias("dst"), *[F.col(c).alias(f"b_{c}") for c in _BOX],
    )
    slack = reach * 1.000001 + 1e-12
    near = F.col("src") < F.col("dst")
    for c in _BOX:
        near = near & (F.abs(F.col(c) - F.col(f"b_{c}")) <= slack)
    return cand.withColumnRenamed("node", "src").join(shuffled(probe), _CELL).where(near).select("doc_id", "src", "dst", "n")


def _cores(cand: DataFrame, vertices: DataFrame, crowd: int) -> DataFrame:
    """Shapes of crowded cells with the pivot ``core`` they are within half the tolerance of, and their distance ``off`` to it.

    Two shapes around one pivot are within the tolerance of each other (the distance
    of outlines, in the better direction, obeys the triangle inequality).  Every round
    takes a few pivots of each crowded cell by hash; a cell that a round does not thin
    out by a quarter is left.  Shapes without a pivot are cores of their own.
    """
    live = cand.select(*_CELL, "node", "tolerance")
    cells = live.groupBy(*_CELL).agg(F.count("*").alias("k"))
    found, rounds = None, 0
    while True:
        crowded = cut_lineage(cells.where(F.col("k") > crowd))
        if crowded.isEmpty():
            break
        rounds += 1
        inside = cut_lineage(live.join(crowded, _CELL))
        place = F.pmod(F.xxhash64("node", F.lit(rounds)), F.greatest(F.floor(F.col("k") / PIVOTS), F.lit(1)))
        pivots = inside.where((place == 0)).select(*_CELL, F.col("node").alias("core"))
        tries = inside.join(pivots, _CELL).where("node <> core").select("doc_id", F.col("core").alias("src"), F.col("node").alias("dst"), "n", "tolerance")
        tight = point_distances(tries.drop("tolerance"), vertices).join(tries.select("doc_id", "src", "dst", "tolerance"), ["doc_id", "src", "dst"])
        taken = tight.where("distance <= tolerance * 0.4999999").select("doc_id", F.col("dst").alias("node"), F.col("src").alias("core"), F.col("distance").alias("off"))
        # a pivot near another pivot of a smaller id follows it only if that one stays a pivot, so pivots stay with themselves
        own = pivots.select("doc_id", F.col("core").alias("node"), "core", F.lit(0.0).alias("off"))
        others = taken.join(own.select(*NODE), NODE, "left_anti").groupBy(*NODE).agg(F.min(F.struct("off", "core")).alias("b")).select(*NODE, "b.core", "b.off")
        step = cut_lineage(own.unionByName(others))
        found = step if found is None else found.unionByName(step)
        live = cut_lineage(live.join(step.select(*NODE), NODE, "left_anti"))
        left = live.groupBy(*_CELL).agg(F.count("*").alias("_left"))
        cells = crowded.join(left, _CELL).where(F.col("_left") * 4 <= F.col("k") * 3).select(*_CELL, F.col("_left").alias("k"))
    alone = live.select(*NODE, F.col("node").alias("core"), F.lit(0.0).alias("off"))
    return alone if found is None else alone.unionByName(found)


def duplicate_links(vertices: DataFrame, bounds: DataFrame, ratio: float = 0.002, shaped: DataFrame | None = None, crowd: int = CROWD) -> DataFrame:
    """Enough edges between duplicates to join every group that :func:`duplicate_pairs` joins, and no others.

    Many near copies in one spot are stars around pivots.  Pivots are compared with
    each other; their followers only where that leaves it open whether two stars
    touch and no other link has joined them.
    """
    shaped = shapes(vertices) if shaped is None else shaped
    tolerance = cut_lineage(_tolerance(bounds, ratio))
    cand = cut_lineage(_filed_by_corner(vertices, tolerance, shaped))
    cores = cut_lineage(_cores(cand, vertices, crowd))
    stars = cores.where("node <> core").select("doc_id", F.col("core").alias("src"), F.col("node").alias("dst"), F.col("off").alias("distance"))
    links = copy_edges(shaped).join(tolerance, "doc_id", "left_semi").withColumn("distance", F.lit(0.0)).unionByName(stars)
    if stars.isEmpty():
        close = point_distances(_meeting(cand, F.col("tolerance")), vertices)
        return links.unionByName(close.join(tolerance, "doc_id").where("distance <= tolerance").drop("tolerance"))
    radius = cores.groupBy("doc_id", F.col("core").alias("node")).agg(F.max("off").alias("r"))
    heads = cand.join(radius, NODE)
    ends = [radius.select("doc_id", F.col("node").alias(e), F.col("r").alias(f"{e}_r")) for e in ("src", "dst")]
    apart = point_distances(_meeting(heads, F.col("tolerance") * 2, 2), vertices).join(tolerance, "doc_id").join(ends[0], ["doc_id", "src"]).join(ends[1], ["doc_id", "dst"])
    apart = cut_lineage(apart.where(F.col("distance") <= (F.col("tolerance") + F.col("src_r") + F.col("dst_r")) * 1.000001))
    near = apart.where("distance <= tolerance").select("doc_id", "src", "dst", "distance")
    links = links.unionByName(near)
    roots = cut_lineage(connected_components(radius.select("doc_id", F.col("node").alias("id")), near))
    sides = [roots.select("doc_id", F.col("id").alias(e), F.col("root").alias(f"{e}_root")) for e in ("src", "dst")]
    unsure = cut_lineage(apart.where("distance > tolerance").join(sides[0], ["doc_id", "src"]).join(sides[1], ["doc_id", "dst"]).where("src_root <> dst_root"))
    if unsure.isEmpty():
        return links
    sized = cand.select(*NODE, "n")

    def reaching(here: str, there: str) -> DataFrame:
        """Followers of one pivot that can be near a follower of the other."""
        rows = unsure.join(cores.select("doc_id", F.col("core").alias(here), "node"), ["doc_id", here]).join(sized, NODE)
        tries = rows.select("doc_id", F.col(there).alias("src"), F.col("node").alias("dst"), "n").distinct()
        far = point_distances(tries, vertices).select("doc_id", F.col("src").alias(there), F.col("dst").alias("node"), F.col("distance").alias("_d"))
        return rows.join(far, ["doc_id", there, "node"]).where(F.col("_d") <= (F.col("tolerance") + F.col(f"{there}_r")) * 1.000001).select(
            "doc_id", "src", "dst", "n", F.col("node").alias(f"_{here}"))

    opened = reaching("src", "dst").join(reaching("dst", "src").drop("n"), ["doc_id", "src", "dst"]).select("doc_id", F.col("_src").alias("src"), F.col("_dst").alias("dst"), "n").distinct()
    close = point_distances(opened, vertices).join(tolerance, "doc_id").where("distance <= tolerance").drop("tolerance")
    return links.unionByName(close)


def _segment_boxes(segments: DataFrame, margin: Column) -> DataFrame:
    boxed = segments
    for c in "xy":
        boxed = boxed.withColumns({
            f"min_{c}": F.least(f"{c}1", f"{c}2") - margin, f"max_{c}": F.greatest(f"{c}1", f"{c}2") + margin
        })
    return boxed


def touch_pairs(
    vertices: DataFrame, bounds: DataFrame, ratio: float = 0.001, shaped: DataFrame | None = None
) -> DataFrame:
    """Outlines that come within the tolerance of each other, with their exact distance.

    Segments, not outlines, are joined on the grid, so two long outlines only
    compare the parts that are near each other.
    """
    shaped = shapes(vertices) if shaped is None else shaped
    tolerance = _tolerance(bounds, ratio)
    segments = with_node(drawn_edges(shape_members(vertices, shaped))).join(tolerance, "doc_id")
    margin = F.col("tolerance") * 0.5000001 + 1e-12
    boxes = _segment_boxes(segments, margin).select(
        "doc_id", F.struct("node", "i", "closing").alias("seg"), "node", "tolerance", "x1", "y1", "x2", "y2",
        "min_x", "min_y", "max_x", "max_y",
    )
    met = overlapping_boxes(boxes, "doc_id", "seg", segments=True).where("a_node <> b_node")
    near = geometry.with_nearest(met).select(
        "doc_id", F.least("a_node", "b_node").alias("src"), F.greatest("a_node", "b_node").alias("dst"),
        F.col("gap").alias("distance"), F.col("a_tolerance").alias("tolerance"),
    ).where("distance <= tolerance")
    return copy_edges(shaped).withColumn("distance", F.lit(0.0)).unionByName(
        near.groupBy("doc_id", "src", "dst").agg(F.min("distance").alias("distance"))
    )


def near_pieces(segments: DataFrame, radius: DataFrame) -> DataFrame:
    """Closest points of every two pieces of a selection that are within the selection's radius.

    ``segments``: selection_id, piece, seg, x1, y1, x2, y2; ``radius``:
    selection_id, radius.  The distance is exact for every pair it lists.
    """
    margin = F.col("radius") * 0.5000001 + 1e-12
    boxes = _segment_boxes(segments.join(radius, "selection_id"), margin)
    met = overlapping_boxes(boxes, "selection_id", "seg", segments=True).where("a_piece <> b_piece")
    low_first = F.col("a_piece") < F.col("b_piece")

    def side(low: str, high: str) -> Column:
        return F.when(low_first, F.col(low)).otherwise(F.col(high))

    best = F.struct(
        F.round("gap", 9).alias("distance"), side("ax", "bx").alias("ax"), side("ay", "by").alias("ay"),
        side("bx", "ax").alias("bx"), side("by", "ay").alias("by"),
    )
    return geometry.with_nearest(met).where("gap <= a_radius").groupBy(
        "selection_id", F.least("a_piece", "b_piece").alias("src"), F.greatest("a_piece", "b_piece").alias("dst")
    ).agg(F.min(best).alias("best")).select("selection_id", "src", "dst", "best.*")


def outline_key(df: DataFrame, node: str) -> DataFrame:
    """Splits a node id back into path and subpath index."""
    return df.withColumns({
        "path_index": F.shiftright(node, 32).cast("int"), "subpath_index": F.col(node).bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    })
