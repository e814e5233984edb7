"""Masks to outlines and outlines to pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgrid.operators.graph import cycle_positions
from inkgrid.operators.masks import layer_contamination, layer_fidelity
from inkgrid.operators.svg import svg_documents

MASK = ["image_id", "mask_id"]

# Directions along the outline, the mask being on the right-hand side.
_RIGHT, _DOWN, _LEFT, _UP = 0, 1, 2, 3
# Which of the four pixels around a lattice point are set (1 top left, 2 top right,
# 4 bottom left, 8 bottom right) -> turns (direction in, direction out) made there.
# Pixels that only meet at a corner stay apart.
_TURNS = {
    8: [(_UP, _RIGHT)], 4: [(_RIGHT, _DOWN)], 1: [(_DOWN, _LEFT)], 2: [(_LEFT, _UP)],
    7: [(_LEFT, _DOWN)], 11: [(_UP, _LEFT)], 14: [(_RIGHT, _UP)], 13: [(_DOWN, _RIGHT)],
    9: [(_DOWN, _LEFT), (_UP, _RIGHT)], 6: [(_LEFT, _UP), (_RIGHT, _DOWN)],
}


def outline_corners(mask_pixels: DataFrame) -> DataFrame:
    """Corners of all mask outlines: lattice point, direction in, direction out.

    Every pixel marks its four lattice points; the marks are OR-ed with a
    map-side combine, and the pattern at a point tells the turns made there.
    """
    x, y = F.col("x"), F.col("y")
    marks = mask_pixels.select(*MASK, F.explode(F.array(*[
        F.struct((x + dx).alias("x"), (y + dy).alias("y"), F.lit(bit).alias("bit"))
        for dx, dy, bit in ((0, 0, 8), (1, 0, 4), (0, 1, 2), (1, 1, 1))
    ])).alias("p")).groupBy(*MASK, F.col("p.x").alias("x"), F.col("p.y").alias("y")).agg(F.bit_or("p.bit").alias("pattern"))
    return _turned(marks)


def _turned(marks: DataFrame) -> DataFrame:
    turn = F.create_map(*[
        v for pattern, turns in _TURNS.items()
        for v in (F.lit(pattern), F.array(*[F.struct(F.lit(a).alias("din"), F.lit(b).alias("dout")) for a, b in turns]))
    ])
    return marks.select(*MASK, "x", "y", F.explode(F.try_element_at(turn, F.col("pattern"))).alias("t")).select(
        *MASK, "x", "y", "t.din", "t.dout"
    )


def run_corners(runs: DataFrame) -> DataFrame:
    """The same corners from the maximal runs of every mask row (``image_id, mask_id, y, a, b``).

    The outline turns only where a run of the row above or below a lattice point begins
    or ends, so the work grows with the runs and not with the pixels between their ends.
    """
    ends = [(1, "a", 1, 0), (1, "b", -1, 0), (0, "a", 0, 1), (0, "b", 0, -1)]
    events = runs.select(*MASK, F.explode(F.array(*[
        F.struct((F.col("y") + dy).alias("y"), (F.col(end) + int(end == "b")).alias("x"), F.lit(up).alias("up"), F.lit(down).alias("down")) for dy, end, up, down in ends
    ])).alias("p")).select(*MASK, "p.*")
    line = Window.partitionBy(*MASK, "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    points = events.repartition(*MASK, "y").groupBy(*MASK, "y", "x").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    covered = points.withColumns({"_up": F.sum("up").over(line), "_down": F.sum("down").over(line)})
    sides = [F.col("_up") - F.col("up"), F.col("_up"), F.col("_down") - F.col("down"), F.col("_down")]
    pattern = sum((F.when(side > 0, 1 << k).otherwise(0) for k, side in enumerate(sides)), F.lit(0))
    return _turned(covered.select(*MASK, "x", "y", pattern.alias("pattern")))


def _corner_id(x: Column, y: Column, din: Column) -> Column:
    return F.shiftleft(y.cast("long"), 34) + F.shiftleft(x.cast("long"), 2) + din


def outline_links(mask_pixels: DataFrame) -> DataFrame:
    """Straight outline runs ``id, next, x1, y1, x2, y2``, one per corner.

    Along a line and direction, corners leaving and corners arriving take
    turns, so the next event of the line is the end of the run.
    """
    return _links(outline_corners(mask_pixels))


def _links(corners: DataFrame) -> DataFrame:
    corners = corners.withColumn("id", _corner_id(F.col("x"), F.col("y"), F.col("din")))

    def event(direction: str, leaving: bool) -> Column:
        way = F.col(direction)
        flat = way.isin(_RIGHT, _LEFT)
        along = F.when(flat, F.col("x")).otherwise(F.col("y"))
        return F.struct(
            way.alias("way"), F.when(flat, F.col("y")).otherwise(F.col("x")).alias("line"),
            F.when(way.isin(_RIGHT, _DOWN), along).otherwise(-along).alias("at"), F.lit(leaving).alias("leaving"),
        )

    events = corners.select(
        *MASK, "id", "x", "y", F.explode(F.array(event("dout", True), event("din", False))).alias("e")
    ).select(*MASK, "id", "x", "y", "e.*")
    line = Window.partitionBy(*MASK, "way", "line").orderBy("at")
    end = F.lead(F.struct("id", "x", "y")).over(line)
    return events.withColumn("end", end).where("leaving").select(
        *MASK, "id", F.col("end.id").alias("next"), F.col("x").alias("x1"), F.col("y").alias("y1"),
        F.col("end.x").alias("x2"), F.col("end.y").alias("y2"),
    )


def trace_masks(mask_pixels: DataFrame) -> DataFrame:
    """Closed rings on pixel edges: ``image_id, mask_id, ring, i, x, y``.

    Outer rings run clockwise (positive shoelace sum), holes the other way.
    The result fills back to exactly the mask it came from.
    """
    return _rings(outline_links(mask_pixels))


def trace_runs(runs: DataFrame) -> DataFrame:
    """The rings of :func:`trace_masks` from the maximal runs of every mask row (``image_id, mask_id, y, a, b``)."""
    return _rings(_links(run_corners(runs)))


def _rings(links: DataFrame) -> DataFrame:
    return cycle_positions(links.select(*MASK, "id", "next", "x1", "y1"), MASK).select(
        *MASK, "ring", F.col("pos").cast("int").alias("i"), F.col("x1").cast("double").alias("x"), F.col("y1").cast("double").alias("y")
    )


def ring_table(rings: DataFrame) -> DataFrame:
    """Rings with number of corners and whether they bound a hole."""
    line = Window.partitionBy(*MASK, "ring").orderBy("i")
    first = F.first(F.struct("x", "y")).over(line)
    nxt = F.coalesce(F.lead(F.struct("x", "y")).over(line), first)
    cross = rings.withColumn("c", F.col("x") * nxt["y"] - nxt["x"] * F.col("y"))
    return cross.groupBy(*MASK, "ring").agg(F.count("*").alias("corners"), (F.sum("c") / 2.0).alias("signed_area")).withColumn(
        "is_hole", F.col("signed_area") < 0
    )


def mask_documents(mask_pixels: DataFrame, canvas: DataFrame, fills: DataFrame | None = None) -> DataFrame:
    """Masks to SVG documents (``doc_id, svg``): one document per image, one even-odd path per mask that has pixels.

    ``canvas`` holds image_id, width, height; ``fills`` image_id, mask_id, fill.
    """
    rings = trace_masks(mask_pixels)
    order = Window.partitionBy(*MASK).orderBy("ring")
    numbers = rings.select(*MASK, "ring").distinct().withColumn("subpath_index", F.row_number().over(order) - 1)
    vertices = rings.join(numbers, [*MASK, "ring"]).select(
        F.col("image_id").alias("doc_id"), F.col("mask_id").cast("int").alias("path_index"), "subpath_index", F.lit(True).alias("closed"), "i", "x", "y"
    )
    named = None if fills is None else fills.select(F.col("image_id").alias("doc_id"), F.col("mask_id").cast("int").alias("path_index"), "fill")
    return svg_documents(vertices, canvas.select(F.col("image_id").alias("doc_id"), "width", "height"), named)


def rasterize(edges: DataFrame, canvas: DataFrame, keys: list[str], canvas_keys: list[str]) -> DataFrame:
    """Pixels whose centre is inside by the even-odd rule over all edges of a key: those of its :func:`filled_runs`."""
    return filled_runs(edges, canvas, keys, canvas_keys).select(*keys, "y", F.explode(F.sequence("a", "b")).alias("x"))


def filled_runs(edges: DataFrame, canvas: DataFrame, keys: list[str], canvas_keys: list[str]) -> DataFrame:
    """Runs of pixels ``y, a, b`` (first and last column) whose centre is inside by the even-odd rule over all edges of a key.

    ``edges`` holds x1, y1, x2, y2 of closed rings; ``canvas`` width and height.
    Each edge gives its crossings with the pixel rows; crossings of a row are
    paired in order, so the runs of a key have no pixel in common.
    """
    def first_centre(v: Column) -> Column:
        return F.ceil(v - 0.5).cast("int")

    sized = edges.where("y1 <> y2").join(canvas.select(*canvas_keys, "width", "height"), canvas_keys)
    lo = F.greatest(first_centre(F.least("y1", "y2")), F.lit(0))
    hi = F.least(first_centre(F.greatest("y1", "y2")) - 1, F.col("height") - 1)
    rows = F.when(lo <= hi, F.sequence(lo, hi))
    at = F.col("x1") + (F.col("y") + 0.5 - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    crossings = sized.withColumn("y", F.explode(rows)).select(*keys, "y", "width", at.alias("at"))
    line = Window.partitionBy(*keys, "y").orderBy("at")
    spans = crossings.withColumns({"n": F.row_number().over(line), "to": F.lead("at").over(line)}).where("n % 2 = 1")
    a = F.greatest(first_centre(F.col("at")), F.lit(0))
    b = F.least(first_centre(F.col("to")) - 1, F.col("width") - 1)
    return spans.select(*keys, "y", a.alias("a"), b.alias("b")).where("a <= b")


def merged_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Maximal runs ``y, a, b`` of every key from runs that may overlap or border on each other."""
    line = Window.partitionBy(*keys, "y").orderBy("a")
    before = F.max("b").over(line.rowsBetween(Window.unboundedPreceding, -1))
    begun = runs.withColumn("_begins", F.coalesce(F.col("a") > before + 1, F.lit(True)).cast("int"))
    numbered = begun.withColumn("_n", F.sum("_begins").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "y", "_n").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("_n")


def meeting_runs(runs: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both sides whose runs (``y, a, b`` and ``y, a2, b2``) of a key share a column.

    Runs are filed under blocks of columns, so that a long row with many runs is
    not compared run by run; a pair that shares several blocks comes more than once.
    """
    def filed(df: DataFrame, lo: str, hi: str) -> DataFrame:
        return df.withColumn("_block", F.explode(F.sequence(F.shiftright(lo, 5), F.shiftright(hi, 5))))

    return filed(runs, "a", "b").join(filed(others, "a2", "b2"), [*keys, "y", "_block"]).where("a <= b2 and a2 <= b").drop("_block")


def trace_layers(mask_pixels: DataFrame, masks: DataFrame, canvas: DataFrame) -> DataFrame:
    """All masks of an image at once, with node count, fidelity and contamination.

    ``complete`` tells per image whether every requested mask gave outlines.
    """
    links = outline_links(mask_pixels)
    again = rasterize(links, canvas, MASK, ["image_id"])
    nodes = links.groupBy(*MASK).agg(F.count("*").alias("node_count"))
    rows = (
        masks.select(*MASK).join(nodes, MASK, "left")
        .join(layer_fidelity(again, mask_pixels), MASK, "left").join(layer_contamination(again, mask_pixels), MASK, "left")
    )
    state = rows.groupBy("image_id").agg(F.bool_and(F.col("node_count").isNotNull()).alias("complete"))
    return rows.join(state, "image_id").select(
        *MASK, F.coalesce("node_count", F.lit(0)).alias("node_count"), "own_mismatch_ratio", "contamination_ratio", "complete"
    )
