"""Joining selected pieces: checks, spanning tree, bridges, fused pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgrid.functions.geometry import with_crossing
from inkgrid.operators import fuse
from inkgrid.operators.graph import _over_scopes, connected_components
from inkgrid.operators.grid import overlapping_boxes
from inkgrid.operators.outlines import drawn_edges, edges, polygon_area, subpaths
from inkgrid.operators.pairs import near_pieces
from inkgrid.operators.raster import filled_runs, meeting_runs, merged_runs, ring_table, trace_runs
from inkgrid.operators.svg import KEY, svg_documents
from inkgrid.session import cut_lineage

LEAST_AREA = 1e-9


def self_crossing(vertices: DataFrame) -> DataFrame:
    """Outlines (as closed rings) with two non-adjacent edges that meet."""
    ring = edges(vertices)
    sizes = ring.groupBy(*KEY).agg(F.count("*").alias("n"))
    boxes = ring.join(sizes, KEY).select(
        F.struct(*KEY).alias("outline"), "i", "n", "x1", "y1", "x2", "y2",
        *[F.least(f"{c}1", f"{c}2").alias(f"min_{c}") for c in "xy"], *[F.greatest(f"{c}1", f"{c}2").alias(f"max_{c}") for c in "xy"],
    )
    step = F.pmod(F.col("a_i") - F.col("b_i"), F.col("a_n"))
    far = overlapping_boxes(boxes, "outline", "i", segments=True).where((step != 1) & (step != F.col("a_n") - 1))
    return with_crossing(far).where("crosses").select("outline.*").distinct()


def validate_selection(pieces: DataFrame, members: DataFrame, vertices: DataFrame) -> DataFrame:
    """First reason why a selection cannot be fused, or null.

    ``pieces``: selection_id, doc_id, pos, component_id; ``members``:
    selection_id, doc_id, component_id, path_index, subpath_index, role.
    """
    s = ["selection_id", "doc_id"]
    counts = pieces.groupBy(*s).agg(F.count("*").alias("k"), F.count_distinct("component_id").alias("kinds"))
    empty = pieces.join(members, [*s, "component_id"], "left_anti").groupBy(*s).agg(F.count("*").alias("empty"))
    shared = members.groupBy(*s, "path_index", "subpath_index").agg(F.count("*").alias("m")).where("m > 1").groupBy(*s).agg(F.count("*").alias("shared"))
    shape = subpaths(vertices).select(*KEY, "n_points").join(polygon_area(vertices), KEY)
    crossing = self_crossing(vertices).withColumn("crossing", F.lit(True))
    state = members.join(shape, KEY, "left").join(crossing, KEY, "left").groupBy(*s).agg(
        F.count_if(F.col("n_points").isNull()).alias("missing"), F.count_if(F.col("n_points") < 3).alias("short"),
        F.count_if((F.col("area") <= LEAST_AREA) | F.coalesce("crossing", F.lit(False))).alias("invalid"),
    )
    solid = members.groupBy(*s, "component_id").agg(F.count_if(F.col("role") == "solid").alias("solids")).where("solids = 0").groupBy(*s).agg(
        F.count("*").alias("hollow")
    )
    joined = counts
    for part in (empty, shared, state, solid):
        joined = joined.join(part, s, "left")
    reason = (
        F.when(F.col("k") < 2, "too_few_pieces").when(F.col("kinds") < F.col("k"), "repeated_pieces").when(F.col("empty") > 0, "empty_piece")
        .when(F.col("shared") > 0, "shared_member").when(F.col("missing") > 0, "missing_member").when(F.col("short") > 0, "too_few_points")
        .when(F.col("invalid") > 0, "invalid_ring").when(F.col("hollow") > 0, "no_solid")
    )
    return joined.select(*s, reason.alias("reason"))


def piece_segments(members: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges of the selected outlines as ``selection_id, piece, seg, x1, y1, x2, y2``."""
    return drawn_edges(vertices).join(members.select("selection_id", "piece", *KEY), KEY).select(
        "selection_id", "piece", F.struct("piece", "path_index", "subpath_index", "i", "closing").alias("seg"), "x1", "y1", "x2", "y2"
    )


def linking_distances(segments: DataFrame) -> DataFrame:
    """Closest points of enough piece pairs that each selection is connected by them.

    The search radius starts at the spacing of evenly spread pieces and is
    doubled, only for selections still in parts.  All pairs within the final
    radius are there, so a minimum spanning tree is among them, without ever
    comparing every piece with every other.
    """
    segments = cut_lineage(segments)
    spread = segments.groupBy("selection_id").agg(
        F.hypot(
            F.max(F.greatest("x1", "x2")) - F.min(F.least("x1", "x2")), F.max(F.greatest("y1", "y2")) - F.min(F.least("y1", "y2"))
        ).alias("extent"), F.count_distinct("piece").alias("k"),
    ).where("k > 1")
    radius = spread.select("selection_id", F.greatest(F.col("extent") / F.sqrt("k") / 2.0, F.lit(1e-6)).alias("radius"))
    found, todo = None, radius
    while True:
        todo = cut_lineage(todo)
        near = cut_lineage(near_pieces(segments, todo))
        nodes = segments.join(todo, "selection_id", "left_semi").select("selection_id", F.col("piece").alias("id"))
        roots = connected_components(nodes, near.select("selection_id", "src", "dst"), "selection_id")
        split = cut_lineage(roots.groupBy("selection_id").agg(F.count_distinct("root").alias("parts")).where("parts > 1"))
        done = near.join(split, "selection_id", "left_anti")
        found = done if found is None else found.unionByName(done)
        todo = todo.join(split.select("selection_id"), "selection_id").withColumn("radius", F.col("radius") * 2)
        if split.isEmpty():
            return found


def spanning_tree(distances: DataFrame) -> DataFrame:
    """Minimum spanning tree per selection, by rounds in which every part takes its shortest way out."""
    distances = cut_lineage(distances)
    order = F.struct("distance", "src", "dst")
    label = distances.select("selection_id", F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("part", F.col("id"))
    tree = distances.limit(0)
    while True:
        ends = [label.select("selection_id", F.col("id").alias(e), F.col("part").alias(f"{e}_part")) for e in ("src", "dst")]
        crossing = cut_lineage(
            distances.join(ends[0], ["selection_id", "src"]).join(ends[1], ["selection_id", "dst"]).where("src_part <> dst_part")
        )
        if crossing.isEmpty():
            return tree
        out = crossing.withColumn("part", F.explode(F.array("src_part", "dst_part"))).groupBy("selection_id", "part").agg(F.min(order).alias("e"))
        taken = out.select("selection_id", "e.src", "e.dst").distinct()
        tree = cut_lineage(tree.unionByName(distances.join(taken, ["selection_id", "src", "dst"])))
        label = cut_lineage(connected_components(label.select("selection_id", "id"), tree.select("selection_id", "src", "dst"), "selection_id").withColumnRenamed("root", "part"))


def bridge_plan(tree: DataFrame, sizes: DataFrame, width_ratio: float = 0.02, touch_ratio: float = 0.001) -> DataFrame:
    """Rectangles over the tree edges that are longer than the touch tolerance.

    ``sizes``: selection_id, diagonal (of the document).
    """
    t = tree.join(sizes.select("selection_id", "diagonal"), "selection_id").withColumn("tolerance", F.col("diagonal") * touch_ratio).where(
        "distance > tolerance"
    )
    width = F.greatest(F.col("diagonal") * width_ratio, F.col("tolerance") * 4, F.lit(1e-6))
    along = {c: F.col(f"b{c}") - F.col(f"a{c}") for c in "xy"}
    t = t.withColumns({"width": width, "length": F.hypot(along["x"], along["y"])}).where("length > 1e-9").withColumns(
        {f"u{c}": v / F.col("length") for c, v in along.items()}
    )
    # The centre line of the bridge reaches a little into both pieces; corners are the centre plus or minus half of it and of the width.
    reach = F.col("length") / 2.0 + F.greatest(F.col("width"), F.col("length") * 0.05, F.lit(1e-6))

    def corner(end: float, side: float) -> Column:
        x = (F.col("ax") + F.col("bx")) / 2.0 + reach * F.col("ux") * end - F.col("width") / 2.0 * F.col("uy") * side
        y = (F.col("ay") + F.col("by")) / 2.0 + reach * F.col("uy") * end + F.col("width") / 2.0 * F.col("ux") * side
        return F.struct(x.alias("x"), y.alias("y"))

    corners = F.array(*[corner(end, side) for end, side in ((-1.0, 1.0), (1.0, 1.0), (1.0, -1.0), (-1.0, -1.0))])
    return t.select("selection_id", "src", "dst", "distance", "width", corners.alias("corners"))


def bridge_strategy(tree: DataFrame, sizes: DataFrame, touch_ratio: float = 0.001) -> DataFrame:
    needs = F.count_if(F.col("distance") > F.col("diagonal") * touch_ratio)
    strategy = F.when(needs == 0, "boolean_union").when(needs == F.count("*"), "bridge").otherwise("mixed")
    return tree.join(sizes, "selection_id").groupBy("selection_id").agg(
        needs.alias("bridge_count"), strategy.alias("strategy"), F.sum("distance").alias("total_length")
    )


def bridge_edges(bridges: DataFrame) -> DataFrame:
    """Bridge rectangles as closed edges for rasterising, one key per bridge."""
    following = F.concat(F.slice("corners", 2, 3), F.slice("corners", 1, 1))
    return bridges.select("selection_id", "src", "dst", F.explode(F.arrays_zip("corners", following.alias("next"))).alias("e")).select(
        "selection_id", "src", "dst", F.col("e.corners.x").alias("x1"), F.col("e.corners.y").alias("y1"),
        F.col("e.next.x").alias("x2"), F.col("e.next.y").alias("y2"),
    )


def run_regions(runs: DataFrame, scope: str) -> DataFrame:
    """Maximal runs of pixels (``y, a, b``) with the 4-connected region they belong to; the graph links runs that share a column in neighbouring rows."""
    runs = cut_lineage(runs.select(scope, "y", "a", "b", (F.shiftleft(F.col("y").cast("long"), 32) + F.col("a")).alias("run")))
    below = runs.select(scope, (F.col("y") - 1).alias("y"), F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("run").alias("dst"))
    links = meeting_runs(runs, below, [scope]).select(scope, F.col("run").alias("src"), "dst").distinct()
    roots = connected_components(runs.select(scope, F.col("run").alias("id")), links, scope)
    return runs.join(roots.select(scope, F.col("id").alias("run"), F.col("root").alias("region")), [scope, "run"]).select(scope, "y", "a", "b", "region")


def _other_side(runs: DataFrame) -> DataFrame:
    return runs.withColumnsRenamed({"a": "a2", "b": "b2"})


def region_links(bridge_runs: DataFrame, regions: DataFrame) -> DataFrame:
    """Which regions and which other bridges each bridge overlaps or borders on (``selection_id, src, dst`` as node names)."""
    around = F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("a") - dx).alias("a"), (F.col("b") + dx).alias("b")) for dy, dx in ((0, 1), (1, 0), (-1, 0))])
    near = bridge_runs.select("selection_id", "doc_id", "bridge", F.explode(around).alias("o")).select("selection_id", "doc_id", "bridge", "o.*")
    to_region = meeting_runs(near, _other_side(regions), ["doc_id"]).select("selection_id", F.col("bridge").alias("src"), F.concat(F.lit("r"), "region").alias("dst"))
    other = _other_side(bridge_runs.select("selection_id", F.col("bridge").alias("dst"), "y", "a", "b"))
    to_bridge = meeting_runs(near, other, ["selection_id"]).where(F.col("bridge") < F.col("dst")).select("selection_id", F.col("bridge").alias("src"), "dst")
    return to_region.unionByName(to_bridge).distinct()


def _fuse_rows(ring: DataFrame, own: DataFrame, spans: DataFrame, canvas: DataFrame) -> DataFrame:
    """Edges, selected pieces and bridge edges of every document as one table (``fuse.INPUT``), with the pixel rows that each row crosses."""
    size = canvas.select("doc_id", "width", "height")
    zero = F.lit(0).cast("long")
    ends = ["x1", "y1", "x2", "y2"]
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    crossings = F.greatest(F.least(high, F.col("height").cast("double")) - F.greatest(low, F.lit(0.0)), F.lit(0.0)) + 1
    broken = F.lit(False)
    for c in ends:
        broken = broken | F.col(c).isNull() | F.isnan(c) | (F.abs(c) > 1e9)
    broken = broken | F.col("width").isNull() | F.col("height").isNull() | (F.greatest("width", "height") > fuse.WIDEST)

    def edge_rows(df: DataFrame, kind: int, selection: Column, piece: str, other: Column) -> DataFrame:
        sized = df.where("y1 <> y2").join(size, "doc_id").withColumn("crossings", F.when(broken | F.col(piece).isNull() | other.isNull(), F.lit(float("inf"))).otherwise(crossings))
        return sized.select(F.lit(kind).cast("byte").alias("kind"), "doc_id", selection.alias("selection_id"), F.col(piece).alias("piece"), other.alias("other"), *ends, "width", "height", "crossings")

    edge_part = cut_lineage(edge_rows(ring, fuse.EDGE, zero, "piece", zero))
    heavy = edge_part.groupBy("doc_id", "piece").agg(F.sum("crossings").alias("crossings"), F.first("width").alias("width"), F.first("height").alias("height"))
    nothing = [F.lit(0.0).alias(c) for c in ends]
    member_part = own.join(heavy, ["doc_id", "piece"]).select(F.lit(fuse.MEMBER).cast("byte").alias("kind"), "doc_id", "selection_id", "piece", zero.alias("other"), *nothing, "width", "height", "crossings")
    return edge_part.unionByName(member_part).unionByName(edge_rows(spans, fuse.BRIDGE, F.col("selection_id"), "src", F.col("dst"))).select(*fuse.INPUT)


def _split(ring: DataFrame, own: DataFrame, spans: DataFrame, canvas: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """What ``fuse`` gives for the documents with at most ``most`` crossings, and the documents left to the joins (None if there are none).

    A selection over several documents, a document with several sizes, pieces without a number and coordinates that are no numbers are left to the joins.
    """
    rows = cut_lineage(_fuse_rows(ring, own, spans, canvas))
    long = all(kind == "bigint" for name, kind in rows.dtypes if name in ("doc_id", "selection_id", "piece", "other"))
    heavy = rows.groupBy("doc_id").agg(F.sum("crossings").alias("w")).where((F.col("w") > most) | F.isnan("w")).select("doc_id")
    wide = own.groupBy("selection_id").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a <> b").select("selection_id")
    twice = canvas.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id")
    large = cut_lineage(heavy.unionByName(own.join(wide, "selection_id").select("doc_id")).unionByName(twice).distinct())
    if not long:
        return None, rows.select("doc_id").distinct()
    few = rows.join(large, "doc_id", "left_anti").where("doc_id is not null and selection_id is not null")
    out = cut_lineage(_over_scopes(few, ["doc_id"], [], fuse.fused, fuse.OUTPUT))
    return out, None if large.isEmpty() else large


def union_pieces(vertices: DataFrame, pieces: DataFrame, selected: DataFrame, bridges: DataFrame, canvas: DataFrame, most: int = fuse.MOST) -> tuple[DataFrame, DataFrame]:
    """Fuses the selected pieces of each selection: a report, and the vertices of the documents that come out.

    ``pieces``: doc_id, piece, path_index, subpath_index for every outline;
    ``selected``: selection_id, doc_id, piece; ``bridges``: the bridge plan;
    ``canvas``: doc_id, width, height.

    All pixels are handled as runs of a row, never one by one.
    Fused pixels are traced per connected region, and each hole belongs to the outer
    ring of its region.  Nothing but bridges is added to a document, so its regions
    afterwards are its regions before, linked by the bridges.  A selection is
    accepted only if there are (before - touched by the selection + 1) of them and
    the selection is one; then its document is the outlines that were not selected,
    as they were, and one more path whose first outline is the outer ring and whose
    others are the holes.  A refused selection has no document.

    A document whose edges, selections and bridges cross at most ``most`` rows of
    pixels is fused in the task that holds it (0: none), the others by joins.
    """
    s = ["selection_id", "doc_id"]
    ring = edges(vertices).join(pieces, KEY).select("doc_id", "piece", "x1", "y1", "x2", "y2")
    own = selected.select(*s, "piece").distinct()
    spans = bridge_edges(bridges).join(own.select(*s).distinct(), "selection_id")
    found, large = _split(ring, own, spans, canvas, most)
    parts = []
    if found is not None:
        known = F.col("accepted")
        report = found.where(F.col("kind") == fuse.REPORT).select(
            *s, "regions_before", "regions_after", "regions_expected", "accepted", *[F.when(known, F.col(c)).alias(c) for c in ("area", "holes", "hole_area")])
        parts.append((report, found.where(F.col("kind") == fuse.VERTEX).select(*s, "subpath_index", "i", "x", "y")))
    if large is not None:
        parts.append(_fused_by_joins(*[df.join(large, "doc_id", "left_semi") for df in (ring, own, spans)], canvas))
    report, traced = parts[0] if len(parts) == 1 else [a.unionByName(b) for a, b in zip(*parts, strict=True)]

    taken = report.where("accepted").select(*s)
    last = vertices.groupBy("doc_id").agg((F.max("path_index") + 1).alias("path_index"))
    new = traced.join(last, "doc_id").select(*s, "path_index", "subpath_index", F.lit(True).alias("closed"), "i", "x", "y")
    # Outlines know the selections they are part of, so that no vertex is moved once per selection.
    gone = own.join(pieces, ["doc_id", "piece"]).groupBy(*KEY).agg(F.collect_set("selection_id").alias("_gone"))
    stay = taken.groupBy("doc_id").agg(F.collect_set("selection_id").alias("_all"))
    left = F.when(F.col("_gone").isNull(), F.col("_all")).otherwise(F.array_except("_all", "_gone"))
    rest = vertices.join(stay, "doc_id").join(gone, KEY, "left").withColumn("selection_id", F.explode(left)).select(*new.columns)
    return report, rest.unionByName(new)


def _fused_by_joins(ring: DataFrame, own: DataFrame, spans: DataFrame, canvas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Report and new outlines of documents of any size."""
    s = ["selection_id", "doc_id"]
    runs = cut_lineage(filled_runs(ring, canvas, ["doc_id", "piece"], ["doc_id"]))
    regions = cut_lineage(run_regions(merged_runs(runs.drop("piece"), ["doc_id"]), "doc_id"))
    before = regions.groupBy("doc_id").agg(F.count_distinct("region").alias("regions_before"))
    ours = cut_lineage(own.join(runs, ["doc_id", "piece"]).select(*s, "y", "a", "b"))
    added = cut_lineage(filled_runs(spans, canvas, [*s, "src", "dst"], ["doc_id"]).select(*s, F.concat_ws("-", F.lit("b"), "src", "dst").alias("bridge"), "y", "a", "b"))

    links = cut_lineage(region_links(added, regions))
    touched = cut_lineage(meeting_runs(ours.withColumn("b", F.col("a")), _other_side(regions), ["doc_id"]).select(*s, F.concat(F.lit("r"), "region").alias("id")).distinct())
    nodes = touched.select("selection_id", "id").unionByName(added.select("selection_id", F.col("bridge").alias("id"))).unionByName(links.select("selection_id", F.col("dst").alias("id"))).distinct()
    roots = cut_lineage(connected_components(nodes, links, "selection_id"))
    is_region = F.col("id").startswith("r")
    linked = roots.groupBy("selection_id").agg(F.count_if(is_region).alias("_met"), F.count_distinct("root").alias("_parts"))
    mine = touched.join(roots, ["selection_id", "id"]).groupBy(*s).agg(F.count("*").alias("regions_selected"), F.count_distinct("root").alias("_roots"), F.min("root").alias("root"))
    strange = roots.where(is_region).join(touched, ["selection_id", "id"], "left_anti").join(mine.select("selection_id", "root"), ["selection_id", "root"], "left_semi").select("selection_id").distinct()
    state = cut_lineage(
        own.select(*s).distinct().join(before, "doc_id").join(linked, "selection_id").join(mine, s).join(strange.withColumn("_strange", F.lit(True)), "selection_id", "left").select(
            *s, "regions_before", (F.col("regions_before") - F.col("_met") + F.col("_parts")).alias("regions_after"),
            (F.col("regions_before") - F.col("regions_selected") + 1).alias("regions_expected"), ((F.col("_roots") == 1) & F.col("_strange").isNull()).alias("_one"),
        ).withColumn("accepted", F.col("_one") & (F.col("regions_after") == F.col("regions_expected"))).drop("_one"))

    taken = state.where("accepted").select(*s)
    fused = merged_runs(ours.unionByName(added.select(*s, "y", "a", "b")).join(taken, s, "left_semi").drop("doc_id"), ["selection_id"])
    labelled = run_regions(fused, "selection_id").select(F.col("selection_id").alias("image_id"), F.col("region").alias("mask_id"), "y", "a", "b")
    traced = cut_lineage(trace_runs(labelled))
    table = ring_table(traced)
    areas = table.groupBy(F.col("image_id").alias("selection_id")).agg(
        F.sum("signed_area").alias("area"), F.count_if("is_hole").alias("holes"), F.sum(F.when(F.col("is_hole"), -F.col("signed_area")).otherwise(0.0)).alias("hole_area"))
    report = state.join(areas, "selection_id", "left")

    order = Window.partitionBy("image_id").orderBy("mask_id", "is_hole", "ring")  # one row per ring of a selection
    numbered = table.select("image_id", "mask_id", "ring", (F.row_number().over(order) - 1).alias("subpath_index"))
    new = traced.join(numbered, ["image_id", "mask_id", "ring"]).withColumnRenamed("image_id", "selection_id").join(taken, "selection_id")
    return report, new.select(*s, "subpath_index", "i", "x", "y")


def union_documents(result: DataFrame, selected: DataFrame, pieces: DataFrame, canvas: DataFrame, fills: DataFrame) -> DataFrame:
    """The documents of accepted selections as SVG text (``doc_id`` is the selection).

    ``fills`` (doc_id, path_index, fill) colours the paths that stay; the fused path
    looks like the first path of the first selected piece.
    """
    s = ["selection_id", "doc_id"]
    first = selected.join(pieces, ["doc_id", "piece"]).groupBy(*s).agg(F.min(F.struct("piece", "path_index")).alias("_first"))
    keys = cut_lineage(result.select(*s, "path_index").distinct())
    fused = keys.groupBy(*s).agg(F.max("path_index").alias("path_index")).join(first, s).select(*s, "path_index", F.col("_first.path_index").alias("like"))
    paths = keys.join(fused.select(*s, "path_index", "like"), [*s, "path_index"], "left").withColumn("like", F.coalesce("like", "path_index"))
    named = paths.join(fills.withColumnRenamed("path_index", "like"), ["doc_id", "like"], "left").select(F.col("selection_id").alias("doc_id"), "path_index", "fill")
    size = keys.select(*s).distinct().join(canvas, "doc_id").select(F.col("selection_id").alias("doc_id"), "width", "height")
    return svg_documents(result.drop("doc_id").withColumnRenamed("selection_id", "doc_id"), size, named)
