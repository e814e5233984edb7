"""Nesting of outlines by ray shots: what lies directly around a point, and pointer jumping over that.

Outlines that meet are one cluster.  Clusters do not meet, so what is around a
point follows from the first edge to its left: the outlines of that edge's cluster
which hold the point, and whatever is around that cluster as a whole.  Every
outline and every cluster sends one ray, so rows grow with the number of outlines,
not with how deep they are nested.

The first edge is found per slab.  Heights are replaced by their ranks, and an edge
is filed under the few dyadic slabs that make up its range; there it runs from
bottom to top, so the edges of a slab are in one order from left to right.  A
ray goes down a tree of 64 edges a node, one join a level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgrid.functions import geometry
from inkgrid.operators.graph import connected_components
from inkgrid.operators.grid import overlapping_boxes, points_in_boxes
from inkgrid.operators.history import numbered
from inkgrid.operators.outlines import edges, inward_points, polygon_area, with_node
from inkgrid.operators.pairs import NODE, shape_members, shapes
from inkgrid.session import cut_lineage, shuffled

FAN = 64
#: In a document with at most so many distinct outlines every point is held against all of them.
FEW = 256
_CELL = ["doc_id", "level", "slab"]
_ENDS = ["x1", "y1", "x2", "y2"]


def contact_clusters(ring: DataFrame) -> DataFrame:
    """``doc_id, node, cluster, tangled``: outlines that meet, directly or over others, and whether edges of the cluster cross.

    ``ring``: doc_id, node, i, n and ends of the edges, the closing ones included.
    """
    boxes = ring.select("doc_id", F.struct("node", "i").alias("seg"), "node", "i", "n", *_ENDS,
                        *[F.least(f"{c}1", f"{c}2").alias(f"min_{c}") for c in "xy"], *[F.greatest(f"{c}1", f"{c}2").alias(f"max_{c}") for c in "xy"])
    step = F.pmod(F.col("a_i") - F.col("b_i"), F.col("a_n"))
    met = overlapping_boxes(boxes, "doc_id", "seg", segments=True).where((F.col("a_node") != F.col("b_node")) | ((step != 1) & (step != F.col("a_n") - 1)))
    crossing = cut_lineage(geometry.with_crossing(met).where("crosses").select("doc_id", F.col("a_node").alias("src"), F.col("b_node").alias("dst")).distinct())
    roots = cut_lineage(connected_components(ring.select("doc_id", F.col("node").alias("id")).distinct(), crossing))
    tangled = crossing.select("doc_id", F.explode(F.array("src", "dst")).alias("id")).distinct().join(roots, ["doc_id", "id"]).select("doc_id", "root").distinct().withColumn("tangled", F.lit(True))
    return roots.join(tangled, ["doc_id", "root"], "left").select("doc_id", F.col("id").alias("node"), F.col("root").alias("cluster"), F.coalesce("tangled", F.lit(False)).alias("tangled"))


def height_ranks(heights: DataFrame) -> DataFrame:
    """``doc_id, y, rank, middle`` of the distinct heights; ``middle`` lies half way to the next one."""
    ranked = cut_lineage(numbered(heights.select("doc_id", "y").distinct(), ["doc_id"], ["y"], "rank"))
    above = ranked.select("doc_id", (F.col("rank") - 1).alias("rank"), F.col("y").alias("_next"))
    return cut_lineage(ranked.join(above, ["doc_id", "rank"], "left").select("doc_id", "y", "rank", ((F.col("y") + F.col("_next")) / 2.0).alias("middle")))


def dyadic_slabs(low: Column, high: Column) -> Column:
    """The dyadic slabs (``level``, ``slab``) that make up the ranks from ``low`` to before ``high``."""
    def at(level: Column) -> Column:
        first, last = F.ceil(low / F.pow(F.lit(2.0), level)), F.floor(high / F.pow(F.lit(2.0), level))
        left = F.when((first < last) & (first % 2 == 1), F.struct(level.cast("int").alias("level"), first.alias("slab")))
        right = F.when((first < last) & (last % 2 == 1), F.struct(level.cast("int").alias("level"), (last - 1).alias("slab")))
        return F.array_compact(F.array(left, right))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.floor(F.log2((high - low).cast("double"))).cast("int") + 1), at))


def filed_edges(ring: DataFrame, ranks: DataFrame) -> DataFrame:
    """Edges that are not level under each of their slabs, with their place from left to right (``at``: 0, 1, ...)."""
    low = ranks.select("doc_id", F.col("y").alias("_low"), F.col("rank").alias("_from"))
    high = ranks.select("doc_id", F.col("y").alias("_high"), F.col("rank").alias("_to"))
    spanned = ring.where("y1 <> y2").withColumns({"_low": F.least("y1", "y2"), "_high": F.greatest("y1", "y2")}).join(low, ["doc_id", "_low"]).join(high, ["doc_id", "_high"])
    # Lower end first, so that the place of an edge at its lower end is that end exactly.
    up = F.col("y1") < F.col("y2")
    turned = spanned.withColumns({f"_{c}{k}": F.when(up, F.col(f"{c}{k}")).otherwise(F.col(f"{c}{3 - k}")) for c in "xy" for k in (1, 2)})
    filed = turned.withColumn("c", F.explode(dyadic_slabs(F.col("_from"), F.col("_to")))).select(
        "doc_id", "c.level", "c.slab", "node", "i", "cluster", "tangled", *[F.col(f"_{c}").alias(c) for c in _ENDS], F.pow(F.lit(2.0), F.col("c.level")).cast("long").alias("_size"))
    middle = ranks.select("doc_id", F.col("rank").alias("_rank"), "middle")
    placed = filed.withColumn("_rank", F.col("slab") * F.col("_size")).join(middle, ["doc_id", "_rank"]).withColumn("mid_x", _x_at(F.col("middle")))
    rows = numbered(placed.select(*_CELL, "node", "i", "cluster", "tangled", *_ENDS, "mid_x"), _CELL, ["mid_x", "node", "i"], "at")
    return cut_lineage(rows.withColumn("at", F.col("at").cast("long") - 1))


def _x_at(y: Column, edge: Column | None = None) -> Column:
    x1, y1, x2, y2 = (F.col(c) if edge is None else edge[c] for c in _ENDS)
    return x1 + (y - y1) * (x2 - x1) / (y2 - y1)


def shoot(points: DataFrame, filed: DataFrame) -> DataFrame:
    """``doc_id, pid, hit``: the cluster of the first edge to the left of each point (``doc_id, pid, px, py, rank``); no row if there is none."""
    top = filed.agg(F.max("at")).first()[0]
    if top is None:
        return points.select("doc_id", "pid", F.lit(None).cast("long").alias("hit")).limit(0)
    levels = filed.groupBy("doc_id").agg(F.collect_set("level").alias("_levels"))
    state = points.join(levels, "doc_id").withColumn("level", F.explode("_levels")).select(
        *_CELL[:2], F.floor(F.col("rank") / F.pow(F.lit(2.0), F.col("level"))).alias("slab"), "pid", "px", "py")
    depth = 0
    while FAN ** (depth + 1) <= top:
        depth += 1
    entry = F.struct("at", *_ENDS, "cluster", "tangled")
    state = state.withColumns({"block": F.lit(0).cast("long"), "lo": F.lit(None).cast("struct<at:bigint,x1:double,y1:double,x2:double,y2:double,cluster:bigint,tangled:boolean>")}).withColumn("hi", F.col("lo"))
    for d in range(depth, -1, -1):
        step = FAN ** d
        nodes = filed.where(F.col("at") % step == 0).groupBy(*_CELL, F.floor(F.col("at") / (step * FAN)).alias("block")).agg(F.array_sort(F.collect_list(entry)).alias("kids"))
        joined = state.join(nodes, [*_CELL, "block"])
        # The last of the edges to the left; behind it lies the next one of the node, or of the node above.
        left = F.aggregate("kids", F.lit(0), lambda n, e: F.when(_x_at(F.col("py"), e) < F.col("px"), (e["at"] / step).cast("int") % FAN + 1).otherwise(n))
        found = joined.withColumn("_n", left)
        state = cut_lineage(found.select(
            *_CELL, "pid", "px", "py", F.greatest(F.col("block") * FAN + F.col("_n") - 1, F.lit(0)).alias("block"),
            F.when(F.col("_n") > 0, F.get("kids", F.col("_n") - 1)).otherwise(F.col("lo")).alias("lo"), F.coalesce(F.get("kids", F.col("_n")), "hi").alias("hi")))
    first = state.where("lo is not null").select("doc_id", "pid", F.col("lo.cluster").alias("cluster"), _x_at(F.col("py"), F.col("lo")).alias("x"))
    # Crossing edges of one cluster lie side by side but in no order, so of such a cluster at either side all edges of the slab are looked at.
    beside = state.select(*_CELL, "pid", "px", "py", F.explode(F.array("lo", "hi")).alias("e")).where("e.tangled").select(*_CELL, "pid", "px", "py", "e.cluster").distinct()
    crossed = beside.join(filed.where("tangled").select(*_CELL, "cluster", *_ENDS), [*_CELL, "cluster"]).withColumn("x", _x_at(F.col("py"))).where("x < px").select("doc_id", "pid", "cluster", "x")
    return first.unionByName(crossed).groupBy("doc_id", "pid").agg(F.max(F.struct("x", "cluster"))["cluster"].alias("hit"))


def holders(points: DataFrame, ring: DataFrame, few: bool = False) -> DataFrame:
    """``doc_id, pid, outer``: outlines of the point's ``cluster`` that hold the point; long ones are cut into y bands.

    ``few``: no cluster has many points or outlines, so that boxes need no grid.
    """
    boxes = ring.groupBy("doc_id", "cluster", "node").agg(
        *[F.min(F.least(f"{c}1", f"{c}2")).alias(f"min_{c}") for c in "xy"], *[F.max(F.greatest(f"{c}1", f"{c}2")).alias(f"max_{c}") for c in "xy"], F.count("*").alias("n"),
    ).where("n >= 3").withColumn("bands", F.ceil(F.sqrt(F.col("n") / 4.0)).cast("int")).withColumn("height", F.greatest((F.col("max_y") - F.col("min_y")) / F.col("bands"), F.lit(1e-12)))

    def band(y: Column) -> Column:
        return F.least(F.greatest(F.floor((y - F.col("min_y")) / F.col("height")), F.lit(0)), F.col("bands") - 1)

    filed = ring.join(boxes.select(*NODE, "min_y", "height", "bands"), NODE).withColumn("band", F.explode(F.sequence(band(F.least("y1", "y2")), band(F.greatest("y1", "y2"))))).select(
        "doc_id", F.col("node").alias("outer"), "band", *_ENDS)
    scope = F.struct("doc_id", "cluster").alias("scope")
    asked = points.select(scope, "pid", "px", "py")
    boxed = boxes.select(scope, F.col("node").alias("outer"), "min_x", "min_y", "max_x", "max_y", "bands", "height")
    met = asked.join(shuffled(boxed), "scope").where("px between min_x and max_x and py between min_y and max_y") if few else points_in_boxes(asked, boxed, "scope")
    held = met.withColumn("band", band(F.col("py")))
    hits = geometry.crosses_right((F.col("px"), F.col("py")), (F.col("x1"), F.col("y1")), (F.col("x2"), F.col("y2")))
    return held.select("scope.doc_id", "pid", "outer", "band", "px", "py").join(filed, ["doc_id", "outer", "band"]).groupBy("doc_id", "pid", "outer").agg(F.count_if(hits).alias("hits")).where("hits % 2 = 1").select("doc_id", "pid", "outer")


def containment_pairs(vertices: DataFrame, shaped: DataFrame | None = None) -> DataFrame:
    """``inner, outer``: the inward point of shape ``inner`` lies inside polygon ``outer``; all pairs, for callers who want each of them.

    A shape holds its own point too; that row stands for the copies it has.
    ``shaped`` folds copies of the same direction only (``shapes(..., either_way=False)``).
    """
    shaped = shapes(vertices, either_way=False) if shaped is None else shaped
    firsts = cut_lineage(shape_members(vertices, shaped))
    points = inward_points(firsts).select("doc_id", F.col("node").alias("pid"), "px", "py", F.lit(0).alias("cluster"))
    return holders(points, with_node(edges(firsts)).withColumn("cluster", F.lit(0))).select("doc_id", F.col("pid").alias("inner"), "outer")


def around_clusters(links: DataFrame) -> DataFrame:
    """``depth, parent`` summed up along ``up``, each pass looking twice as far (``doc_id, cluster, up, depth, parent``)."""
    state = cut_lineage(links)
    while True:
        above = state.select("doc_id", F.col("cluster").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"), F.col("parent").alias("_parent"))
        state = cut_lineage(state.join(above, ["doc_id", "up"], "left").select(
            "doc_id", "cluster", F.col("_up").alias("up"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), F.coalesce("parent", "_parent").alias("parent")))
        if state.where("up is not null").isEmpty():
            return state.drop("up")


def nesting(vertices: DataFrame, shaped: DataFrame | None = None, few: int = FEW) -> DataFrame:
    """Depth and direct parent of every outline (``doc_id, node, depth, parent, area``).

    Depth counts the other outlines around the inward point, copies included; the
    parent is the smallest of them with an area, the first one on ties.  Documents
    with more than ``few`` distinct outlines go by rays, the others by pairs.
    """
    shaped = cut_lineage(shapes(vertices, either_way=False)) if shaped is None else shaped
    large = cut_lineage(shaped.where("node = shape").groupBy("doc_id").agg(F.count("*").alias("k")).where(F.col("k") > few).select("doc_id"))
    if large.isEmpty():
        return _by_pairs(vertices, shaped)
    small = _by_pairs(*[df.join(large, "doc_id", "left_anti") for df in (vertices, shaped)])
    return small.unionByName(_by_rays(*[df.join(large, "doc_id", "left_semi") for df in (vertices, shaped)]))


def _prepared(vertices: DataFrame, shaped: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The vertices of the distinct outlines, the area of every outline, and per distinct outline its copies, area and second copy."""
    firsts = cut_lineage(shape_members(vertices, shaped))
    area = cut_lineage(with_node(polygon_area(vertices)).select(*NODE, "area"))
    second = shaped.where("node <> shape").groupBy("doc_id", F.col("shape").alias("node")).agg(F.min("node").alias("second"))
    sizes = shaped.where("node = shape").select(*NODE, "copies")
    return firsts, area, sizes.join(area, NODE).join(second, NODE, "left").select("doc_id", F.col("node").alias("outer"), "copies", "area", "second")


def _by_pairs(vertices: DataFrame, shaped: DataFrame) -> DataFrame:
    """:func:`nesting` from the outlines that hold each inward point, for documents of few distinct outlines."""
    firsts, area, sized = _prepared(vertices, shaped)
    alone = F.lit(0).alias("cluster")
    points = inward_points(firsts).select("doc_id", F.col("node").alias("pid"), "px", "py", alone)
    held = holders(points, with_node(edges(firsts)).select(*NODE, "i", *_ENDS, alone), few=True).join(shuffled(sized), ["doc_id", "outer"])
    itself = F.col("outer") == F.col("pid")

    def smallest(condition: Column, node: str) -> Column:
        return F.min(F.when(condition & (F.col("area") > 0), F.struct("area", F.col(node).alias("node"))))

    per_point = held.groupBy("doc_id", "pid").agg(
        (F.sum("copies") - F.max(itself.cast("int"))).alias("depth"), smallest(~itself, "outer").alias("other"),
        smallest(itself, "outer").alias("own_first"), smallest(itself & F.col("second").isNotNull(), "second").alias("own_second"))
    rows = shaped.select(*NODE, F.col("shape").alias("pid")).join(shuffled(per_point), ["doc_id", "pid"], "left").join(area, NODE)
    mine = F.when(F.col("node") == F.col("pid"), F.col("own_second")).otherwise(F.col("own_first"))
    return rows.select(*NODE, F.coalesce("depth", F.lit(0)).alias("depth"), F.least(F.col("other"), mine)["node"].alias("parent"), "area")


def _by_rays(vertices: DataFrame, shaped: DataFrame) -> DataFrame:
    """:func:`nesting` by one ray an outline.

    What lies all around a cluster is larger than all in it, so the smallest one is
    searched from the inside out.
    """
    shaped = cut_lineage(shaped)
    firsts, area, sized = _prepared(vertices, shaped)
    sized = cut_lineage(sized)
    sizes = shaped.where("node = shape").select(*NODE, "n")
    bare = cut_lineage(with_node(edges(firsts)).join(sizes, NODE).select(*NODE, "i", "n", *_ENDS))
    clusters = cut_lineage(contact_clusters(bare))
    ring = cut_lineage(bare.join(clusters, NODE))

    # One point per outline inside it, one per cluster just left of its left end (pid: outline 2k, cluster 2k + 1).
    inward = inward_points(firsts).join(clusters, NODE).select("doc_id", (F.col("node") * 2).alias("pid"), "px", "py", F.col("cluster").alias("own"))
    corner = ring.groupBy("doc_id", "cluster").agg(F.min(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"))).alias("p"))
    ends = corner.select("doc_id", (F.col("cluster") * 2 + 1).alias("pid"), (F.col("p.x") - (F.abs("p.x") + 1.0) * 1e-12).alias("px"), F.col("p.y").alias("py"), F.col("cluster").alias("own"))
    points = cut_lineage(inward.unionByName(ends))
    ranks = height_ranks(ring.select("doc_id", F.col("y1").alias("y")).unionByName(points.select("doc_id", F.col("py").alias("y"))))
    ranked = points.join(ranks.select("doc_id", F.col("y").alias("py"), "rank"), ["doc_id", "py"])
    hit = cut_lineage(points.select("doc_id", "pid", "own").join(shoot(ranked, filed_edges(ring, ranks)), ["doc_id", "pid"], "left"))

    # Outlines that hold the point, of the cluster that was hit and of the outline's own.
    asked = hit.select("doc_id", "pid", F.explode(F.array_distinct(F.array_compact(F.array("hit", F.when(F.col("pid") % 2 == 0, F.col("own")))))).alias("cluster"))
    held = holders(points.join(asked, ["doc_id", "pid"]), ring).join(sized, ["doc_id", "outer"]).join(clusters.select("doc_id", F.col("node").alias("outer"), "cluster"), ["doc_id", "outer"]).join(hit, ["doc_id", "pid"])
    itself = (F.col("pid") % 2 == 0) & (F.col("outer") * 2 == F.col("pid"))
    in_hit, in_own = F.col("cluster") == F.col("hit"), F.col("cluster") == F.col("own")

    def smallest(condition: Column, node: str) -> Column:
        return F.min(F.when(condition & (F.col("area") > 0), F.struct("area", F.col(node).alias("node"), "cluster")))

    per_point = cut_lineage(held.groupBy("doc_id", "pid").agg(
        F.sum(F.when(in_hit, F.col("copies")).otherwise(0)).alias("held"), F.max(itself.cast("int")).alias("inside_itself"), smallest(in_hit & ~itself, "outer").alias("other"), smallest(in_own & ~itself, "outer").alias("beside"),
        smallest(itself, "outer").alias("own_first"), smallest(itself & F.col("second").isNotNull(), "second").alias("own_second")))
    known = hit.join(per_point, ["doc_id", "pid"], "left").na.fill(0, ["held", "inside_itself"])
    around = around_clusters(known.where("pid % 2 = 1").select("doc_id", F.col("own").alias("cluster"), F.col("hit").alias("up"), F.col("held").alias("depth"), F.struct("other.node", "other.cluster").alias("parent")).withColumn(
        "parent", F.when(F.col("parent.node").isNotNull(), F.col("parent"))))
    both = known.where("pid % 2 = 0")
    for name in ("hit", "own"):
        both = both.join(around.select("doc_id", F.col("cluster").alias(name), F.col("depth").alias(f"{name}_depth"), F.col("parent").alias(f"{name}_parent")), ["doc_id", name], "left")
    rows = shaped.withColumn("pid", F.col("shape") * 2).join(both, ["doc_id", "pid"], "left").join(area, NODE)
    mine = F.when(F.col("node") == F.col("shape"), F.col("own_second")).otherwise(F.col("own_first"))
    # Where the first edge to the left belongs to something inside the outline, what is around that may be the outline itself; then its own cluster decides.
    own_parent = F.coalesce(F.least(F.col("beside"), mine)["node"], F.col("own_parent.node"))
    through = F.when(F.col("hit_parent.cluster") == F.col("own"), own_parent).otherwise(F.col("hit_parent.node"))
    parent = F.when(F.col("hit") == F.col("own"), own_parent).otherwise(F.coalesce(F.col("other.node"), through))
    depth = F.coalesce(F.col("held") + F.coalesce("hit_depth", F.lit(0)) - F.col("inside_itself"), F.lit(0))
    return rows.select(*NODE, depth.alias("depth"), parent.alias("parent"), "area")
