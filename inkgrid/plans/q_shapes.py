"""Tracing, rasterising, simplification and union queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkgrid.functions import svgtext
from inkgrid.operators import outlines, raster, simplify, svg, union
from inkgrid.plans import views
from inkgrid.plans.q_outlines import _DISTS, _EDGES, _V
from inkgrid.plans.registry import query
from inkgrid.plans.views import ctes
from inkgrid.session import cut_lineage

# Lattice marks of the masks: which of the four pixels around a point are set.
_MARKS = ctes("mask_pixels") + """, marks as (select image_id, mask_id, x+dx as x, y+dy as y, bit_or(b) as pattern from mask_pixels
  cross join (values (0,0,8),(1,0,4),(0,1,2),(1,1,1)) as q(dx,dy,b) group by 1,2,3,4)
, nodes as (select image_id, mask_id, sum(case when pattern in (1,2,4,8,7,11,13,14) then 1 when pattern in (6,9) then 2 else 0 end) as node_count from marks group by 1,2)
, sizes as (select image_id, mask_id, count(*) as pixels from mask_pixels group by 1,2)
"""


@query("trace_masks", _MARKS + """select image_id, mask_id, cast(node_count as bigint) as node_count, cast(pixels as double) as enclosed_area from nodes join sizes using (image_id, mask_id)""")
def trace_masks(spark, d):
    """Corner count of every traced mask; outer rings minus holes enclose exactly its pixels."""
    rings = raster.ring_table(raster.trace_masks(views.mask_pixels(spark, d)))
    return rings.groupBy("image_id", "mask_id").agg(F.sum("corners").alias("node_count"), F.sum("signed_area").alias("enclosed_area"))


# Unit edges with the mask on their right; at a point where two pixels meet by a corner, the way turns right and so stays with its pixel.
# Directions are 0 right, 1 down, 2 left, 3 up.  Every corner walks on until it meets a smaller one; the smallest closes its ring.
_WALK = ctes("mask_pixels").replace("with", "with recursive", 1) + """, mp as (select distinct image_id, mask_id, x::bigint as x, y::bigint as y from mask_pixels)
, sides as (select * from (values (0,-1,0,0,0), (1,0,1,0,1), (0,1,1,1,2), (-1,0,0,1,3)) t(sx,sy,ox,oy,d))
, unit as (select image_id, mask_id, x+ox as x, y+oy as y, d from mp, sides where not exists (
  select 1 from mp o where o.image_id=mp.image_id and o.mask_id=mp.mask_id and o.x=mp.x+sx and o.y=mp.y+sy))
, step as (select * from (values (0,1,0,1), (1,0,1,2), (2,-1,0,3), (3,0,-1,0)) t(d,dx,dy,rightwards))
, corner as (select * from (select u.image_id, u.mask_id, u.x+s.dx as x, u.y+s.dy as y, u.d as din,
    arg_min(v.d, case when v.d=s.rightwards then 0 when v.d=u.d then 1 else 2 end) as dout
  from unit u join step s on s.d=u.d join unit v on v.image_id=u.image_id and v.mask_id=u.mask_id and v.x=u.x+s.dx and v.y=u.y+s.dy
  group by all) where din <> dout)
, named as (select *, y*17179869184 + x*4 + din as cid from corner)
, jump as (select a.image_id, a.mask_id, a.cid, arg_min(b.cid, (b.x-a.x)*s.dx+(b.y-a.y)*s.dy) as ncid from named a join step s on s.d=a.dout
  join named b on b.image_id=a.image_id and b.mask_id=a.mask_id and b.din=a.dout and (b.x-a.x)*s.dx+(b.y-a.y)*s.dy > 0 and (b.x-a.x)*s.dy=0 and (b.y-a.y)*s.dx=0 group by 1,2,3)
, walk as (select image_id, mask_id, cid as ring, 0 as i, cid as here from named
  union all select w.image_id, w.mask_id, w.ring, w.i+1, j.ncid from walk w join jump j on j.image_id=w.image_id and j.mask_id=w.mask_id and j.cid=w.here where j.ncid > w.ring)
, closed as (select w.image_id, w.mask_id, w.ring from walk w join jump j on j.image_id=w.image_id and j.mask_id=w.mask_id and j.cid=w.here where j.ncid = w.ring)
select w.image_id, w.mask_id, cast(w.ring as bigint) as ring, cast(w.i as int) as i, cast(n.x as double) as x, cast(n.y as double) as y
  from walk w join closed using (image_id, mask_id, ring) join named n on n.image_id=w.image_id and n.mask_id=w.mask_id and n.cid=w.here"""


@query("trace_rings", _WALK)
def trace_rings(spark, d):
    return raster.trace_masks(views.mask_pixels(spark, d))


@query("rasterize", _V + """, canvas as (select distinct doc_id, 500 as width, 320 as height from vertices)
, solid as (select * from rings)
, spans as (select doc_id, path_index, cast(ceil(x0-0.5) as int) as xa, cast(ceil(x1-0.5) as int) as xb, cast(ceil(y0-0.5) as int) as ya, cast(ceil(y1-0.5) as int) as yb from solid)
, cells as (select doc_id, y, unnest(range(greatest(xa,0), least(xb,500))) as x from (select doc_id, xa, xb, unnest(range(greatest(ya,0), least(yb,320))) as y from spans))
select doc_id, cast(y as int) as y, cast(x as int) as x from cells group by 1,2,3 having count(*) % 2 = 1""")
def rasterize(spark, d):
    """All outlines, open ones included, filled by the even-odd rule over the whole document."""
    v = views.vertices(spark, d)
    canvas = views.vertices(spark, d).select("doc_id").distinct().withColumns({"width": F.lit(500), "height": F.lit(320)})
    return raster.rasterize(outlines.edges(v), canvas, ["doc_id"], ["doc_id"])


@query("trace_layers", _MARKS.replace("with ", "with ", 1) + ctes("masks").replace("with ", ", ", 1) + """, found as (select image_id, mask_id, cast(node_count as bigint) as node_count from nodes)
select m.image_id, m.mask_id, coalesce(node_count, 0) as node_count, case when node_count is not null then cast(0 as double) end as own_mismatch_ratio,
  case when node_count is not null then cast(0 as double) end as contamination_ratio,
  (select count(*) from found f where f.image_id = m.image_id) = 4 as complete from masks m left join found using (image_id, mask_id)""")
def trace_layers(spark, d):
    return raster.trace_layers(views.mask_pixels(spark, d), views.masks(spark, d), views.canvas(spark, d))


# Recursive Douglas-Peucker over the opened outlines.
_SIMPLE = _V.replace("with ", "with recursive ", 1) + _EDGES + """, opened as (select doc_id, path_index, subpath_index, i, x, y from vertices
  union all select doc_id, path_index, subpath_index, n_points, x1, y1 from edges join subs using (doc_id, path_index, subpath_index) where i = 0 and edges.closed)
, span(doc_id, path_index, subpath_index, lo, hi) as (
  select doc_id, path_index, subpath_index, cast(0 as bigint), case when closed then n_points else n_points-1 end from subs where n_points >= 3
  union all
  select t.doc_id, t.path_index, t.subpath_index, case when side=0 then lo else mid end, case when side=0 then mid else hi end from (
    select s.doc_id, s.path_index, s.subpath_index, s.lo, s.hi, max(gap) as gap, arg_max(i, (gap, -i)) as mid, any_value(eps) as eps from (
      select s.*, p.i, b.diagonal*{ratio} as eps, case when s2.x=s1.x and s2.y=s1.y then sqrt(pow(p.x-s1.x,2)+pow(p.y-s1.y,2))
        else abs((s2.y-s1.y)*p.x-(s2.x-s1.x)*p.y+s2.x*s1.y-s2.y*s1.x)/sqrt(pow(s2.x-s1.x,2)+pow(s2.y-s1.y,2)) end as gap
      from span s join opened p on p.doc_id=s.doc_id and p.path_index=s.path_index and p.subpath_index=s.subpath_index and p.i>s.lo and p.i<s.hi
        join opened s1 on s1.doc_id=s.doc_id and s1.path_index=s.path_index and s1.subpath_index=s.subpath_index and s1.i=s.lo
        join opened s2 on s2.doc_id=s.doc_id and s2.path_index=s.path_index and s2.subpath_index=s.subpath_index and s2.i=s.hi
        join box b on b.doc_id=s.doc_id) s group by 1,2,3,4,5) t cross join (select unnest([0,1]) as side) where gap > eps)
, kept as (select distinct doc_id, path_index, subpath_index, unnest([lo,hi]) as i from span)
, inring as (select k.* from kept k join subs s using (doc_id, path_index, subpath_index) where k.i < s.n_points)
, fine as (select doc_id, path_index, subpath_index from inring join subs using (doc_id, path_index, subpath_index)
  group by 1,2,3 having count(*) >= case when any_value(closed) then 3 else 2 end)
, simple as (select v.* from vertices v join fine using (doc_id, path_index, subpath_index) join inring k using (doc_id, path_index, subpath_index, i)
  union all select v.* from vertices v where not exists (select 1 from fine f where f.doc_id=v.doc_id and f.path_index=v.path_index and f.subpath_index=v.subpath_index))
"""
_RATIO = 0.02


@query("simplify", _SIMPLE.replace("{ratio}", repr(_RATIO)) + "select doc_id, path_index, subpath_index, i, x, y from simple")
def simplify_query(spark, d):
    v = views.vertices(spark, d)
    return simplify.simplify(v, outlines.document_bounds(v), _RATIO).select("doc_id", "path_index", "subpath_index", "i", "x", "y")


@query("simplified_documents", _SIMPLE.replace("{ratio}", repr(_RATIO)) + """, p as (select doc_id, count(distinct path_index) as paths from vertices group by 1)
select doc_id, paths, count(*) as nodes, round(sum(x),3) as x, round(sum(y),3) as y from simple join p using (doc_id) group by 1,2""")
def simplified_documents(spark, d):
    """Documents written, simplified as text, and read again."""
    docs = cut_lineage(svg.svg_documents(views.vertices(spark, d), views.vertices(spark, d).select("doc_id").distinct().withColumns({"width": F.lit(500), "height": F.lit(320)})))
    fewer = cut_lineage(simplify.simplified_documents(docs, _RATIO))
    paths = svg.svg_paths(fewer).groupBy("doc_id").agg(F.count("*").alias("paths"))
    nodes = svg.svg_to_vertices(fewer).groupBy("doc_id").agg(F.count("*").alias("nodes"), F.round(F.sum("x"), 3).alias("x"), F.round(F.sum("y"), 3).alias("y"))
    return nodes.join(paths, "doc_id").select("doc_id", "paths", "nodes", "x", "y")


@query("mask_documents", ctes("mask_pixels") + """, named as (select image_id, mask_id, dense_rank() over (partition by image_id order by mask_id) - 1 as path_index
  from (select distinct image_id, mask_id from mask_pixels))
select image_id as doc_id, cast(path_index as int) as path_index, printf('#%06x', (mask_id*7919+image_id)%16777216) as fill, cast(y as int) as y, cast(x as int) as x
  from mask_pixels join named using (image_id, mask_id)""")
def mask_documents(spark, d):
    """Masks to documents with fills; parsed and filled again, each path gives exactly the pixels of its mask."""
    fills = views.masks(spark, d).select("image_id", "mask_id", F.concat(F.lit("#"), F.lower(F.lpad(F.hex((F.col("mask_id") * 7919 + F.col("image_id")) % 16777216), 6, "0"))).alias("fill"))
    docs = cut_lineage(raster.mask_documents(views.mask_pixels(spark, d), views.canvas(spark, d), fills))
    canvas = views.canvas(spark, d).select(F.col("image_id").alias("doc_id"), "width", "height")
    filled = raster.rasterize(outlines.edges(svg.svg_to_vertices(docs)), canvas, ["doc_id", "path_index"], ["doc_id"])
    colour = svg.svg_paths(docs).select("doc_id", "path_index", svgtext.attribute(F.col("tag"), "fill").alias("fill"))
    return filled.join(colour, ["doc_id", "path_index"]).select("doc_id", "path_index", "fill", "y", "x")


@query("reduction_percent", _SIMPLE.replace("{ratio}", repr(_RATIO)) + """, b as (select doc_id, count(*) as nodes_before from vertices group by 1)
, a as (select doc_id, count(*) as nodes_after from simple group by 1)
select doc_id, nodes_before, nodes_after, round((nodes_before-nodes_after)/nodes_before*100.0,6) as reduction_percent from b join a using (doc_id)""")
def reduction_percent(spark, d):
    v = views.vertices(spark, d)
    return simplify.reduction(v, simplify.simplify(v, outlines.document_bounds(v), _RATIO)).withColumn(
        "reduction_percent", F.round("reduction_percent", 6)
    )


# ---------------------------------------------------------------------- union

def _members(spark, d):
    """Each row of eight shapes of a document is one selection; copies of a shape are pieces of their own."""
    rows = views.rings(spark, d)
    return rows.select(
        (F.col("doc_id") * 8 + F.floor(F.col("path_index") % 40 / 8)).alias("selection_id"), F.col("path_index").cast("long").alias("piece"),
        *svg.KEY, F.when(F.col("subpath_index") == 1, "hole").otherwise("solid").alias("role"),
    )


_SEL = _V + _EDGES + _DISTS + """, mem as (select doc_id*8 + cast(floor(path_index%40/8) as bigint) as selection_id, cast(path_index as bigint) as piece, doc_id, path_index, subpath_index,
  (cast(path_index as bigint)*4294967296+subpath_index) as node from rings)
, pd as (select a.selection_id, least(a.piece,b.piece) as src, greatest(a.piece,b.piece) as dst, min(dist) as distance from dists d
  join mem a on a.doc_id=d.doc_id and a.node=d.src join mem b on b.doc_id=d.doc_id and b.node=d.dst
  where a.selection_id=b.selection_id and a.piece<>b.piece group by 1,2,3)
, diag as (select distinct selection_id, diagonal from mem join box using (doc_id))
"""


def _segments(spark, d):
    return union.piece_segments(_members(spark, d), views.vertices(spark, d))


def _sizes(spark, d):
    bounds = outlines.document_bounds(views.vertices(spark, d))
    return _members(spark, d).select("selection_id", "doc_id").distinct().join(bounds, "doc_id").select("selection_id", "doc_id", "diagonal")


@query("piece_distances", _SEL + "select selection_id, src, dst, round(distance,6) as distance from pd join diag using (selection_id) where distance <= diagonal*0.1")
def piece_distances(spark, d):
    """All pairs of selected pieces closer than a tenth of the document diagonal."""
    radius = _sizes(spark, d).select("selection_id", (F.col("diagonal") * 0.1).alias("radius"))
    from inkgrid.operators.pairs import near_pieces

    return near_pieces(_segments(spark, d), radius).select("selection_id", "src", "dst", F.round("distance", 6).alias("distance"))


# In a row all shapes start on one line, so the shortest tree is the chain from left to right; a copy lies on its original.
_CHAIN = """, chain as (select doc_id*8 + cast(floor(path_index%40/8) as bigint) as selection_id, greatest(x0 - lag(x1) over (
  partition by doc_id, floor(path_index%40/8) order by x0, path_index), 0) as gap, lag(x1) over (partition by doc_id, floor(path_index%40/8) order by x0, path_index) as before
  from rings where subpath_index = 0)
, tree as (select selection_id, gap from chain where before is not null)
, diag as (select distinct doc_id*8 + cast(floor(path_index%40/8) as bigint) as selection_id, diagonal from rings join box using (doc_id))
, plan as (select selection_id, count(*) filter (where gap > diagonal*0.001) as bridge_count, count(*) as n, round(sum(gap),6) as total_length
  from tree join diag using (selection_id) group by 1)
"""


def _tree(spark, d):
    return union.spanning_tree(union.linking_distances(_segments(spark, d)))


@query("spanning_tree", _V + _EDGES + _CHAIN + "select selection_id, n as tree_edges, total_length from plan")
def spanning_tree(spark, d):
    return _tree(spark, d).groupBy("selection_id").agg(
        F.count("*").alias("tree_edges"), F.round(F.sum("distance"), 6).alias("total_length")
    )


@query("bridge_plan", _V + _EDGES + _CHAIN + """select selection_id, bridge_count, total_length,
  case when bridge_count = 0 then 'boolean_union' when bridge_count = n then 'bridge' else 'mixed' end as strategy from plan""")
def bridge_plan(spark, d):
    return union.bridge_strategy(_tree(spark, d), _sizes(spark, d).select("selection_id", "diagonal")).withColumn(
        "total_length", F.round("total_length", 6)
    )


# Bridges lie on the common upper line of a row.  They run into, or border on, a shape of the row above where that is tall enough.
_BRIDGES = """, bars as (select doc_id, line, x0, y0 - w/2 as top, y0 + w/2 as bottom, x0 - before as gap, before - greatest(w, (x0-before)*0.05) as lo, x0 + greatest(w, (x0-before)*0.05) as hi
  from (select doc_id, cast(floor(path_index%40/8) as bigint) as line, x0, y0, lag(x1) over (partition by doc_id, floor(path_index%40/8) order by x0, path_index) as before
    from rings where subpath_index = 0)
  join (select doc_id, diagonal, greatest(diagonal*0.02, diagonal*0.004) as w from box) b using (doc_id) where x0 - before > diagonal*0.001)
, bar_cells as (select doc_id, line, cast(ceil(greatest(lo,0)-0.5) as int) as l, cast(ceil(hi-0.5) as int) - 1 as r, cast(ceil(greatest(top,0)-0.5) as int) as t, cast(ceil(bottom-0.5) as int) - 1 as b from bars)
"""
_UNION = """, groups as (select doc_id, line, path_index, x0, x1, y1, sum(starts) over (partition by doc_id, line order by x0, path_index) as grp
  from (select doc_id, cast(floor(path_index%40/8) as bigint) as line, path_index, x0, x1, y1,
    case when x0 - lag(x1) over (partition by doc_id, floor(path_index%40/8) order by x0, path_index) <= 0 then 0 else 1 end as starts from rings where subpath_index = 0))
, counts as (select doc_id, line, count(distinct grp) as own from groups group by 1,2)
, totals as (select doc_id, sum(own) as total from counts group by 1)
, hits as (select b.doc_id, b.line, count(distinct g.grp) as met from bar_cells b join groups g on g.doc_id = b.doc_id and g.line = b.line - 1
    and ((g.y1-1 >= t and g.x0 <= r+1 and g.x1-1 >= l-1) or (g.y1 = t and g.x0 <= r and g.x1-1 >= l)) group by 1,2)
, state as (select c.doc_id, c.line, total, own, coalesce(met, 0) as met from counts c join totals using (doc_id) left join hits using (doc_id, line))
, cell as (select doc_id, path_index, subpath_index, closed, cast(floor(path_index%40/8) as bigint) as line, cast(x0 as int) as xa, cast(x1 as int) as xb, cast(y0 as int) as ya, cast(y1 as int) as yb from rings)
, px as (select doc_id, path_index, line, subpath_index, y, unnest(range(xa, least(xb, 500))) as x from (select *, unnest(range(ya, least(yb, 320))) as y from cell))
, filled as (select doc_id, line, y, x from px group by doc_id, path_index, line, y, x having count(*) % 2 = 1
  union select doc_id, line, y, x from (select *, unnest(range(l, least(r, 499) + 1)) as x from (select *, unnest(range(t, b + 1)) as y from bar_cells)))
, inner_px as (select p.doc_id, p.line, p.path_index from px p where subpath_index = 1 and not exists (select 1 from filled f where f.doc_id = p.doc_id and f.line = p.line and f.y = p.y and f.x = p.x))
, area as (select doc_id, line, cast(count(*) as double) as area from filled group by 1,2)
, inner_area as (select doc_id, line, count(distinct path_index) as holes, cast(count(*) as double) as hole_area from inner_px group by 1,2)
"""


@query("bridge_rectangles", _V + _EDGES + _BRIDGES + """select doc_id*8+line as selection_id, round(lo,6) as min_x, round(hi,6) as max_x, round(top,6) as min_y, round(bottom,6) as max_y, round(gap,6) as distance from bars""")
def bridge_rectangles(spark, d):
    """The corners of every bridge; on the rows of this data all bridges are upright rectangles."""
    plan = union.bridge_plan(_tree(spark, d), _sizes(spark, d))
    xs, ys = F.transform("corners", lambda p: p["x"]), F.transform("corners", lambda p: p["y"])
    ends = [F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)]
    return plan.select("selection_id", *[F.round(e, 6).alias(n) for e, n in zip(ends, ("min_x", "max_x", "min_y", "max_y"), strict=True)], F.round("distance", 6).alias("distance"))


def _union(spark, d):
    """Vertices, pieces, selected pieces, canvas, and what the union of every selection gives."""
    v = cut_lineage(views.vertices(spark, d))
    rows = views.rings(spark, d)
    pieces = rows.select("doc_id", F.col("path_index").cast("long").alias("piece"), "path_index", "subpath_index")
    selected = _members(spark, d).select("selection_id", "doc_id", "piece").distinct()
    canvas = v.select("doc_id").distinct().withColumns({"width": F.lit(500), "height": F.lit(320)})
    bridges = cut_lineage(union.bridge_plan(_tree(spark, d), _sizes(spark, d)))
    return v, pieces, selected, canvas, union.union_pieces(v, pieces, selected, bridges, canvas)


@query("union_pieces", _V + _EDGES + _BRIDGES + _UNION + """select s.doc_id*8+s.line as selection_id, cast(total as bigint) as regions_before, cast(total - own + 1 - met as bigint) as regions_after,
  cast(total - own + 1 as bigint) as regions_expected, met = 0 as accepted, case when met = 0 then area end as area, case when met = 0 then coalesce(holes, 0) end as holes,
  case when met = 0 then coalesce(hole_area, 0::double) end as hole_area from state s join area using (doc_id, line) left join inner_area using (doc_id, line)""")
def union_pieces(spark, d):
    """Every selection is fused with its bridges, or refused where a bridge joins a piece that was not selected; area and holes of the traced result."""
    return _union(spark, d)[-1][0].drop("doc_id")


@query("union_documents", _V + _EDGES + _BRIDGES + _UNION + """, ok as (select doc_id, line, area, coalesce(holes, 0) as holes from state join area using (doc_id, line) left join inner_area using (doc_id, line) where met = 0)
, paths as (select doc_id, line, path_index, sum(case when not closed then 0 when subpath_index = 0 then 1 else -1 end * (xb-xa)*(yb-ya)) as filled, count(*) as outlines from cell group by 1,2,3)
, stays as (select o.doc_id, o.line, count(*) as paths, sum(outlines) as outlines, cast(sum(p.filled) as double) as filled from ok o join paths p on p.doc_id = o.doc_id and p.line <> o.line group by 1,2)
select doc_id*8+line as doc_id, cast(coalesce(paths,0)+1 as bigint) as paths, cast(coalesce(outlines,0) + 1 + holes as bigint) as outlines, coalesce(filled,0::double) + area as filled from ok left join stays using (doc_id, line)""")
def union_documents(spark, d):
    """The documents that come out, written and read again: what was not selected is there, and one fused path with its holes."""
    v, pieces, selected, canvas, (_, result) = _union(spark, d)
    fills = v.select("doc_id", "path_index").distinct().withColumn("fill", F.lit("#123456"))
    docs = cut_lineage(union.union_documents(result, selected, pieces, canvas, fills))
    again = svg.svg_to_vertices(docs)
    cross = F.when(F.col("closed"), F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")).otherwise(0.0)  # open outlines have a loose end, which the SQL leaves out
    area = outlines.edges(again).groupBy("doc_id", "path_index", "subpath_index").agg((F.sum(cross) / 2).alias("signed"))
    inner = F.col("subpath_index") > 0
    return area.groupBy("doc_id").agg(F.count_distinct("path_index").alias("paths"), F.count("*").alias("outlines"),
                                      F.round(F.sum(F.when(inner, -F.abs("signed")).otherwise(F.abs("signed"))), 0).alias("filled"))


@query("validate_selection", """with mem as (select cast(floor(p_partkey/3) as bigint) as selection_id, p_partkey as k, p_size, p_brand from part)
, agg as (select selection_id, count(*) as k, count(distinct case when p_brand = 'Brand#7' then selection_id*3 else k end) as kinds,
  count(*) filter (where p_size = 50) as missing, count(*) filter (where p_size = 49) as crossing,
  count(*) filter (where p_size % 10 = 3 and p_size < 49) as hollow from mem group by 1)
select selection_id, case when k < 2 then 'too_few_pieces' when kinds < k then 'repeated_pieces' when missing > 0 then 'missing_member'
  when crossing > 0 then 'invalid_ring' when hollow > 0 then 'no_solid' end as reason from agg""")
def validate_selection(spark, d):
    key, size = F.col("p_partkey"), F.col("p_size")
    base = views.table(spark, d, "part").select(
        F.floor(key / 3).alias("selection_id"), F.floor(key / 3).alias("doc_id"), key, size, "p_brand",
    )
    named = F.when(F.col("p_brand") == "Brand#7", F.col("selection_id") * 3).otherwise(key)
    pieces = base.select("selection_id", "doc_id", named.cast("string").alias("component_id"))
    members = base.select(
        "selection_id", "doc_id", named.cast("string").alias("component_id"), (key % 3).cast("int").alias("path_index"),
        F.lit(0).alias("subpath_index"), F.when((size % 10 == 3) & (size < 49), "hole").otherwise("solid").alias("role"),
    )
    x = (key % 3 * 100).cast("double")
    corner = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    bow = [(0.0, 0.0), (10.0, 10.0), (10.0, 0.0), (0.0, 10.0)]

    def ring(points):
        return F.array(*[F.struct((x + px).alias("x"), F.lit(py).alias("y")) for px, py in points])

    v = base.where("p_size <> 50").select(
        "doc_id", (key % 3).cast("int").alias("path_index"), F.lit(0).alias("subpath_index"), F.lit(True).alias("closed"),
        F.posexplode(F.when(size == 49, ring(bow)).otherwise(ring(corner))).alias("i", "p"),
    ).select("doc_id", "path_index", "subpath_index", "closed", "i", "p.x", "p.y")
    return union.validate_selection(pieces, members, v).select("selection_id", "reason")
