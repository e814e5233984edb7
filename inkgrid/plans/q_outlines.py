"""SVG, outline, pair, component and check queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkgrid.operators import components, graph, nesting, outlines, pairs, svg
from inkgrid.operators.svg import KEY
from inkgrid.plans import views
from inkgrid.plans.registry import query
from inkgrid.plans.views import ctes

_V = ctes("vertices")
# distinct source columns, one LONG per outline as in the library
NODE = "(cast(path_index as bigint) * 4294967296 + subpath_index)"
_EDGES = """, subs as (select doc_id, path_index, subpath_index, any_value(closed) as closed, count(*) as n_points, min(x) as min_x, min(y) as min_y,
  max(x) as max_x, max(y) as max_y from vertices group by 1,2,3)
, edges as (select v.doc_id, v.path_index, v.subpath_index, v.closed, v.i, v.x as x1, v.y as y1, w.x as x2, w.y as y2, v.i = s.n_points-1 as closing
  from vertices v join subs s using (doc_id, path_index, subpath_index) join vertices w on w.doc_id=v.doc_id and w.path_index=v.path_index
    and w.subpath_index=v.subpath_index and w.i = (v.i+1) % s.n_points)
, box as (select doc_id, sqrt(pow(max(x)-min(x),2)+pow(max(y)-min(y),2)) as diagonal, (max(x)-min(x))*(max(y)-min(y)) as box_area from vertices group by 1)
, areas as (select doc_id, path_index, subpath_index, case when count(*) >= 3 then abs(sum(x1*y2-x2*y1))/2.0 else 0.0 end as area from edges group by 1,2,3)
"""
_CANVAS = ", docs as (select distinct doc_id from vertices)"


def _v(spark, d):
    return views.vertices(spark, d)


def _docs(spark, d):
    """SVG text of every document, written from the outlines."""
    v = _v(spark, d)
    canvas = v.select("doc_id").distinct().withColumns({"width": F.lit(500), "height": F.lit(320)})
    return svg.svg_documents(v, canvas)


_SUBTEXT = """, subtext as (select doc_id, path_index, subpath_index, concat('M', string_agg(printf('%.3f,%.3f', x, y), 'L' order by i),
  case when any_value(closed) then 'Z' else '' end) as t from vertices group by 1,2,3)
, ptext as (select doc_id, path_index, string_agg(t, '' order by subpath_index) as d from subtext group by 1,2)
, docs as (select doc_id, concat('<svg xmlns="http://www.w3.org/2000/svg" width="500" height="320">',
  string_agg(concat('<path fill-rule="evenodd" d="', d, '"/>'), '' order by path_index), '</svg>') as svg from ptext group by 1)
"""


@query("write_svg", _V + _SUBTEXT + "select doc_id, svg from docs")
def write_svg(spark, d):
    return _docs(spark, d)


@query("svg_to_vertices", _V + """select doc_id,
  cast(dense_rank() over (partition by doc_id order by path_index) - 1 as int) as path_index, subpath_index, closed, i, round(x,6) as x, round(y,6) as y from vertices""")
def svg_to_vertices(spark, d):
    """Written and parsed again, the outlines are the same."""
    return svg.svg_to_vertices(_docs(spark, d)).withColumns({c: F.round(c, 6) for c in "xy"})


@query("svg_stats", _V + """select doc_id, count(distinct path_index) as path_count, count(*) as node_count, min(x) as min_x, min(y) as min_y,
  max(x) as max_x, max(y) as max_y, max(x)-min(x) as width, max(y)-min(y) as height from vertices group by 1""")
def svg_stats(spark, d):
    return svg.svg_stats(_docs(spark, d))


@query("skipped_paths", _V + "select doc_id, count(distinct path_index) filter (where path_index % 7 = 0) as skipped_path_count from vertices group by 1")
def skipped_paths(spark, d):
    return svg.skipped_paths(_rotated(spark, d))


def _rotated(spark, d):
    """Every seventh path is rotated, which the outline analysis cannot read."""
    paths = svg.path_text(_v(spark, d))
    tag = F.concat(
        F.lit("<path"), F.when(F.col("path_index") % 7 == 0, ' transform="rotate(10)"').otherwise(' transform="translate(3, 4)"'),
        F.lit(' d="'), F.col("d"), F.lit('"/>'),
    )
    body = F.array_sort(F.collect_list(F.struct("path_index", tag.alias("e"))))
    return paths.groupBy("doc_id").agg(F.array_join(F.transform(body, lambda p: p["e"]), "").alias("b")).select(
        "doc_id", F.concat(F.lit('<svg viewBox="0 0 500 320">'), "b", F.lit("</svg>")).alias("svg")
    )


@query("path_order", _V + """select doc_id, row_number() over (partition by doc_id order by path_index) - 1 as path_index, path_index % 7 <> 0 as supported
  from (select distinct doc_id, path_index from vertices)""")
def path_order(spark, d):
    return svg.path_order(_rotated(spark, d)).withColumn("path_index", F.col("path_index").cast("long"))


_ROT = """, tags as (select doc_id, path_index, case when path_index % 7 = 0 then 'rotate(10)' else 'translate(3, 4)' end as transform
  from (select distinct doc_id, path_index from vertices))
, ranked as (select *, row_number() over (partition by doc_id order by path_index) - 1 as n from tags)
"""


@query("layer_paths", _V + _ROT + """select doc_id, cast(n as int) as path_index, '#000000' as fill,
  case when path_index % 7 = 0 then 0.0 else 3.0 end as x, case when path_index % 7 = 0 then 0.0 else 4.0 end as y,
  case when path_index % 7 = 0 then 10.0 else 0.0 end as rotation, 1.0 as scale_x, 1.0 as scale_y, 0.0 as skew_x from ranked""".replace("0.0", "0::double").replace("3.0", "3::double").replace("4.0", "4::double").replace("10.0", "10::double").replace("1.0 as", "1::double as"))
def layer_paths(spark, d):
    found = svg.layer_paths(_rotated(spark, d), "#000000")
    return found.drop("d", "reason").withColumns({c: F.round(c, 6) for c in ("x", "y", "rotation", "scale_x", "scale_y", "skew_x")})


@query("fill_layers", _V + ", p as (select distinct doc_id, path_index from vertices)" + """
select doc_id, path_index, concat('<path fill="', printf('#%06x', (doc_id*7919)%16777216), '" d="M0,0"/>') as tag from p""")
def fill_layers(spark, d):
    paths = _v(spark, d).select("doc_id", "path_index").distinct().withColumn("tag", F.lit('<path d="M0,0" fill="red"/>'))
    groups = _v(spark, d).select("doc_id").distinct().withColumn(
        "color_hex", F.concat(F.lit("#"), F.lower(F.lpad(F.hex((F.col("doc_id") * 7919) % 16777216), 6, "0")))
    )
    return svg.fill_layers(paths, groups)


@query("sanitize_markup_findings", """select page_id,
  cast(len(regexp_extract_all(html, '(?i)<!\\s*(DOCTYPE|ENTITY)')) as int) as declarations,
  cast(len(regexp_extract_all(html, '(?i)<(?:[\\w.-]+:)?(script|foreignobject|iframe|embed|object|audio|video|style)\\b')) as int) as unsafe_elements,
  cast(len(regexp_extract_all(html, '(?i)\\son[a-z]+\\s*=\\s*["'']')) as int) as event_attributes,
  cast(len(regexp_extract_all(html, '(?i)\\shref\\s*=\\s*["''][^#"'']')) as int) as foreign_links,
  cast(len(regexp_extract_all(html, '(?i)javascript:')) as int) as script_values from pages""")
def sanitize_markup_findings(spark, d):
    return svg.markup_findings(views.table(spark, d, "pages"), "page_id", "html")


_UNSAFE_DOC = "concat(replace(svg, '<path ', '<path onclick=\"x()\" href=\"http://a\" '))"


@query("sanitize_markup", _V + _SUBTEXT + """select doc_id, case when doc_id % 5 = 0 then 'declaration' when doc_id % 5 = 1 then 'malformed' end as reason,
  case when doc_id % 5 in (0,1) then 0 else (select count(*) from ptext p where p.doc_id = docs.doc_id) + 1 end as removed from docs""")
def sanitize_markup(spark, d):
    """Scripts, event handlers and references are taken out; declarations and broken XML are refused."""
    bad = F.replace(F.replace("svg", F.lit("<path "), F.lit('<path onclick="x()" ')), F.lit("</svg>"), F.lit("<script>x</script></svg>"))
    docs = _docs(spark, d).withColumn("svg", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("<!DOCTYPE svg>"), bad)).when(
        F.col("doc_id") % 5 == 1, F.concat(bad, F.lit("<"))).otherwise(bad))
    clean = svg.sanitize_markup(docs)
    return clean.select("doc_id", "reason", F.col("removed").cast("long").alias("removed"))


@query("sanitized_text", _V + _SUBTEXT + """select doc_id, replace(svg, '"/>', '" />') as svg from docs""")
def sanitized_text(spark, d):
    """The cleaned text itself: handlers, foreign links, script values, foreign url() and unsafe elements are gone, the drawing is as it was."""
    attributes = """<path onclick="x()" href="http://a/b" clip-path="url(http://c#d)" stroke=" JavaScript:x" """
    elements = "<script>x</script><style>p {}</style><foreignObject><p xmlns='http://www.w3.org/1999/xhtml'>x</p></foreignObject></svg>"
    bad = F.replace(F.replace("svg", F.lit("<path "), F.lit(attributes)), F.lit("</svg>"), F.lit(elements))
    return svg.sanitize_markup(_docs(spark, d).withColumn("svg", bad)).select("doc_id", "svg")


@query("svg_stats_checked", _V + """select doc_id, case when doc_id % 5 = 0 then 'declaration' when doc_id % 5 = 1 then 'malformed' end as reason,
  case when doc_id % 5 > 1 then count(distinct path_index) end as path_count, case when doc_id % 5 > 1 then count(*) end as node_count, case when doc_id % 5 > 1 then max(x)-min(x) end as width,
  case when doc_id % 5 > 1 then max(y)-min(y) end as height from vertices group by 1""")
def svg_stats_checked(spark, d):
    """Statistics refuse what cannot be read instead of counting what happens to match."""
    broken = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("<!DOCTYPE svg>"), "svg")).when(F.col("doc_id") % 5 == 1, F.replace("svg", F.lit("</svg>"), F.lit("</path>"))).otherwise(F.col("svg"))
    return svg.checked_stats(_docs(spark, d).withColumn("svg", broken)).select("doc_id", "reason", "path_count", "node_count", "width", "height")


@query("sanitize_removals", _V + _SUBTEXT + """select doc_id, kind, name, n from (select d.doc_id, 'event' as kind, 'onclick' as name, count(*) as n from docs d join ptext p using (doc_id) group by 1
  union all select doc_id, 'element', 'script', 1 from docs) where doc_id % 5 > 1""")
def sanitize_removals(spark, d):
    """What was taken out, as rows."""
    bad = F.replace(F.replace("svg", F.lit("<path "), F.lit('<path onclick="x()" ')), F.lit("</svg>"), F.lit("<script>x</script></svg>"))
    gone = svg.sanitize_markup(_docs(spark, d).where("doc_id % 5 > 1").withColumn("svg", bad)).select("doc_id", F.explode("removals").alias("r"))
    return gone.groupBy("doc_id", "r.kind", "r.name").agg(F.count("*").alias("n"))


@query("edges", _V + _EDGES + "select doc_id, path_index, subpath_index, closed, i, x1, y1, x2, y2, closing from edges")
def edges(spark, d):
    return outlines.edges(_v(spark, d))


@query("polygon_area", _V + _EDGES + "select doc_id, path_index, subpath_index, round(area,6) as area from areas")
def polygon_area(spark, d):
    return outlines.polygon_area(_v(spark, d)).withColumn("area", F.round("area", 6))


@query("subpath_bounds", _V + _EDGES + "select doc_id, path_index, subpath_index, min_x, min_y, max_x, max_y from subs")
def subpath_bounds(spark, d):
    return outlines.subpath_bounds(_v(spark, d))


@query("too_many_subpaths", _V + _EDGES + """select doc_id, count(*) as n_subpaths, 'too_many_subpaths' as reason from subs group by 1 having count(*) > 48""")
def too_many_subpaths(spark, d):
    return outlines.subpath_guard(_v(spark, d), 48)


_OPEN = """, ends as (select doc_id, path_index, subpath_index, any_value(closed) as closed, count(*) as n, arg_min(x,i) as fx, arg_min(y,i) as fy,
  arg_max(x,i) as lx, arg_max(y,i) as ly from vertices group by 1,2,3)
, opens as (select doc_id, concat('open-',path_index,'-',subpath_index) as id, path_index, subpath_index,
  round(sqrt(pow(fx-lx,2)+pow(fy-ly,2)),6) as gap_distance from ends join box using (doc_id)
  where not closed and n >= 3 and sqrt(pow(fx-lx,2)+pow(fy-ly,2)) <= diagonal*0.005)
"""


@query("open_paths", _V + _EDGES + _OPEN + "select *, 'open_path' as type, 'error' as severity from opens")
def open_paths(spark, d):
    v = _v(spark, d)
    return outlines.open_paths(v, outlines.document_bounds(v)).select(
        "doc_id", "id", "path_index", "subpath_index", F.round("gap_distance", 6).alias("gap_distance"), "type", "severity"
    )


# Frames, holes and copies are rectangles whose first edge is the top one, so the
# inward point is just below its middle; the open outlines share that edge.
_INWARD = f""", inward as (select doc_id, {NODE} as node, (x0+x1)/2 as px, y0+(x1-x0)*0.001 as py from rings)
"""


@query("inward_point", _V + _INWARD + "select doc_id, node, round(px,6) as px, round(py,6) as py from inward")
def inward_point(spark, d):
    return outlines.inward_points(_v(spark, d)).withColumns({c: F.round(c, 6) for c in ("px", "py")})


# All outlines against all of their document, the plain way.
_INSIDE = f""", ring as (select doc_id, {NODE} as node, x1, y1, x2, y2 from edges)
, hits as (select p.doc_id, p.node as inner_node, r.node as outer_node,
    count(*) filter (where (r.y2 > p.py) <> (r.y1 > p.py)
      and p.px < (r.x1-r.x2)*(p.py-r.y2)/(case when r.y1=r.y2 then 1.0 else r.y1-r.y2 end)+r.x2) as n
  from inward p join ring r on r.doc_id=p.doc_id group by 1,2,3)
, inside as (select doc_id, inner_node, outer_node from hits where n % 2 = 1)
, nodes as (select doc_id, {NODE} as node, area from areas)
, depth as (select n.doc_id, n.node, count(i.outer_node) as depth from nodes n left join inside i
  on i.doc_id=n.doc_id and i.inner_node=n.node and i.outer_node<>n.node group by 1,2)
, parents as (select doc_id, inner_node as node, outer_node as parent from (select i.*, row_number() over (
    partition by i.doc_id, i.inner_node order by a.area, i.outer_node) as n from inside i
  join nodes a on a.doc_id=i.doc_id and a.node=i.outer_node where a.area > 0 and i.inner_node <> i.outer_node) where n = 1)
"""
# The first of identical rings stands for its copies.
_FIRSTS = f""", firsts as (select doc_id, {NODE} as node, min({NODE}) over (partition by doc_id, closed, x0, y0, x1, y1) as shape from rings)
"""


@query("containment_pairs", _V + _EDGES + _INWARD + _INSIDE + _FIRSTS + """select i.doc_id, inner_node as "inner", outer_node as "outer" from inside i
  join firsts a on a.doc_id=i.doc_id and a.node=inner_node and a.shape=a.node join firsts b on b.doc_id=i.doc_id and b.node=outer_node and b.shape=b.node""")
def containment_pairs(spark, d):
    return nesting.containment_pairs(_v(spark, d))


@query("nesting_depth", _V + _EDGES + _INWARD + _INSIDE + "select doc_id, node, depth, depth % 2 = 1 as is_hole from depth")
def nesting_depth(spark, d):
    return nesting.nesting(_v(spark, d)).select("doc_id", "node", "depth", (F.col("depth") % 2 == 1).alias("is_hole"))


@query("direct_parent", _V + _EDGES + _INWARD + _INSIDE + "select doc_id, node, parent from depth left join parents using (doc_id, node)")
def direct_parent(spark, d):
    return nesting.nesting(_v(spark, d)).select("doc_id", "node", "parent")


_DIST = """
, seg as (select doc_id, {node} as node, x1, y1, x2, y2 from edges where closed or not closing)
, sp as (select a.doc_id, a.node as src, b.node as dst, a.x1 as ax, a.y1 as ay, a.x2 as bx, a.y2 as by_, b.x1 as cx, b.y1 as cy, b.x2 as dx, b.y2 as dy
  from seg a join seg b on a.doc_id=b.doc_id and a.node < b.node)
, turns as (select *, (by_-ay)*(cx-bx)-(bx-ax)*(cy-by_) as t1, (by_-ay)*(dx-bx)-(bx-ax)*(dy-by_) as t2,
  (dy-cy)*(ax-dx)-(dx-cx)*(ay-dy) as t3, (dy-cy)*(bx-dx)-(dx-cx)*(by_-dy) as t4 from sp)
, sd as (select doc_id, src, dst, case when (sgn(t1)<>sgn(t2) and sgn(t3)<>sgn(t4))
    or (abs(t1)<1e-12 and cx between least(ax,bx)-1e-9 and greatest(ax,bx)+1e-9 and cy between least(ay,by_)-1e-9 and greatest(ay,by_)+1e-9)
    or (abs(t2)<1e-12 and dx between least(ax,bx)-1e-9 and greatest(ax,bx)+1e-9 and dy between least(ay,by_)-1e-9 and greatest(ay,by_)+1e-9)
    or (abs(t3)<1e-12 and ax between least(cx,dx)-1e-9 and greatest(cx,dx)+1e-9 and ay between least(cy,dy)-1e-9 and greatest(cy,dy)+1e-9)
    or (abs(t4)<1e-12 and bx between least(cx,dx)-1e-9 and greatest(cx,dx)+1e-9 and by_ between least(cy,dy)-1e-9 and greatest(cy,dy)+1e-9)
  then 0.0 else least({p1}, {p2}, {p3}, {p4}) end as dist from turns)
, dists as (select doc_id, src, dst, min(dist) as dist from sd group by 1,2,3)
"""


def _pseg(px, py, ax, ay, bx, by):
    t = f"greatest(0.0, least(1.0, (({px}-{ax})*({bx}-{ax})+({py}-{ay})*({by}-{ay}))/greatest(pow({bx}-{ax},2)+pow({by}-{ay},2),1e-18)))"
    return f"sqrt(pow({px}-{ax}-({t})*({bx}-{ax}),2)+pow({py}-{ay}-({t})*({by}-{ay}),2))"


def _dist_sql():
    sql = _DIST.replace("sgn(", "sign(")
    return sql.format(
        node=NODE, p1=_pseg("ax", "ay", "cx", "cy", "dx", "dy"), p2=_pseg("bx", "by_", "cx", "cy", "dx", "dy"),
        p3=_pseg("cx", "cy", "ax", "ay", "bx", "by_"), p4=_pseg("dx", "dy", "ax", "ay", "bx", "by_"),
    )


_DISTS = _dist_sql()


@query("touch_pairs", _V + _EDGES + _FIRSTS + _DISTS + """select d.doc_id, src, dst, round(dist,6) as distance from dists d join box using (doc_id)
  join firsts a on a.doc_id=d.doc_id and a.node=src join firsts b on b.doc_id=d.doc_id and b.node=dst
  where dist <= diagonal*0.001 and a.shape = a.node and (b.shape = b.node or b.shape = a.node)""")
def touch_pairs(spark, d):
    v = _v(spark, d)
    return pairs.touch_pairs(v, outlines.document_bounds(v)).withColumn("distance", F.round("distance", 6))


# Wide enough a ratio that frames of nearly one size in one place count as near copies.
_NEAR = 0.02
_DUP = f""", pts as (select doc_id, {NODE} as node, closed, i, x, y, count(*) over (partition by doc_id, path_index, subpath_index) as n from vertices)
, ways as (select a.doc_id, a.node as src, b.node as dst, w.way, max(sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2))) as dist
  from pts a cross join (select unnest([0,1]) as way) w join pts b on a.doc_id=b.doc_id and a.node<b.node and a.closed=b.closed and a.n=b.n
    and b.i = case when w.way=0 then a.i else a.n-1-a.i end group by 1,2,3,4)
, dup as (select doc_id, src, dst, min(dist) as dist from ways group by 1,2,3)
, near as (select d.* from dup d join box using (doc_id) where dist <= diagonal*{_NEAR})
"""


@query("duplicate_pairs", _V + _EDGES + _DUP + "select doc_id, src, dst, round(dist,6) as distance from near")
def duplicate_pairs(spark, d):
    """All pairs of outlines within the tolerance, every two copies of one outline included."""
    v = _v(spark, d)
    return pairs.duplicate_pairs(v, outlines.document_bounds(v), _NEAR, every=True).withColumn("distance", F.round("distance", 6))


def _reach(table, name):
    """Smallest reachable node by recursion over an undirected pair table (doc_id, src, dst)."""
    return f"""
, both_{name} as (select doc_id, src, dst from {table} union select doc_id, dst, src from {table})
, reach_{name}(doc_id, node, seen) as (select doc_id, node, node from (select distinct doc_id, src as node from both_{name})
  union select r.doc_id, r.node, b.dst from reach_{name} r join both_{name} b on b.doc_id=r.doc_id and b.src=r.seen)
, roots_{name} as (select doc_id, node, min(seen) as root from reach_{name} group by 1,2)
"""


def _recursive(sql):
    return sql.replace("with ", "with recursive ", 1)


_GROUPS = _DUP + _reach("near", "dup") + """, numbered as (select *, dense_rank() over (partition by doc_id order by root) as group_no from roots_dup)
, widest as (select a.doc_id, a.group_no, max(d.dist) as dist from numbered a join numbered b on a.doc_id=b.doc_id and a.group_no=b.group_no and a.node<b.node
  join dup d on d.doc_id=a.doc_id and d.src=a.node and d.dst=b.node group by 1,2)
, groups as (select doc_id, group_no, count(*) as members, round(any_value(dist),6) as max_point_distance, any_value(dist) <= 1e-9 as exact
  from numbered join widest using (doc_id, group_no) group by 1,2)
"""


@query("duplicate_groups", _recursive(_V) + _EDGES + _GROUPS + """select doc_id, cast(group_no as int) as group_no, concat('dup-', group_no) as id, members, max_point_distance, exact,
  case when exact then 'error' else 'warning' end as severity from groups""")
def duplicate_groups(spark, d):
    v = _v(spark, d)
    groups, _ = components.duplicate_groups(v, outlines.document_bounds(v), _NEAR)
    return groups.select("doc_id", "group_no", "id", "members", F.round("max_point_distance", 6).alias("max_point_distance"), "exact", "severity")


_GRAPH = """with links as (select distinct l_suppkey as doc_id, l_orderkey as src, l_orderkey + 1 + l_linenumber as dst from lineitem)
"""


@query("connected_components", _recursive(_GRAPH) + _reach("links", "g") + "select doc_id, node as id, root from roots_g")
def connected_components(spark, d):
    links = views.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("doc_id"), F.col("l_orderkey").alias("src"),
        (F.col("l_orderkey") + 1 + F.col("l_linenumber")).alias("dst"),
    ).distinct()
    nodes = links.select("doc_id", F.explode(F.array("src", "dst")).alias("id"))
    return graph.connected_components(nodes, links)


_CHECK = _recursive(_V) + _EDGES + _OPEN + _GROUPS.replace(f"diagonal*{_NEAR}", "diagonal*0.002") + """
, issues as (select doc_id, id, 'open_path' as type, 'error' as severity, path_index, subpath_index, 0 as part, 0 as group_no, gap_distance,
    cast(null as boolean) as exact, cast(null as double) as max_point_distance, cast(null as bigint) as members, s.min_x, s.min_y, s.max_x, s.max_y
    from opens join subs s using (doc_id, path_index, subpath_index)
  union all select doc_id, concat('dup-', group_no), 'duplicate_path', case when exact then 'error' else 'warning' end, null, null, 1, group_no,
    null, exact, max_point_distance, members, min_x, min_y, max_x, max_y from groups join
    (select n.doc_id, group_no, min(min_x) as min_x, min(min_y) as min_y, max(max_x) as max_x, max(max_y) as max_y from numbered n
      join subs s on s.doc_id = n.doc_id and s.path_index = n.node >> 32 and s.subpath_index = n.node & 4294967295 group by 1,2) using (doc_id, group_no))
"""


def _issues(spark, d):
    v = _v(spark, d)
    return components.check(v, outlines.document_bounds(v))[0]


@query("duplicate_members", _CHECK + """select doc_id, concat('dup-', group_no) as id, cast(node >> 32 as int) as path_index, cast(node & 4294967295 as int) as subpath_index from numbered""")
def duplicate_members(spark, d):
    v = _v(spark, d)
    return components.check(v, outlines.document_bounds(v))[1]


@query("check", _CHECK + "select doc_id, id, type, severity, path_index, subpath_index, exact, members from issues")
def check(spark, d):
    return _issues(spark, d).select("doc_id", "id", "type", "severity", "path_index", "subpath_index", "exact", "members")


@query("all_issues", _CHECK + """select doc_id, id, cast(row_number() over (partition by doc_id order by part, path_index, subpath_index, group_no) as int) as ordinal,
  gap_distance, max_point_distance, min_x, min_y, max_x, max_y from issues""")
def all_issues(spark, d):
    return _issues(spark, d).select(
        "doc_id", "id", "ordinal", F.round("gap_distance", 6).alias("gap_distance"), F.round("max_point_distance", 6).alias("max_point_distance"),
        "min_x", "min_y", "max_x", "max_y",
    )


@query("check_summary", _CHECK + """select d.doc_id, count(i.id) filter (where type='open_path') as open_paths, count(i.id) filter (where type='duplicate_path') as duplicate_groups,
  cast(0 as bigint) as skipped_path_count from (select distinct doc_id from vertices) d left join issues i using (doc_id) group by 1""")
def check_summary(spark, d):
    return components.check_summary(_issues(spark, d), svg.skipped_paths(_docs(spark, d)))


@query("issue_overlay", _CHECK + """, hit as (select distinct doc_id, path_index from opens union select doc_id, node >> 32 from numbered)
, p as (select distinct doc_id, path_index from vertices), sz as (select doc_id, max(x)-min(x) as w, max(y)-min(y) as h from vertices group by 1)
select p.doc_id, p.path_index, hit.path_index is not null as hit, case when hit.path_index is not null then '#ff2d55' end as stroke,
  case when hit.path_index is not null then '#ff2d55' end as fill, case when hit.path_index is not null then cast(0.35 as double) end as fill_opacity,
  case when hit.path_index is not null then greatest(w,h,1.0)*0.01 end as stroke_width
  from p join sz using (doc_id) left join hit using (doc_id, path_index) where p.doc_id in (select doc_id from hit)""")
def issue_overlay(spark, d):
    v = _v(spark, d)
    sizes = v.groupBy("doc_id").agg((F.max("x") - F.min("x")).alias("width"), (F.max("y") - F.min("y")).alias("height"))
    issues, members = components.check(v, outlines.document_bounds(v))
    hits = issues.where("path_index is not null").select("doc_id", "path_index").unionByName(members.select("doc_id", "path_index"))
    return svg.issue_overlay(v.select("doc_id", "path_index").distinct(), hits, sizes)


_COMP = _recursive(_V) + _EDGES + _INWARD + _INSIDE + _DISTS + """
, link as (select doc_id, src, dst from dists join box using (doc_id) where dist <= diagonal*0.001
  union select d.doc_id, least(d.node, parent), greatest(d.node, parent) from depth d join parents using (doc_id, node) where depth % 2 = 1
  union select doc_id, node, node from nodes)
""" + _reach("link", "c") + """, piece as (select r.doc_id, r.node, dense_rank() over (partition by r.doc_id order by root) as component_no, depth, area
  from roots_c r join depth using (doc_id, node) join nodes using (doc_id, node))
, boxes as (select doc_id, (cast(path_index as bigint) * 4294967296 + subpath_index) as node, path_index, subpath_index, min_x, min_y, max_x, max_y from subs)
, pieces as (select doc_id, component_no, round(greatest(sum(case when depth%2=1 then -area else area end),0.0),6) as area, count(*) as members,
  min(min_x) as min_x, min(min_y) as min_y, max(max_x) as max_x, max(max_y) as max_y,
  greatest(sum(case when depth%2=1 then -area else area end),0.0) <= any_value(box_area)*0.0025 as is_tiny
  from piece join boxes using (doc_id, node) join box using (doc_id) group by 1,2)
"""


@query("component_ids", _COMP + """select doc_id, cast(component_no as int) as component_no, path_index, subpath_index, case when depth%2=1 then 'hole' else 'solid' end as role,
  round(area,6) as area from piece join boxes using (doc_id, node)""")
def component_ids(spark, d):
    v = _v(spark, d)
    return components.component_members(v, outlines.document_bounds(v)).select(
        "doc_id", "component_no", *KEY[1:], "role", F.round("area", 6).alias("area")
    )


def _pieces(spark, d):
    v = _v(spark, d)
    bounds = outlines.document_bounds(v)
    return components.components(components.component_members(v, bounds), bounds, 0.0025)


@query("components", _COMP + """select doc_id, cast(component_no as int) as component_no, concat('component-',component_no) as component_id, area, members,
  min_x, min_y, max_x, max_y, is_tiny from pieces""")
def components_query(spark, d):
    return _pieces(spark, d).withColumn("area", F.round("area", 6))


@query("component_summary", _COMP + """select doc_id, count(*) as component_count, count(*) filter (where is_tiny) as tiny_component_count,
  round(sum(area),4) as total_area from pieces group by 1""")
def component_summary(spark, d):
    return components.component_summary(_pieces(spark, d)).withColumn("total_area", F.round("total_area", 4))
