"""Golden cases for pieces, checks, simplification and union."""

from __future__ import annotations

import math
import random

import pytest

from helpers import outline, square, vertices
from inkgrid.operators import components, nesting, outlines, simplify, svg, union


def pieces(spark, *shapes, touch=0.001):
    v = vertices(spark, *shapes)
    bounds = outlines.document_bounds(v)
    members = components.component_members(v, bounds, touch)
    rows = components.components(members, bounds).orderBy("component_no").collect()
    roles = {(m.path_index, m.subpath_index): (m.component_no, m.role) for m in members.collect()}
    return rows, roles


def test_two_islands(spark):
    rows, _ = pieces(spark, outline(1, 0, square(0, 0, 40)), outline(1, 1, square(100, 0, 40)))
    assert [(r.component_id, r.area) for r in rows] == [("component-1", 1600.0), ("component-2", 1600.0)]


def test_ring_and_disk_in_its_hole(spark):
    rows, roles = pieces(
        spark, outline(1, 0, square(0, 0, 100)), outline(1, 0, square(20, 20, 60), sub=1), outline(1, 1, square(40, 40, 20))
    )
    assert [r.area for r in rows] == [10000.0 - 3600.0, 400.0]
    assert roles == {(0, 0): (1, "solid"), (0, 1): (1, "hole"), (1, 0): (2, "solid")}


def test_shared_edge_joins_and_a_gap_does_not(spark):
    near, _ = pieces(spark, outline(1, 0, square(0, 0, 40)), outline(1, 1, square(40, 0, 40)))
    far, _ = pieces(spark, outline(1, 0, square(0, 0, 40)), outline(1, 1, square(41, 0, 40)))
    assert (len(near), len(far)) == (1, 2)


def test_copies_count_each_other_as_containers(spark):
    shapes = [outline(1, p, square(0, 0, 50)) for p in range(3)] + [outline(1, 3, square(10, 10, 5))]
    got = {r.node >> 32: (r.depth, None if r.parent is None else r.parent >> 32) for r in nesting.nesting(vertices(spark, *shapes)).collect()}
    assert got == {0: (2, 1), 1: (2, 0), 2: (2, 0), 3: (3, 0)}


def test_open_triangle_and_duplicates(spark):
    triangle = outline(1, 0, [(0, 0), (10, 0), (5, 10), (0.03, 0.02)], closed=False)
    twin = outline(1, 1, square(20, 20, 5)), outline(1, 2, list(reversed(square(20, 20, 5)))), outline(1, 3, square(20.01, 20, 5))
    v = vertices(spark, triangle, *twin)
    checked, members = components.check(v, outlines.document_bounds(v))
    issues = checked.orderBy("ordinal").collect()
    assert {(m.id, m.path_index) for m in members.collect()} == {("dup-1", 1), ("dup-1", 2), ("dup-1", 3)}
    assert (issues[1].min_x, issues[1].max_x, issues[1].min_y, issues[1].max_y) == (20, 25.01, 20, 25)
    assert [(i.id, i.type) for i in issues] == [("open-0-0", "open_path"), ("dup-1", "duplicate_path")]
    assert issues[0].gap_distance == pytest.approx(math.hypot(0.03, 0.02))
    assert (issues[1].members, issues[1].exact, issues[1].severity) == (3, False, "warning")
    assert issues[1].max_point_distance == pytest.approx(0.01)


def test_too_many_outlines_are_named(spark):
    v = vertices(spark, *[outline(1, p, square(p, 0, 1)) for p in range(5)], outline(2, 0, square(0, 0, 1)))
    assert [r.doc_id for r in outlines.subpath_guard(v, 4).collect()] == [1]


def test_inward_point_skips_edges_that_cannot_be_nudged(spark):
    # the first edges lie on one line folded back on itself; a later one opens the outline
    points = [(0, 0), (4, 0), (2, 0), (6, 0), (6, 3), (0, 3)]
    row = outlines.inward_points(vertices(spark, outline(1, 0, points))).collect()[0]
    assert 0 < row.px < 6 and 0 < row.py < 3


def brute_simplify(points, closed, eps):
    def dist(p, a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        if dx == 0 and dy == 0:
            return math.hypot(p[0] - a[0], p[1] - a[1])
        return abs(dy * p[0] - dx * p[1] + b[0] * a[1] - b[1] * a[0]) / math.hypot(dx, dy)

    def walk(lo, hi):
        if hi - lo < 2:
            return set()
        gaps = [dist(line[k], line[lo], line[hi]) for k in range(lo + 1, hi)]
        best = max(gaps)
        if best <= eps:
            return set()
        mid = lo + 1 + gaps.index(best)
        return {mid} | walk(lo, mid) | walk(mid, hi)

    line = points + [points[0]] if closed else points
    kept = {0, len(line) - 1} | walk(0, len(line) - 1)
    kept = sorted(k for k in kept if k < len(points))
    return kept if len(kept) >= (3 if closed else 2) else list(range(len(points)))


@pytest.mark.parametrize("limit", [50_000, 7])
def test_simplify_like_the_plain_recursion(spark, limit):
    rng = random.Random(5)
    shapes = {}
    for p in range(6):
        n = rng.randint(3, 60)
        shapes[p] = ([(round(50 * math.cos(6.28 * k / n) + rng.random() * 6, 3), round(50 * math.sin(6.28 * k / n) + rng.random() * 6, 3)) for k in range(n)], p % 2 == 0)
    v = vertices(spark, *[outline(1, p, pts, closed=c) for p, (pts, c) in shapes.items()])
    bounds = outlines.document_bounds(v)
    eps = bounds.collect()[0].diagonal * 0.02
    got = {}
    for r in simplify.simplify(v, bounds, 0.02, limit).collect():
        got.setdefault(r.path_index, []).append(r.i)
    assert {p: sorted(i) for p, i in got.items()} == {p: brute_simplify(pts, c, eps) for p, (pts, c) in shapes.items()}


def test_spanning_tree_weight(spark):
    rng = random.Random(3)
    spots = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(12)]
    v = vertices(spark, *[outline(1, p, square(x, y, 3)) for p, (x, y) in enumerate(spots)])
    members = v.selectExpr("cast(9 as bigint) as selection_id", "cast(path_index as bigint) as piece", *svg.KEY).distinct()
    tree = union.spanning_tree(union.linking_distances(union.piece_segments(members, v))).collect()

    def gap(a, b):
        dx = max(0, abs(a[0] - b[0]) - 3)
        dy = max(0, abs(a[1] - b[1]) - 3)
        return math.hypot(dx, dy)

    inside, total = {0}, 0.0
    while len(inside) < len(spots):
        best = min((gap(spots[a], spots[b]), b) for a in inside for b in range(len(spots)) if b not in inside)
        total += best[0]
        inside.add(best[1])
    assert len(tree) == len(spots) - 1
    assert sum(t.distance for t in tree) == pytest.approx(total, abs=1e-6)


def test_nested_svg_inherits_fill_and_transform(spark):
    text = '<svg xmlns="http://www.w3.org/2000/svg"><g fill="#123456" transform="translate(10,0)"><path d="M0,0L1,1" transform="scale(2)"/><g fill="red"><path d="M2,2"/></g></g><path d="M3,3"/></svg>'
    docs = spark.createDataFrame([(1, text)], "doc_id long, svg string")
    got = [(r.fill, r.x, r.scale_x) for r in svg.layer_paths(docs, "#000000").orderBy("path_index").collect()]
    assert got == [("#123456", 10.0, 2.0), ("red", 10.0, 1.0), ("#000000", 0.0, 1.0)]


def test_path_reader_skips_what_it_cannot_read(spark):
    text = '<svg><path d="M0,0 10,0 L10 10 5Z M1,1 M2,2L3,3"/><path d="M0,0C1,1 2,2 3,3"/><path transform="rotate(4)" d="M0,0L1,1"/><path transform="translate(5)" d="M0,0L1,1"/></svg>'
    docs = spark.createDataFrame([(1, text)], "doc_id long, svg string")
    rows = [(r.path_index, r.subpath_index, r.closed, r.x, r.y) for r in svg.svg_to_vertices(docs).orderBy(*svg.KEY, "i").collect()]
    assert rows == [
        (0, 0, True, 0.0, 0.0), (0, 0, True, 10.0, 0.0), (0, 0, True, 10.0, 10.0), (0, 2, False, 2.0, 2.0), (0, 2, False, 3.0, 3.0),
        (3, 0, False, 5.0, 0.0), (3, 0, False, 6.0, 1.0),
    ]
    assert svg.skipped_paths(docs).collect()[0].skipped_path_count == 2
    # statistics take control points, and no shift without a separator
    stats = svg.svg_stats(docs).collect()[0]
    assert (stats.path_count, stats.node_count, stats.max_x) == (4, 12, 10.0)
