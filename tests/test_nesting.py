"""Nesting by ray shots against every point tested in every outline."""

import math
import random

from helpers import outline, square, vertices
from inkgrid.operators import nesting, outlines, pairs
from inkgrid.operators.outlines import with_node


def by_hand(v):
    """Depth and parent from all pairs of outlines; the areas are the library's, so that rounding breaks ties alike."""
    rings = {}
    for r in with_node(v).orderBy("i").collect():
        rings.setdefault((r.doc_id, r.node), []).append((r.x, r.y))
    points = {(r.doc_id, r.node): (r.px, r.py) for r in outlines.inward_points(v).collect()}
    area = {(r.doc_id, r.node): r.area for r in with_node(outlines.polygon_area(v)).collect()}

    def inside(p, ring):
        hits = sum((b[1] > p[1]) != (a[1] > p[1]) and p[0] < (a[0] - b[0]) * (p[1] - b[1]) / (a[1] - b[1]) + b[0] for a, b in zip(ring, ring[1:] + ring[:1]))
        return len(ring) > 2 and hits % 2 == 1

    out = {}
    for key in rings:
        if key not in points:
            out[key] = (0, None)
            continue
        around = [o for o in rings if o[0] == key[0] and o != key and inside(points[key], rings[o])]
        solid = [o for o in around if area[o] > 0]
        out[key] = (len(around), min(solid, key=lambda o: (area[o], o[1]))[1] if solid else None)
    return out


def check(spark, shapes):
    v = vertices(spark, *shapes)
    got = {(r.doc_id, r.node): (r.depth, r.parent) for r in nesting.nesting(v).collect()}
    want = by_hand(v)
    assert {k: x for k, x in got.items() if x != want[k]} == {} and got.keys() == want.keys()


def star(rng, x, y, r, n):
    return [(x + r * rng.uniform(0.5, 1) * math.cos(6.2831853 * k / n), y + r * rng.uniform(0.5, 1) * math.sin(6.2831853 * k / n)) for k in range(n)]


def test_random_outlines_that_cross_touch_and_nest(spark):
    rng = random.Random(11)
    shapes = []
    for doc in range(1, 7):
        n = 0
        for _ in range(rng.randint(3, 30)):
            kind, x, y = rng.random(), rng.randint(0, 60), rng.randint(0, 60)
            if kind < 0.4:
                points = [(float(a), float(b)) for a, b in square(x, y, rng.randint(1, 50))]
            elif kind < 0.7:
                points = star(rng, x, y, rng.uniform(1, 30), rng.randint(3, 12))
            elif kind < 0.8:
                points = [(rng.uniform(0, 80), rng.uniform(0, 80)) for _ in range(rng.randint(2, 6))]  # mostly crossing itself
            else:
                points = [(float(x), float(y)), (x + 9.0, float(y)), (x + 9.0, y + 9.0)]
            for _ in range(rng.choice([1, 1, 1, 2, 3])):
                shapes.append(outline(doc, n, points[::-1] if rng.random() < 0.2 else points, closed=rng.random() < 0.8))
                n += 1
    check(spark, shapes)


def random_documents(rng, docs=5):
    shapes = []
    for doc in range(1, docs + 1):
        for n in range(rng.randint(4, 25)):
            x, y = rng.randint(0, 40), rng.randint(0, 40)
            points = [(float(a), float(b)) for a, b in square(x, y, rng.randint(1, 40))] if rng.random() < 0.6 else star(rng, x, y, rng.uniform(1, 30), rng.randint(3, 9))
            for k in range(rng.choice([1, 1, 2, 3])):
                shapes.append(outline(doc, 4 * n + k, points, closed=rng.random() < 0.9))
    return shapes


def test_documents_of_few_outlines_go_by_pairs_and_others_by_rays(spark, monkeypatch):
    v = vertices(spark, *random_documents(random.Random(5)))
    want = sorted(map(repr, nesting.nesting(v).collect()))
    for few in (0, 15):
        assert sorted(map(repr, nesting.nesting(v, few=few).collect())) == want
    assert len(want) > 80 and {k: (x.depth, x.parent) for x in nesting.nesting(v).collect() for k in [(x.doc_id, x.node)]} == by_hand(v)
    # small documents shoot no rays and file nothing under slabs or cells
    monkeypatch.setattr(nesting, "shoot", None)
    monkeypatch.setattr(nesting, "points_in_boxes", None)
    assert sorted(map(repr, nesting.nesting(v).collect())) == want


def test_nested_siblings_and_something_just_inside_the_edge(spark):
    shapes = [outline(1, 0, square(0, 0, 1000)), outline(1, 1, square(0.1, 0.1, 999.8)), outline(1, 2, square(300, 0.4, 50))]
    n = 3
    for k in range(6):
        for j in range(4):
            shapes.append(outline(1, n, square(10 + 100 * k + 3 * j, 100 + 5 * j, 80 - 8 * j)))
            n += 1
    check(spark, shapes)


def test_2000_nested_rings_take_rows_in_proportion(spark):
    def rings(count):
        # the first edge is short, so that the inward point stays close to its ring
        return vertices(spark, *[outline(1, k, [(-w, -w), (1 - w, -w), (w, -w), (w, w), (-w, w)]) for k, w in ((k, 3.0 * k + 3) for k in range(count))])

    got = {r.node >> 32: (r.depth, None if r.parent is None else r.parent >> 32) for r in nesting.nesting(rings(2000)).collect()}
    assert got == {k: (1999 - k, k + 1 if k < 1999 else None) for k in range(2000)}
    shaped = pairs.shapes(rings(100), either_way=False)
    firsts = pairs.shape_members(rings(100), shaped)
    bare = with_node(outlines.edges(firsts)).join(shaped.select("doc_id", "node", "n"), ["doc_id", "node"])
    ring = bare.join(nesting.contact_clusters(bare), ["doc_id", "node"])
    assert ring.select("cluster").distinct().count() == 100
    ranks = nesting.height_ranks(ring.selectExpr("doc_id", "y1 as y"))
    assert nesting.filed_edges(ring, ranks).count() < 100 * 5 * 20  # a few slabs an edge, however many rings it passes


def test_slabs_make_up_the_range(spark):
    rows = spark.range(200).selectExpr("id * 37 % 101 as low", "id * 37 % 101 + 1 + id * 53 % 97 as high")
    for r in rows.select("low", "high", nesting.dyadic_slabs(rows.low, rows.high).alias("slabs")).collect():
        covered = sorted(k for s in r.slabs for k in range(s.slab << s.level, (s.slab + 1) << s.level))
        assert covered == list(range(r.low, r.high)) and len(r.slabs) <= 14
