"""Rules that the fixtures of the queries do not reach."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from helpers import outline, png, square, vertices
from inkgrid.functions import geometry, svgtext, text
from inkgrid.operators import catalog, components, nesting, outlines, svg
from inkgrid.operators.palette import _Groups
from inkgrid.sources import files


def column(spark, values, make):
    rows = spark.createDataFrame(list(enumerate(values)), "k int, v string")
    return [r[0] for r in rows.orderBy("k").select(make(F.col("v"))).collect()]


def test_numbers_are_digits_only(spark):
    given = ["12", " 12.5\t", "12d", "Infinity", "NaN", "1e3", ".5", "", None, "1e999", "0x10"]
    assert column(spark, given, text.parse_mm) == [12.0, 12.5, None, None, None, 1000.0, 0.5, None, None, None, None]


def test_white_space_of_all_kinds_is_trimmed(spark):
    names = ["\tabc\n", " x ", "\t\n", " ", None]
    assert column(spark, names, lambda v: catalog.clean_name(v)[0])[:2] == ["abc", "x"]
    assert column(spark, names, lambda v: catalog.clean_name(v)[1]) == [None, None, "invalid_name", "invalid_name", "invalid_name"]
    assert column(spark, ["\tA "], lambda v: text.parse_enum(v, ["a"])) == ["a"]


def test_canvas_of_odd_sizes(spark):
    docs = [f'<svg width="{w}" height="7"></svg>' for w in ("12", "Infinity", "12d", "1e300")]
    assert [(r["width"], r["height"]) for r in column(spark, docs, svgtext.canvas_size)] == [(12, 7), (0, 0), (0, 0), (0, 7)]


def test_lenient_translate(spark):
    given = ["translate(3, -4)", "rotate(2) translate( .5 1)", "translate(3)", "translate(1 ,)", "scale(2)", None]
    assert [tuple(r) for r in column(spark, given, svgtext.translate_lenient)] == [(3.0, -4.0), (0.5, 1.0), (0.0, 0.0), (1.0, 0.0), (0.0, 0.0), (0.0, 0.0)]


def test_header_beyond_32_bits(spark):
    good = png(3, 2, lambda x, y: (0, 0, 0, 255))
    bad = good[:16] + b"\xff\xff\xff\xff" + good[20:]
    rows = spark.createDataFrame([("a", bytearray(good)), ("b", bytearray(bad)), ("c", bytearray(b"RIFF----WEBPVP8L\0"))], "path string, content binary")
    assert {r["path"]: (r["width"], r["height"]) for r in files.header_dims(rows).collect()}["b"] == (None, 2)


def test_svg_size_limit_is_asked_for(spark):
    rows = spark.createDataFrame([("a", bytearray(b"<svg>" + b" " * 6_000_000 + b"</svg>"))], "path string, content binary")
    assert files.load_svg(rows)[0].count() == 1 and files.load_svg(rows, 5_000_000)[1].collect()[0]["reason"] == "svg_too_large"


def test_tolerance_comes_from_the_whole_drawing(spark):
    path = '<path d="M0,0 L10,0 L5,10 L0.5,0.2"/><path d="M0,0 C1,1 2,2 1000,1000"/>'
    docs = spark.createDataFrame([(1, f"<svg>{path}</svg>")], "doc_id long, svg string")
    v, bounds = svg.svg_to_vertices(docs), outlines.drawing_bounds(svg.svg_stats(docs))
    assert bounds.collect()[0]["diagonal"] == pytest.approx(2 ** 0.5 * 1000)
    assert outlines.open_paths(v, bounds).count() == 1 and outlines.open_paths(v, outlines.document_bounds(v)).count() == 0
    assert [r["type"] for r in components.check(v, bounds)[0].collect()] == ["open_path"]


def test_reversed_copy_has_an_inward_point_of_its_own(spark):
    points = square(0, 0, 10)
    shapes = [outline(1, 0, points), outline(1, 1, list(reversed(points))), outline(1, 2, [(-1, 5), (11, 5), (11, 11), (-1, 11)])]
    v = vertices(spark, *shapes)
    inward = {r["node"] >> 32: (r["px"], r["py"]) for r in outlines.inward_points(v).collect()}
    got = {r["node"] >> 32: r["depth"] for r in nesting.nesting(v).collect()}

    def inside(p, box):
        return box[0] < p[0] < box[2] and box[1] < p[1] < box[3]

    boxes = {0: (0, 0, 10, 10), 1: (0, 0, 10, 10), 2: (-1, 5, 11, 11)}
    assert got == {k: sum(inside(inward[k], b) for j, b in boxes.items() if j != k) for k in boxes}


def test_many_outlines_are_checked_like_few(spark):
    count = 20_050
    v = spark.range(count).select(
        F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("path_index"), F.lit(0).alias("subpath_index"), F.lit(False).alias("closed"),
        F.posexplode(F.array(*[F.struct((F.col("id") * 10 + x).cast("double").alias("x"), F.lit(y).alias("y")) for x, y in ((0, 0.0), (5, 0.0), (5, 5.0), (0, 0.5))])).alias("i", "p"),
    ).select("doc_id", "path_index", "subpath_index", "closed", "i", "p.x", "p.y")
    assert outlines.subpath_guard(v).count() == 1
    assert outlines.open_paths(v, outlines.document_bounds(v)).count() == count


def test_broken_markup_is_named(spark):
    docs = spark.createDataFrame([(1, '<svg><path d="M0,0"/></svg>'), (2, "<svg><path"), (3, "<!DOCTYPE svg><svg/>"), (4, None), (5, "<svg><!-- fine --><path/></svg>")], "doc_id long, svg string")
    rows = svg.layer_paths(docs, "#000000").collect()
    assert {(r["doc_id"], r["reason"]) for r in rows} == {(1, None), (2, "malformed"), (3, "malformed"), (4, "malformed"), (5, None)}


def test_sanitising_keeps_inner_references(spark):
    body = '<svg xmlns="http://www.w3.org/2000/svg"><g fill="url( \'#a\' )" mask="url(http://x)" onload="x" href="#b"><path style="fill:url(#c)" filter="url(&quot;//y&quot;)"/><style/></g></svg>'
    row = svg.sanitize_markup(spark.createDataFrame([(1, body)], "doc_id long, svg string")).collect()[0]
    assert sorted((r["kind"], r["name"]) for r in row["removals"]) == [("element", "style"), ("event", "onload"), ("url", "filter"), ("url", "mask")]
    assert "#a" in row["svg"] and "#c" in row["svg"] and row["removed"] == 4


def test_segments_against_exact_arithmetic(spark):
    import itertools
    import random
    from fractions import Fraction

    rnd = random.Random(6)
    rows = [tuple(float(rnd.randint(0, 4)) for _ in range(8)) for _ in range(400)]
    names = ["ax", "ay", "bx", "by", "cx", "cy", "dx", "dy"]
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, " + ", ".join(f"{n} double" for n in names))
    a, b, c, d = ((F.col(f"{s}x"), F.col(f"{s}y")) for s in "abcd")
    got = {r["k"]: r["m"] for r in frame.select("k", geometry.segments_intersect(a, b, c, d).alias("m")).collect()}

    def meet(r):
        (ax, ay), (bx, by), (cx, cy), (dx, dy) = itertools.batched([Fraction(x) for x in r], 2)
        det = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
        if det:
            t = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / det
            u = ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / det
            return 0 <= t <= 1 and 0 <= u <= 1

        def on(px, py, qx, qy, rx, ry):
            return (qx - px) * (ry - py) == (qy - py) * (rx - px) and min(px, qx) <= rx <= max(px, qx) and min(py, qy) <= ry <= max(py, qy)

        return on(ax, ay, bx, by, cx, cy) or on(ax, ay, bx, by, dx, dy) or on(cx, cy, dx, dy, ax, ay) or on(cx, cy, dx, dy, bx, by)

    assert got == {k: meet(r) for k, r in enumerate(rows)}


def test_colour_groups_against_the_plain_way():
    import numpy as np

    rng = np.random.default_rng(3)
    for trial in range(20):
        points, weights = rng.integers(0, 40, (30, 3)).astype(float), np.sort(rng.integers(1, 50, 30))[::-1]
        groups = _Groups(points, weights, 6.0)
        groups.absorb_small(20)
        groups.shrink_to(4)
        held: list[list[int]] = []

        def centre(members):
            return np.average(points[members], axis=0, weights=weights[members])

        def mass(members):
            return weights[members].sum()

        for k in range(30):
            away = [np.linalg.norm(centre(m) - points[k]) for m in held]
            if away and min(away) <= 6.0:
                held[int(np.argmin(away))].append(k)
            else:
                held.append([k])
        while len(held) > 1 and min(map(mass, held)) < 20:
            i = int(np.argmin(list(map(mass, held))))
            gone = held[i]
            away = [np.inf if j == i else np.linalg.norm(centre(m) - centre(gone)) for j, m in enumerate(held)]
            held[int(np.argmin(away))].extend(gone)
            held.pop(i)
        while len(held) > 4:
            gap, i, j = min((np.linalg.norm(centre(a) - centre(b)), i, j) for i, a in enumerate(held) for j, b in enumerate(held) if i < j)
            held[i].extend(held.pop(j))
        mine = groups.numbers()
        assert {frozenset(m) for m in held} == {frozenset(np.flatnonzero(mine == g).tolist()) for g in set(mine.tolist())}, trial


def test_two_patches_do_not_double_a_project(spark):
    projects = spark.createDataFrame([(1, "old", None, None)], "id long, name string, updated_at timestamp, deleted_at timestamp")
    patches = spark.createDataFrame([(1, "a"), (1, "b"), (1, None)], "id long, name string")
    rows = catalog.update_projects(projects, patches, ["name"], F.lit("2024-01-01").cast("timestamp")).collect()
    assert [(r["id"], r["name"]) for r in rows] == [(1, "b")]


def test_a_merge_measures_only_from_the_group_that_grew(monkeypatch):
    import numpy as np

    points = np.array([[float(k * k), 0.0, 0.0] for k in range(40)])
    groups, seen, plain = _Groups(points, np.ones(40), 0.0), [], _Groups._away
    monkeypatch.setattr(_Groups, "_away", lambda self, i: seen.append(i) or plain(self, i))
    groups.shrink_to(10)
    assert len(seen) == 30 and int(groups.alive.sum()) == 10
