"""Fusing pieces: rings, holes, the untouched rest of the document, and refusals; every case is a document of its own."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from helpers import outline, square, vertices
from inkgrid.operators import fuse, outlines, svg, union
from inkgrid.session import cut_lineage, shared_dir

RING = {0: [square(0, 0, 30)], 1: [square(30, 0, 30)], 2: [square(60, 0, 30)], 3: [square(0, 30, 30)], 4: [square(60, 30, 30)], 5: [square(0, 60, 30)], 6: [square(30, 60, 30)], 7: [square(60, 60, 30)]}


def bar(y0, y1):
    return [(60, y0), (70, y0), (70, y1), (60, y1)]


# name -> pieces (the first outline is the outer one) and those selected.  Bridges between the two squares of the refused cases cover the pixel rows 39 and 40.
CASES = {
    "washer": ({0: [square(0, 0, 60), square(20, 20, 20)[::-1]], 1: [square(70, 20, 20)]}, [0, 1]),
    "part": ({p: [square(40 * p, 0, 20)] for p in range(4)}, [0, 1, 2]),
    "through": ({0: [square(0, 40, 20)], 1: [square(120, 40, 20)], 2: [square(60, 36, 12)]}, [0, 1]),
    "through all": ({0: [square(0, 40, 20)], 1: [square(120, 40, 20)], 2: [square(60, 36, 12)]}, [0, 1, 2]),
    "borders": ({0: [square(0, 40, 20)], 1: [square(120, 40, 20)], 2: [bar(20, 39)]}, [0, 1]),
    "passes by": ({0: [square(0, 40, 20)], 1: [square(120, 40, 20)], 2: [bar(20, 38)]}, [0, 1]),
    "inside a hole": ({0: [square(0, 0, 100), square(10, 10, 80)[::-1]], 1: [square(40, 40, 20)]}, [0, 1]),
    "overlap": ({0: [square(0, 0, 30)], 1: [square(20, 20, 30)]}, [0, 1]),
    "closed ring": (RING, range(8)),
    "closed ring around another": ({**RING, 8: [square(40, 40, 10)]}, range(8)),
}


@pytest.fixture(scope="module")
def fused(spark):
    """Per case the report, the new outlines by path and subpath, and the SVG text."""
    docs = list(enumerate(CASES.values(), 1))
    v = vertices(spark, *[outline(d, p, points, sub) for d, (shapes, _) in docs for p, rings in shapes.items() for sub, points in enumerate(rings)])
    pieces = v.selectExpr("doc_id", "cast(path_index as bigint) as piece", "path_index", "subpath_index").distinct()
    chosen = spark.createDataFrame([(100 + d, d, p) for d, (_, picked) in docs for p in picked], "selection_id long, doc_id long, piece long")
    sizes = outlines.document_bounds(v).withColumn("selection_id", F.col("doc_id") + 100)
    segments = union.piece_segments(chosen.join(pieces, ["doc_id", "piece"]), v)
    bridges = union.bridge_plan(union.spanning_tree(union.linking_distances(segments)), sizes)
    canvas = spark.createDataFrame([(d, 200, 120) for d, _ in docs], "doc_id long, width int, height int")
    report, result = union.union_pieces(v, pieces, chosen, bridges, canvas)
    fills = pieces.select("doc_id", "path_index", F.concat(F.lit("#00000"), F.col("path_index").cast("string")).alias("fill")).distinct()
    texts = {r.doc_id - 100: r.svg for r in union.union_documents(result, chosen, pieces, canvas, fills).collect()}
    reports, found = {r.doc_id: r for r in report.collect()}, {}
    for r in result.orderBy("path_index", "subpath_index", "i").collect():
        found.setdefault(r.doc_id, {}).setdefault(r.path_index, {}).setdefault(r.subpath_index, []).append((r.x, r.y))
    return {name: (reports[d], found.get(d, {}), texts.get(d)) for d, name in enumerate(CASES, 1)}


def area(points):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1])) / 2


def counts(report):
    return report.accepted, report.regions_before, report.regions_after, report.regions_expected


def floats(points):
    return sorted((float(x), float(y)) for x, y in points)


def test_washer_and_disk_keep_the_hole(fused):
    report, found, text = fused["washer"]
    assert counts(report) == (True, 2, 1, 1) and (report.holes, report.hole_area) == (1, 400.0) and 3600 < report.area < 4000
    assert list(found) == [2] and list(found[2]) == [0, 1]  # one new path: the outer ring first, then the hole
    assert area(found[2][0]) == report.area + 400 and area(found[2][1]) == -400 and sorted(found[2][1]) == floats(square(20, 20, 20))
    assert text.count("<path") == 1 and "#000000" in text


def test_unselected_pieces_stay_as_they_are(fused):
    report, found, text = fused["part"]
    assert counts(report) == (True, 4, 2, 2)
    assert sorted(found) == [3, 4] and list(found[3]) == [0] and sorted(found[3][0]) == floats(square(120, 0, 20))
    assert text.count("<path") == 2 and "#000003" in text


def test_refused_when_a_bridge_meets_another_piece(fused):
    for name in ("through", "borders"):
        report, found, text = fused[name]
        assert counts(report) == (False, 3, 1, 2) and report.area is None and found == {} and text is None
    assert counts(fused["through all"][0]) == (True, 3, 1, 1) and counts(fused["passes by"][0]) == (True, 3, 2, 2)


def test_a_piece_inside_a_hole_is_linked_across_it(fused):
    report, found, _ = fused["inside a hole"]
    assert report.accepted and report.holes == 1 and list(found[2]) == [0, 1]
    assert area(found[2][0]) == 10_000 and -6000 < area(found[2][1]) < -5000 - 80


def test_overlapping_pieces_need_no_bridge(fused):
    report, found, _ = fused["overlap"]
    assert report.accepted and report.area == 900 + 900 - 100 and len(found[2][0]) == 8


def test_a_ring_of_pieces_encloses_a_new_hole(fused):
    for name, others in (("closed ring", 0), ("closed ring around another", 1)):
        report, found, _ = fused[name]
        assert report.accepted and report.regions_before == 1 + others and (report.holes, report.hole_area) == (1, 900.0) and len(found) == 1 + others


def test_the_documents_read_back(spark, fused):
    docs = spark.createDataFrame([(k, text) for k, (_, _, text) in enumerate(fused.values()) if text], "doc_id long, svg string")
    again = svg.svg_to_vertices(docs).groupBy("doc_id").agg(F.count_distinct("path_index", "subpath_index").alias("n")).collect()
    want = {k: sum(map(len, found.values())) for k, (_, found, text) in enumerate(fused.values()) if text}
    assert {r.doc_id: r.n for r in again} == want


def test_documents_fused_in_a_task_and_by_joins_are_the_same(spark, monkeypatch):
    """Random pieces, copies, overlaps, holes and open ends; a few documents at a time, and a selection over two documents."""
    rng = random.Random(12)
    rows, chosen = [], []
    for d in range(1, 9):
        for p in range(9):
            x, y, side = rng.randrange(0, 150), rng.randrange(-5, 100), rng.choice([1, 4, 15, 30, 45])
            slant = rng.choice([0, 0, 7.3])
            points = [(x, y), (x + side, y + slant), (x + side - slant, y + side), (x, y + side + 0.5)]
            rows += outline(d, p, points, closed=rng.random() < 0.8)
            if side > 15:
                rows += outline(d, p, square(x + 5, y + 5, 6)[::-1], 1)
            chosen += [(10 * d + p % 2, d, p)] + [(10 * d + 2, d, p)] * (rng.random() < 0.4)
    chosen += [(1, 1, 0), (1, 2, 3), (1, 2, 4)]
    v = vertices(spark, rows)
    pieces = v.selectExpr("doc_id", "cast(path_index as bigint) as piece", "path_index", "subpath_index").distinct()
    picked = spark.createDataFrame(chosen, "selection_id long, doc_id long, piece long")
    sizes = picked.select("selection_id", "doc_id").distinct().join(outlines.document_bounds(v), "doc_id").where("selection_id > 1")
    segments = union.piece_segments(picked.where("selection_id > 1").join(pieces, ["doc_id", "piece"]), v)
    bridges = cut_lineage(union.bridge_plan(union.spanning_tree(union.linking_distances(segments)), sizes))
    canvas = spark.createDataFrame([(d, 200, 120) for d in range(1, 9)], "doc_id long, width int, height int")
    monkeypatch.setattr(fuse, "MOST", 3000)
    found = []
    for most in (400_000, 0):
        report, result = union.union_pieces(v, pieces, picked, bridges, canvas, most)
        found.append([sorted(map(str, df.select(*sorted(df.columns)).collect())) for df in (report, result)])
    assert found[0] == found[1] and len(found[0][0]) > 20
    assert any("accepted=True" in r for r in found[0][0]) and any("accepted=False" in r for r in found[0][0])


def test_small_documents_write_no_runs(spark):
    """What is written does not grow with the height of the pieces."""
    def written(scale):
        v = vertices(spark, *[outline(d, p, square(60 * p * scale, 0, 40 * scale)) for d in range(40) for p in range(3)])
        pieces = v.selectExpr("doc_id", "cast(path_index as bigint) as piece", "path_index", "subpath_index").distinct()
        picked = spark.createDataFrame([(d, d, p) for d in range(40) for p in range(2)], "selection_id long, doc_id long, piece long")
        bridges = spark.createDataFrame([], "selection_id long, src long, dst long, corners array<struct<x: double, y: double>>")
        canvas = spark.createDataFrame([(d, 400 * scale, 60 * scale) for d in range(40)], "doc_id long, width int, height int")
        before = set(glob.glob(f"{shared_dir(spark)}/*"))
        report, _ = union.union_pieces(v, pieces, picked, bridges, canvas)
        assert report.where("not accepted and regions_before = 3").count() == 40
        new = set(glob.glob(f"{shared_dir(spark)}/*")) - before
        return sum(os.path.getsize(p) for f in new for p in glob.glob(f"{f}/*.parquet"))

    assert written(30) < 1.5 * written(1)
