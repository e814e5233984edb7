"""Grid joins against all pairs, with cells halved often, and the size of the largest key."""

import math
import random

import pytest
from pyspark.sql import functions as F

from inkgrid.functions import geometry
from inkgrid.operators import grid
from inkgrid.session import cut_lineage

BOX = "doc_id long, id int, min_x double, min_y double, max_x double, max_y double"
SEG = BOX + ", x1 double, y1 double, x2 double, y2 double"


@pytest.mark.parametrize("limit", [100, 1 << 18])
def test_boxes_against_all_pairs(spark, limit):
    rng = random.Random(4)
    rows = []
    for k in range(120):
        x, y = rng.uniform(-50, 50), rng.uniform(-50, 50)
        w, h = rng.choice([(0.0, rng.uniform(0, 90)), (rng.uniform(0, 90), 0.0), (rng.uniform(0, 5), rng.uniform(0, 5)), (rng.randint(1, 40), 8.0)])
        rows.append((k % 2, k, float(round(x)), float(round(y)), float(round(x) + w), float(round(y) + h)))
    got = [(r.a_id, r.b_id) for r in grid.overlapping_boxes(spark.createDataFrame(rows, BOX), "doc_id", "id", limit=limit).collect()]
    want = {(a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and a[0] == b[0] and a[2] <= b[4] and b[2] <= a[4] and a[3] <= b[5] and b[3] <= a[5]}
    assert len(got) == len(want) and {tuple(sorted(p)) for p in got} == want


def test_a_scope_of_few_boxes_needs_no_cells(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(d, k, x, y, x + rng.choice([0.0, 3.0, 70.0]), y + rng.choice([0.0, 2.0, 30.0])) for d, n in ((1, 20), (2, 90)) for k in range(n) for x, y in [(float(rng.randint(0, 90)), float(rng.randint(0, 90)))]]
    boxes = spark.createDataFrame([*rows, (None, 1, 0.0, 0.0, 9.0, 9.0), (None, 2, 0.0, 0.0, 9.0, 9.0)], BOX)
    found = [sorted(tuple(r) for r in grid.overlapping_boxes(boxes, "doc_id", "id", limit=limit).collect()) for limit in (1, 100, 1 << 16)]
    assert found[0] == found[1] == found[2] and {r[0] for r in found[0]} == {1, 2}  # the same sides as well
    monkeypatch.setattr(grid, "_by_cells", None)
    assert len(grid.overlapping_boxes(boxes, "doc_id", "id").collect()) == len(found[0])


def segment(k, x1, y1, x2, y2, margin):
    return (1, k, min(x1, x2) - margin, min(y1, y2) - margin, max(x1, x2) + margin, max(y1, y2) + margin, x1, y1, x2, y2)


@pytest.mark.parametrize("limit", [64])
def test_near_segments_against_all_pairs(spark, limit):
    rng = random.Random(9)
    rows = []
    for k in range(90):
        x, y, r, turn = rng.uniform(0, 100), rng.uniform(0, 100), rng.choice([2, 2, 10, 120]), rng.choice([0, 0.5, 1, rng.uniform(0, 2)]) * math.pi
        rows.append(segment(k, x, y, x + r * math.cos(turn), y + r * math.sin(turn), 1.0))
    df = spark.createDataFrame(rows, SEG)
    both = df.select(*[F.col(c).alias(f"a_{c}") for c in df.columns]).crossJoin(df.select(*[F.col(c).alias(f"b_{c}") for c in df.columns])).where("a_id < b_id")
    want = {(r.a_id, r.b_id) for r in geometry.with_nearest(both).where("gap <= 2").select("a_id", "b_id").collect()}
    near = geometry.with_nearest(grid.overlapping_boxes(df, "doc_id", "id", segments=True, limit=limit)).where("gap <= 2")
    assert {tuple(sorted((r.a_id, r.b_id))) for r in near.select("a_id", "b_id").collect()} == want and len(want) > 50


def test_ten_diagonals_among_many_short_segments(spark):
    short = spark.range(20_000).select(F.col("id").cast("int").alias("id"), ((F.col("id") % 200) * 20.0).alias("x1"), (F.floor(F.col("id") / 200) * 40.0).alias("y1"))
    short = short.select("id", "x1", "y1", (F.col("x1") + 12.0).alias("x2"), (F.col("y1") + 8.0).alias("y2"))
    long = spark.range(10).select((F.col("id") + 200_000).cast("int").alias("id"), F.lit(0.0).alias("x1"), (F.col("id") * 350.0).alias("y1"), F.lit(4000.0).alias("x2"), (F.lit(4000.0) - F.col("id") * 350.0).alias("y2"))
    boxes = short.unionByName(long).select(F.lit(1).cast("long").alias("doc_id"), "id", *[(F.least(f"{c}1", f"{c}2") - 0.5).alias(f"min_{c}") for c in "xy"], *[(F.greatest(f"{c}1", f"{c}2") + 0.5).alias(f"max_{c}") for c in "xy"], "x1", "y1", "x2", "y2")
    # without halving a diagonal's key holds every short segment; with it a few hundred rows
    found = cut_lineage(grid.overlapping_boxes(boxes, "doc_id", "id", segments=True, limit=4000).where("a_id >= 200000 and b_id < 200000"))
    assert found.count() < 10 * 2000
    hits = geometry.with_crossing(found).where("crosses").select("a_id", "b_id").distinct()
    plain = geometry.with_crossing(F.broadcast(boxes.where("id >= 200000").select(*[F.col(c).alias(f"a_{c}") for c in boxes.columns])).crossJoin(boxes.where("id < 200000").select(*[F.col(c).alias(f"b_{c}") for c in boxes.columns])))
    assert hits.count() == plain.where("crosses").count() > 100
