"""Groups of near copies against plain loops, and many copies in one spot."""

import itertools
import math
import random

from pyspark.sql import functions as F

from helpers import outline, vertices
from inkgrid.operators import components, outlines, pairs

TOLERANCE = 1.0


def apart(a, b):
    """Largest distance of corresponding points in the better direction."""
    return min(max(math.dist(p, q) for p, q in zip(a, way)) for way in (b, b[::-1]))


def groups_by_loops(shapes):
    """Sets of linked shapes with two members or more, and the largest distance in each."""
    up = list(range(len(shapes)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(shapes)), 2):
        if apart(shapes[i], shapes[j]) <= TOLERANCE:
            up[root(j)] = root(i)
    found = {}
    for i in range(len(shapes)):
        found.setdefault(root(i), []).append(i)
    return {frozenset(g): max(apart(shapes[i], shapes[j]) for i, j in itertools.combinations(g, 2)) for g in found.values() if len(g) > 1}


def jittered(rng, base, by):
    moved = [(x + rng.uniform(-by, by), y + rng.uniform(-by, by)) for x, y in base]
    return moved[::-1] if rng.random() < 0.5 else moved


def linked(spark, shapes, crowd):
    v = vertices(spark, *[outline(1, k, s) for k, s in enumerate(shapes)])
    bounds = spark.createDataFrame([(1, 100.0)], "doc_id long, diagonal double")
    return v, pairs.duplicate_links(v, bounds, TOLERANCE / 100, crowd=crowd)


def groups_of(edges, size):
    up = list(range(size))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for r in edges:
        up[root(r.dst >> 32)] = root(r.src >> 32)
    found = {}
    for i in range(size):
        found.setdefault(root(i), set()).add(i)
    return {frozenset(g) for g in found.values() if len(g) > 1}


def test_links_join_the_same_groups_as_all_pairs(spark):
    rng = random.Random(5)
    bases = [[(x, y), (x + 9, y + 1), (x + 8, y + 7), (x + 1, y + 6)] for x, y in ((0, 0), (1.2, 0.3), (2.1, 1.1), (40, 10), (41.3, 10))]
    shapes = [jittered(rng, b, 0.28) for b in bases for _ in range(26)] + [bases[0], bases[0][::-1], bases[3]]
    # a line of shapes, each in reach of the next only
    shapes += [[(70 + 0.9 * k, 0), (75 + 0.9 * k, 0), (75 + 0.9 * k, 5)] for k in range(12)]
    # two stars whose centres are out of reach of each other, while single followers are in reach
    far = [(0, 60), (10, 61), (9, 70)]
    shapes += [[(x + d, y) for x, y in far] for d in (0, 0.1, 0.45, 1.3, 1.4, 1.75)]
    want = groups_by_loops(shapes)
    for crowd in (4, 20, 64):
        v, edges = linked(spark, shapes, crowd)
        rows = edges.collect()
        assert groups_of(rows, len(shapes)) == set(want), crowd
        assert all(apart(shapes[r.src >> 32], shapes[r.dst >> 32]) <= TOLERANCE + 1e-9 for r in rows)
    bounds = spark.createDataFrame([(1, 100.0)], "doc_id long, diagonal double")
    groups, members = components.duplicate_groups(v, bounds, TOLERANCE / 100)
    widths = {r.group_no: (r.members, r.max_point_distance) for r in groups.collect()}
    inside = {}
    for r in members.collect():
        inside.setdefault(r.group_no, set()).add(r.path_index)
    assert {frozenset(m) for m in inside.values()} == set(want)
    for g, m in inside.items():
        assert widths[g][0] == len(m) and abs(widths[g][1] - want[frozenset(m)]) < 1e-9


def test_width_when_the_other_direction_is_closer(spark):
    """Nearly palindromic outlines: turned to the first they look farther apart than they are."""
    rng = random.Random(8)
    for _ in range(4):
        base = [(0, 0), (0.3, 0.1), (0.2, 0.2), (0.05, 0.1)]
        shapes = [jittered(rng, base, 0.2) for _ in range(12)]
        v = vertices(spark, *[outline(1, k, s) for k, s in enumerate(shapes)])
        distinct = spark.createDataFrame([(1, 1, k << 32, 4) for k in range(12)], "doc_id long, group_no int, node long, n long")
        got = components.group_width(distinct, v).collect()
        want = max(apart(a, b) for a, b in itertools.combinations(shapes, 2))
        assert len(got) == 1 and abs(got[0].widest - want) < 1e-9


def test_many_copies_in_one_spot_give_few_links(spark):
    count = 4000
    k = spark.range(count).select(F.col("id").alias("path"))
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for i, (x, y) in enumerate([(0, 0), (20, 2), (18, 20), (3, 16)])]))
    v = k.withColumn("c", corner).select(
        F.lit(1).cast("long").alias("doc_id"), F.col("path").cast("int").alias("path_index"), F.lit(0).alias("subpath_index"), F.lit(True).alias("closed"), "c.i",
        *[(F.col(f"c.{c}") + F.pmod(F.xxhash64("path", "c.i", F.lit(c)), F.lit(1000)) / 4000.0).alias(c) for c in "xy"])
    bounds = spark.createDataFrame([(1, 100.0)], "doc_id long, diagonal double")
    links = pairs.duplicate_links(v, bounds, 0.01)
    assert links.count() < 4 * count
    groups, _ = components.duplicate_groups(v, bounds, 0.01)
    row = groups.collect()
    assert [r.members for r in row] == [count] and 0.3 < row[0].max_point_distance < 0.354


def test_ordinals_without_issues_and_bounds(spark):
    v = vertices(spark, outline(1, 0, [(0, 0), (5, 0), (5, 5)]))
    groups, members = components.duplicate_groups(v, outlines.document_bounds(v))
    assert groups.count() == 0 and members.count() == 0


def test_every_pair_within_the_tolerance(spark):
    """Copies among each other and copies of near copies, against plain loops; also with copies in blocks of two."""
    rng = random.Random(11)
    bases = [jittered(rng, b, 0.3) for b in [[(0, 0), (9, 1), (8, 7), (1, 6)]] * 3 + [[(40, 10), (49, 11), (48, 17)]]]
    shapes = [s[::-1] if k % 2 else s for b in bases for k, s in enumerate([b] * rng.randint(3, 6))]
    rng.shuffle(shapes)
    v = vertices(spark, *[outline(1, k, s) for k, s in enumerate(shapes)], *[outline(2, k, [(1, 1)]) for k in range(2)])
    bounds = spark.createDataFrame([(1, 100.0), (2, 0.0)], "doc_id long, diagonal double")
    want = {(i, j): apart(shapes[i], shapes[j]) for i, j in itertools.combinations(range(len(shapes)), 2) if apart(shapes[i], shapes[j]) <= TOLERANCE}
    shaped = pairs.shapes(v).where("doc_id = 1")
    firsts = {r.node: r.shape for r in shaped.collect()}
    close = [(1, a, b, want[a >> 32, b >> 32]) for a in set(firsts.values()) for b in set(firsts.values()) if (a >> 32, b >> 32) in want]
    blocks = pairs.member_pairs(spark.createDataFrame(close, "doc_id long, src long, dst long, distance double"), shaped, 2)
    for found in (pairs.duplicate_pairs(v, bounds, TOLERANCE / 100, every=True), blocks):
        rows = found.collect()
        assert all(r.doc_id == 1 and abs(r.distance - want[r.src >> 32, r.dst >> 32]) < 1e-9 for r in rows)
        assert sorted((r.src >> 32, r.dst >> 32) for r in rows) == sorted(want)
