"""Golden cases for pixels, palettes, tracing and file sources."""

from __future__ import annotations

import math
import random

import pytest

from helpers import MASK, PIXEL, png
from inkgrid.operators import palette, pixels, raster
from inkgrid.sources import files
from inkgrid.streaming import ingest


def mask(spark, *art):
    rows = [(1, m, y, x) for m, lines in enumerate(art) for y, line in enumerate(lines) for x, c in enumerate(line) if c == "#"]
    return spark.createDataFrame(rows, MASK)


ART = [["######", "#....#", "#.##.#", "#....#", "######"], ["#.", ".#"], ["###", "#.#", "###"], ["####", "#..#", "##.#", "####"]]


def test_trace_gives_rings_that_fill_back_to_the_mask(spark):
    m = mask(spark, *ART)
    rings = raster.trace_masks(m)
    table = raster.ring_table(rings)
    counts = {(r.mask_id, r.is_hole): r["count"] for r in table.groupBy("mask_id", "is_hole").count().collect()}
    assert counts == {(0, False): 2, (0, True): 1, (1, False): 2, (2, False): 1, (2, True): 1, (3, False): 1, (3, True): 1}
    canvas = spark.createDataFrame([(1, 6, 5)], "image_id long, width int, height int")
    again = raster.rasterize(raster.outline_links(m), canvas, raster.MASK, ["image_id"])
    assert again.select(*m.columns).exceptAll(m).isEmpty() and m.exceptAll(again.select(*m.columns)).isEmpty()
    # consecutive corners share one coordinate, all the way round
    walks = {}
    for r in rings.collect():
        walks.setdefault((r.mask_id, r.ring), {})[r.i] = (r.x, r.y)
    for walk in walks.values():
        path = [walk[k] for k in range(len(walk))]
        for (ax, ay), (bx, by) in zip(path, path[1:] + path[:1]):
            assert (ax == bx) != (ay == by)


def test_denoise_mirrors_borders_of_tiny_images(spark):
    px = spark.createDataFrame([(1, y, x, 10 * x + y, 0, 0, 255) for y in range(2) for x in range(3)], PIXEL)
    canvas = spark.createDataFrame([(1, 3, 2)], "image_id long, width int, height int")
    got = {(r.y, r.x): r.b for r in pixels.denoise(px, canvas, 3).collect()}
    kernel = pixels.gaussian_kernel(3)

    def at(p, n):
        p %= 2 * (n - 1)
        return p if p < n else 2 * (n - 1) - p

    for y in range(2):
        for x in range(3):
            v = sum(kernel[i] * kernel[j] * (10 * at(x + i - 3, 3) + at(y + j - 3, 2)) for i in range(7) for j in range(7))
            assert got[(y, x)] == math.floor(round(v, 6) + 0.5)
    assert pixels.denoise(px, canvas, 0) is px


def test_contrast_truncates(spark):
    px = spark.createDataFrame([(1, 0, 0, 101, 200, 3, 255)], PIXEL)
    row = pixels.contrast_brightness(px, 1.5, -10).collect()[0]
    assert (row.b, row.g, row.r) == (141, 255, 0)


def _image(spark, colours, width=4):
    rows = [(1, k // width, k % width, *c, 255) for k, c in enumerate(colours)]
    return spark.createDataFrame(rows, PIXEL)


def test_palette_of_solid_blocks(spark):
    colours = [(0, 0, 255)] * 18 + [(0, 255, 0)] * 18 + [(255, 0, 0)] * 18
    groups = palette.palette(_image(spark, colours, 9), tolerance=5.0).orderBy("group_no").collect()
    assert [g.pixel_count for g in groups] == [18, 18, 18]
    assert {g.color_hex for g in groups} == {"#ff0000", "#00ff00", "#0000ff"}


def _clusters(lab, tolerance, limit):
    """Plain leader clustering on (count, Lab) entries in the given order."""
    groups = []
    for k, (n, p) in enumerate(lab):
        best = min(range(len(groups)), key=lambda g: (math.dist(groups[g]["c"], p), g), default=None)
        if best is None or math.dist(groups[best]["c"], p) > tolerance:
            groups.append({"c": p, "n": n, "m": [k]})
        else:
            g = groups[best]
            g["c"] = [(a * g["n"] + b * n) / (g["n"] + n) for a, b in zip(g["c"], p)]
            g["n"] += n
            g["m"].append(k)
    while limit and len(groups) > limit:
        _, i, j = min((math.dist(groups[i]["c"], groups[j]["c"]), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
        a, b = groups[i], groups.pop(j)
        a["c"] = [(x * a["n"] + y * b["n"]) / (a["n"] + b["n"]) for x, y in zip(a["c"], b["c"])]
        a["n"] += b["n"]
        a["m"] += b["m"]
    return sorted(groups, key=lambda g: -g["n"])


@pytest.mark.parametrize("limit", [None, 3])
def test_clusters_like_the_plain_fold(spark, limit):
    rng = random.Random(11)
    base = [(rng.randrange(256), rng.randrange(256), rng.randrange(256)) for _ in range(5)]
    colours = [tuple(min(255, max(0, c + rng.randint(-6, 6))) for c in rng.choice(base)) for _ in range(200)]
    px = _image(spark, colours, 20)
    unique = palette.unique_colors(px)
    lab = pixels.to_lab(unique.withColumn("y", unique.b)).collect()
    lab.sort(key=lambda r: (-r.pixel_count, r.b, r.g, r.r))
    want = _clusters([(r.pixel_count, [r.lab_l, r.lab_a, r.lab_b]) for r in lab], 12.0, limit)
    got = {}
    for r in palette.cluster_colors(unique, 12.0, limit).collect():
        got.setdefault(r.group_no, set()).add((r.b, r.g, r.r))
    sizes = [g["n"] for g in want]
    assert [len(got[k]) for k in sorted(got)] == [len(g["m"]) for g in want]
    if len(set(sizes)) == len(sizes):
        assert [got[k] for k in sorted(got)] == [{(lab[i].b, lab[i].g, lab[i].r) for i in g["m"]} for g in want]


def test_colour_budget_coarsens(spark):
    colours = [(b, g, 7) for b in range(40) for g in range(40)]
    found = palette.unique_colors(_image(spark, colours, 40)).collect()
    assert {r.step for r in found} == {2} and len(found) == 400 and sum(r.pixel_count for r in found) == 1600


def test_image_source_and_catalogue(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(3, 2, lambda x, y: (10 * x, 20 * y, 5, 0 if x == 0 else 255)))
    (tmp_path / "broken.png").write_bytes(b"no image")
    images, rejects = files.load_images(spark, str(tmp_path))
    px = sorted(tuple(r)[1:] for r in pixels.explode_pixels(images).collect())
    assert px == sorted((y, x, 5, 20 * y, 10 * x, 0 if x == 0 else 255) for y in range(2) for x in range(3))
    assert {r.a for r in pixels.explode_pixels(images, keep_alpha=False).collect()} == {255}
    assert [r.reason for r in rejects.collect()] == ["corrupt_image"]
    rows = {r.file_name: r for r in files.image_catalog(files.read_files(spark, str(tmp_path))).collect()}
    assert (rows["a.png"].width, rows["a.png"].height, rows["a.png"].mime) == (3, 2, "image/png")
    assert rows["broken.png"].width is None


def _files_opened(df):
    """Number of files that the scans of a collected frame were given."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    leaves, scans = plan.collectLeaves(), []
    for k in range(leaves.size()):
        metric = leaves.apply(k).metrics().get("numFiles")
        if metric.isDefined():
            scans.append(metric.get().value())
    return scans


def test_headers_are_looked_at_before_decoding(spark, tmp_path):
    good = png(3, 2, lambda x, y: (x, y, 0, 255))
    wide = good[:16] + bytes.fromhex("0000753000007530") + good[24:]
    for name, data in {"a.png": good, "b b.png": wide, "c.png": good[:40], "d.webp": b"RIFF0000WEBPVP8 ", "e.png": good + bytes(5000), "f.png": png(6001, 1, lambda x, y: (0, 0, 0, 255)), "g.png": wide}.items():
        (tmp_path / name).write_bytes(data)
    want = {"b%20b.png": "dimensions_exceeded", "c.png": "corrupt_image", "d.webp": "unsupported_format", "e.png": "file_too_large", "f.png": "dimensions_exceeded", "g.png": "dimensions_exceeded"}
    for block in (10_000, 4, 2, 1):
        images, rejects = files.load_images(spark, str(tmp_path), max_bytes=4000, block=block)
        assert {r.origin.rsplit("/", 1)[1]: r.reason for r in rejects.collect()} == want, block
        assert [r.origin.rsplit("/", 1)[1] for r in images.collect()] == ["a.png"]
    # the scan that decodes is given the three files left: a, c and d
    images, _ = files.load_images(spark, str(tmp_path), max_bytes=4000)
    assert _files_opened(images) == [3]
    assert files.load_images(spark, str(tmp_path), max_side=30_000, max_pixels=10**9, max_bytes=10**6)[0].count() == 3


def test_files_are_written_as_told(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([("1", bytearray(b"\x89PNG\xff\0")), ("2", None), (None, bytearray(b"x\ny"))], "name string, content binary")
    want = [b"\n", b"\x89PNG\xff\0\n", b"x\ny\n"]
    for folder in (str(tmp_path / "plain"), f"file://{tmp_path}/named"):
        files.write_files(spark, rows, folder)
        files.write_files(spark, rows, folder)  # a task that is run again
    assert {f.name: f.read_bytes() for f in (tmp_path / "plain").iterdir()} == {"1": want[1], "2": want[0], "null": want[2]}
    assert sorted(bytes(r.content) for r in files.read_files(spark, str(tmp_path / "named")).collect()) == sorted(want)
    files.write_files(spark, rows.limit(0), str(tmp_path / "none"))
    assert files.read_files(spark, str(tmp_path / "none")).count() == 0
    monkeypatch.setattr(files, "_local_path", lambda *_: None)
    files.write_files(spark, rows, str(tmp_path / "far"))
    assert sorted(bytes(r.content) for r in files.read_files(spark, str(tmp_path / "far")).collect()) == sorted(want)


def test_small_files_share_tasks_and_are_read_once(spark, tmp_path):
    jpeg = bytes.fromhex("ffd8ffe000040000ffc0000b08") + (7).to_bytes(2, "big") + (9).to_bytes(2, "big") + bytes(8)
    for k in range(600):
        (tmp_path / f"{k}.bin").write_bytes(png(1, 1, lambda x, y: (0, 0, 0, 0)) if k % 3 else jpeg if k % 2 else b"no image")
    scan = files.read_files(spark, str(tmp_path))
    least = 4 * spark.sparkContext.defaultParallelism
    assert scan.rdd.getNumPartitions() > least and files.fewer_tasks(scan).rdd.getNumPartitions() == least
    headers = files.image_headers(spark, str(tmp_path), max_side=8)
    assert _files_opened(headers) == [600]
    got = {(r.width, r.height, r.reason): r["count"] for r in headers.groupBy("width", "height", "reason").count().collect()}
    assert got == {(1, 1, None): 400, (9, 7, "dimensions_exceeded"): 100, (None, None, None): 100}
    assert [files._size(t) for t in ("16m", "128MB", "134217728b", "7", "1g")] == [1 << 24, 1 << 27, 1 << 27, 7, 1 << 30]


def test_refused_paths_are_taken_letter_by_letter(spark, tmp_path):
    wide = png(6001, 1, lambda x, y: (0, 0, 0, 255))
    for name in ("it's.png", 'a"b.png', "ü ß.png", "c%20d.png"):
        (tmp_path / name).write_bytes(wide)
    (tmp_path / "its.png").write_bytes(png(2, 1, lambda x, y: (1, 2, 3, 255)))
    for block in (10_000, 2):
        images, rejects = files.load_images(spark, str(tmp_path), block=block)
        assert [r.reason for r in rejects.collect()] == ["dimensions_exceeded"] * 4
        assert [r.origin.rsplit("/", 1)[1] for r in images.collect()] == ["its.png"]


def test_images_of_one_batch_keep_their_shapes(spark, monkeypatch):
    shapes = [(3, 2, 4), (3, 2, 1), (2, 3, 4), (4, 2, 3), (3, 2, 4), (3, 130, 4)]
    rng = random.Random(5)
    given = [(k, w, h, c, bytearray(rng.randrange(256) for _ in range(w * h * c))) for k, (w, h, c) in enumerate(shapes)]
    images = spark.createDataFrame(given, "image_id long, width int, height int, n_channels int, data binary").coalesce(1)
    want = set()
    for k, w, h, c, data in given:
        for at in range(w * h):
            cell = data[at * c:at * c + c]
            want.add((k, at // w, at % w, *(cell[:3] if c > 2 else [cell[0]] * 3), cell[3] if c == 4 else 255))
    for limit in (1, 100, 1 << 22):
        monkeypatch.setattr(pixels, "_FRAME_BYTES", limit)
        got = [tuple(r) for r in pixels.explode_pixels(images).collect()]
        assert len(got) == len(want) and set(got) == want


def test_upload_rules_know_the_decode_result(spark, tmp_path):
    good = png(3, 2, lambda x, y: (x, y, 0, 255))
    for name, data in {"a.png": good, "b.png": good[:40], "c.png": b"", "d.png": good + bytes(5000), "e.gif": good, "f.png": b"\0" + good, "g.png": good}.items():
        (tmp_path / name).write_bytes(data)
    types = spark.createDataFrame([(f"{n}.png", "image/png") for n in "abcdf"] + [("e.gif", "image/png")], "file_name string, mime string")
    rows = files.checked_uploads(spark, str(tmp_path), types, max_bytes=4000).collect()
    assert {r.file_name: r.reason for r in rows} == {"a.png": None, "b.png": "corrupt_file", "c.png": "empty_file", "d.png": "file_too_large", "e.gif": "unsupported_format", "f.png": "corrupt_file", "g.png": "unsupported_format"}


def test_registry_skips_unreadable_files(spark, tmp_path):
    from pyspark.sql import types as T

    (tmp_path / "p1").mkdir()
    (tmp_path / "p1" / "v1.json").write_text('{"project_id": 1,\n "version": 1}')
    (tmp_path / "p1" / "v2.json").write_text("{broken")
    schema = T.StructType([T.StructField("project_id", T.LongType()), T.StructField("version", T.LongType())])
    assert [tuple(r) for r in files.load_registry(spark, str(tmp_path), schema).collect()] == [(1, 1)]


def test_streams(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("version", T.LongType()), T.StructField("name", T.StringType())])
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    for n, lines in enumerate((['{"key":"a","version":1,"name":"x"}', '{"key":"b","version":4,"name":"y"}'], ['{"key":"a","version":2,"name":"z"}', '{"key":"b","version":3,"name":"old"}'])):
        (src / f"{n}.json").write_text("\n".join(lines))
        ingest.stream_latest(spark, str(src), schema, ["key"], "version", out, str(tmp_path / "state")).awaitTermination()
    got = {r.key: (r.version, r.name) for r in ingest.latest_snapshot(spark, schema, out).collect()}
    assert got == {"a": (2, "z"), "b": (4, "y")}

    (src / "2.json").write_text('{"key":"","version":1}\n{"key":"","version":1}')
    stream = ingest.idempotent_stream(spark.readStream.schema(schema).json(str(src)), "key")
    query = stream.writeStream.format("memory").queryName("first_uploads").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    counts = {r.key: r["count"] for r in spark.table("first_uploads").groupBy("key").count().collect()}
    assert counts == {"a": 1, "b": 1, "": 2}


def test_runs_give_the_corners_and_rings_of_their_pixels(spark):
    rng = random.Random(3)
    m = mask(spark, *ART, *[["".join(rng.choice("#.") for _ in range(70)) for _ in range(9)] for _ in range(4)])
    pieces = m.selectExpr(*raster.MASK, "y", "x as a", "x as b").unionByName(m.where("x % 3 = 0").selectExpr(*raster.MASK, "y", "x as a", "x as b"))
    runs = raster.merged_runs(pieces, raster.MASK)
    filled = runs.selectExpr(*raster.MASK, "y", "explode(sequence(a, b)) as x")
    assert sorted(filled.collect()) == sorted(m.select(*raster.MASK, "y", "x").collect())
    assert runs.count() == m.join(m.selectExpr(*raster.MASK, "y", "x + 1 as x"), [*raster.MASK, "y", "x"], "left_anti").count()
    assert sorted(raster.run_corners(runs).collect()) == sorted(raster.outline_corners(m).collect())
    assert sorted(raster.trace_runs(runs).collect()) == sorted(raster.trace_masks(m).collect())


def test_runs_meet_once_they_share_a_column(spark):
    rng = random.Random(5)
    rows = [[(rng.randrange(2), rng.randrange(3), a, a + rng.randrange(90)) for a in (rng.randrange(-2, 200) for _ in range(40))] for _ in range(2)]
    here, there = (spark.createDataFrame(r, f"k int, y int, {n}") for r, n in zip(rows, ("a int, b int", "a2 int, b2 int"), strict=True))
    got = {tuple(r) for r in raster.meeting_runs(here, there, ["k"]).select("k", "y", "a", "b", "a2", "b2").collect()}
    assert got == {(*p, *q[2:]) for p in rows[0] for q in rows[1] if p[:2] == q[:2] and p[2] <= q[3] and q[2] <= p[3]}


def test_wide_fills_move_no_pixels(spark):
    edges = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 2.0), (1, 90.0, 0.0, 90.0, 2.0)], "doc_id long, x1 double, y1 double, x2 double, y2 double")
    canvas = spark.createDataFrame([(1, 100, 2)], "doc_id long, width int, height int")
    filled = raster.rasterize(edges, canvas, ["doc_id"], ["doc_id"])
    assert sorted((r.y, r.x) for r in filled.collect()) == [(y, x) for y in range(2) for x in range(90)]
    plan = filled._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[:plan.index("Generate explode(sequence(a")]
