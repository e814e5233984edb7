"""Outline simplification (Douglas-Peucker)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgrid.functions.geometry import perpendicular_distance
from inkgrid.functions.svgtext import PATH_TAG, extract_subpaths, is_supported_path, without_comments
from inkgrid.operators.outlines import drawing_bounds
from inkgrid.operators.svg import KEY, path_text, svg_paths, svg_stats
from inkgrid.session import cut_lineage

PIECE_LIMIT = 50_000


def _gaps(x: np.ndarray, y: np.ndarray, a: int, b: int) -> np.ndarray:
    """Distances of the points between a and b to the line through them."""
    dx, dy = x[b] - x[a], y[b] - y[a]
    px, py = x[a + 1:b], y[a + 1:b]
    if dx == 0 and dy == 0:
        return np.hypot(px - x[a], py - y[a])
    return np.abs(dy * px - dx * py + x[b] * y[a] - y[b] * x[a]) / np.hypot(dx, dy)


def _kept(x: np.ndarray, y: np.ndarray, eps: float) -> np.ndarray:
    keep = np.zeros(len(x), dtype=bool)
    keep[[0, -1]] = True
    open_spans = [(0, len(x) - 1)]
    while open_spans:
        a, b = open_spans.pop()
        if b - a < 2:
            continue
        gap = _gaps(x, y, a, b)
        far = int(gap.argmax())
        if gap[far] > eps:
            mid = a + 1 + far
            keep[mid] = True
            open_spans += [(a, mid), (mid, b)]
    return keep


def _split_long(points: DataFrame, limit: int) -> DataFrame:
    """Splits pieces longer than the limit at their farthest point, all pieces of a level at once.

    Splitting is exactly the first levels of the algorithm; what is left fits
    one task.  A long piece that needs no split keeps its two ends only.
    """
    while True:
        long = points.where(F.col("hi") - F.col("lo") > limit)
        if long.isEmpty():
            return points
        gap = perpendicular_distance((F.col("x"), F.col("y")), (F.col("ax"), F.col("ay")), (F.col("bx"), F.col("by")))
        inner = long.where("i > lo and i < hi")
        far = inner.groupBy(*KEY, "lo", "hi").agg(F.max(F.struct(gap.alias("gap"), (-F.col("i")).alias("ni"), "x", "y")).alias("f"))
        both = long.join(far, [*KEY, "lo", "hi"])
        mid = -F.col("f.ni")
        flat = both.where("f.gap <= eps and (i = lo or i = hi)").select(*points.columns)
        flat = flat.withColumns({"lo": F.col("i"), "hi": F.col("i")})
        split = both.where("f.gap > eps").withColumn("side", F.explode(
            F.when(F.col("i") < mid, F.array(F.lit(0))).when(F.col("i") > mid, F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1)))
        ))
        left = F.col("side") == 0
        halves = split.select(
            *KEY, "closed", "n", "eps", "i", "x", "y", F.when(left, F.col("lo")).otherwise(mid).alias("lo"),
            F.when(left, mid).otherwise(F.col("hi")).alias("hi"),
            *[F.when(left, F.col(f"a{c}")).otherwise(F.col(f"f.{c}")).alias(f"a{c}") for c in "xy"],
            *[F.when(left, F.col(f"f.{c}")).otherwise(F.col(f"b{c}")).alias(f"b{c}") for c in "xy"],
        )
        rest = points.where(F.col("hi") - F.col("lo") <= limit)
        points = cut_lineage(rest.unionByName(halves).unionByName(flat))


def simplify(vertices: DataFrame, bounds: DataFrame, ratio: float, limit: int = PIECE_LIMIT) -> DataFrame:
    """Outlines with fewer vertices, no farther than ``ratio`` x document diagonal from the original.

    A closed outline is opened by repeating its first point.  Outlines that
    would fall below three (closed) points stay as they are.
    """
    sizes = vertices.groupBy(*KEY).agg(
        F.count("*").alias("n"), F.min_by(F.struct("x", "y"), "i").alias("first"), F.max_by(F.struct("x", "y"), "i").alias("last"),
        F.first("closed").alias("_c"),
    )
    eps = bounds.select("doc_id", (F.col("diagonal") * ratio).alias("eps"))
    sized = sizes.join(eps, "doc_id").withColumn("end", F.when(F.col("_c"), F.col("n")).otherwise(F.col("n") - 1))
    live = sized.where("n >= 3 and eps > 0")
    ends = live.select(
        *KEY, "n", "eps", F.lit(0).cast("long").alias("lo"), F.col("end").alias("hi"),
        *[F.col(f"first.{c}").alias(f"a{c}") for c in "xy"],
        *[F.when(F.col("_c"), F.col(f"first.{c}")).otherwise(F.col(f"last.{c}")).alias(f"b{c}") for c in "xy"],
    )
    closing = live.where("_c").select(
        *KEY, F.lit(True).alias("closed"), F.col("n").alias("i"), F.col("first.x").alias("x"), F.col("first.y").alias("y")
    )
    opened = vertices.select(*KEY, "closed", F.col("i").cast("long").alias("i"), "x", "y").unionByName(closing)
    points = _split_long(opened.join(ends, KEY), limit)
    pieces = points.groupBy(*KEY, "lo", "hi", "eps").agg(F.array_sort(F.collect_list(F.struct("i", "x", "y"))).alias("p")).select(
        *KEY, "eps", *[F.col(f"p.{c}").alias(c) for c in ("i", "x", "y")]
    )

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            masks = [_kept(np.asarray(x), np.asarray(y), e) for x, y, e in zip(batch["x"], batch["y"], batch["eps"])]
            if not masks:
                continue
            counts = [int(m.sum()) for m in masks]
            out = {c: np.repeat(batch[c].to_numpy(), counts) for c in KEY}
            yield pd.DataFrame({**out, "i": np.concatenate([np.asarray(i)[m] for i, m in zip(batch["i"], masks)])})

    kept = pieces.mapInPandas(reduce, "doc_id long, path_index int, subpath_index int, i long").distinct()
    inside = kept.join(live.select(*KEY, "n", "_c"), KEY).where("i < n or not _c")
    counts = inside.groupBy(*KEY).agg(F.count("*").alias("left"))
    fine = live.join(counts, KEY).where("left >= case when _c then 3 else 2 end").select(*KEY)
    marked = inside.join(fine, KEY, "left_semi").select(*KEY, F.col("i").cast("int").alias("i"))
    changed = vertices.join(marked, [*KEY, "i"], "left_semi")
    same = vertices.join(fine, KEY, "left_anti")
    return changed.unionByName(same)


def simplified_documents(docs: DataFrame, ratio: float, limit: int = PIECE_LIMIT) -> DataFrame:
    """``doc_id, svg`` with fewer nodes: only the data of paths made of M, L and Z is rewritten.

    Paths are simplified in their own coordinates, whatever their transform; the
    tolerance is a share of the whole drawing's diagonal.  Other paths, other
    attributes and all other markup stay; comments go.
    """
    local = svg_paths(docs).where(is_supported_path(F.col("d"))).select(
        "doc_id", "path_index", F.posexplode(extract_subpaths(F.col("d"))).alias("subpath_index", "s")
    ).where(F.size("s.points") >= 2).select(*KEY, F.col("s.closed").alias("closed"), F.posexplode("s.points").alias("i", "p"))
    vertices = cut_lineage(local.select(*KEY, "closed", "i", "p.x", "p.y"))
    fewer = simplify(vertices, drawing_bounds(svg_stats(docs)), ratio, limit)
    data = path_text(fewer).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("path_index", "d"))).alias("data"))
    text = without_comments(F.col("svg"))
    rows = docs.join(data, "doc_id", "left").select(
        "doc_id", "data", F.split(text, PATH_TAG, -1).alias("between"), F.regexp_extract_all(text, F.lit(PATH_TAG), F.lit(0)).alias("tags")
    )

    def tag(i: Column) -> Column:
        old = F.get("tags", i)
        new = F.try_element_at("data", i)
        return F.coalesce(F.when(new.isNotNull(), F.regexp_replace(old, F.lit(r"(\sd\s*=\s*)(\"[^\"]*\"|'[^']*')"), F.concat(F.lit('$1"'), new, F.lit('"')))), old, F.lit(""))

    return rows.select("doc_id", F.array_join(F.transform("between", lambda part, i: F.concat(part, tag(i))), "").alias("svg"))


def reduction(before: DataFrame, after: DataFrame) -> DataFrame:
    """Saved share of nodes per document, between 0 and 100."""
    b = before.groupBy("doc_id").agg(F.count("*").alias("nodes_before"))
    a = after.groupBy("doc_id").agg(F.count("*").alias("nodes_after"))
    saved = (F.col("nodes_before") - F.col("nodes_after")) / F.col("nodes_before") * 100.0
    return b.join(a, "doc_id", "left").na.fill(0, ["nodes_after"]).withColumn(
        "reduction_percent", F.when(F.col("nodes_before") <= 0, 0.0).otherwise(F.greatest(F.least(saved, F.lit(100.0)), F.lit(0.0)))
    )
