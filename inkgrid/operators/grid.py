"""Spatial equi-joins on a hierarchy of grids.

A box is filed under cells of about its own size, so it touches at most four
cells whatever its extent, and a big box is not copied into many small cells.
Cells in which too many boxes meet are halved further.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgrid.session import cut_lineage, shuffled

_SMALLEST = 1e-9


def _cells(level: Column, lo_x: Column, lo_y: Column, hi_x: Column, hi_y: Column) -> Column:
    size = F.pow(F.lit(2.0), level)

    def span(lo: Column, hi: Column) -> Column:
        return F.sequence(F.floor(lo / size), F.floor(hi / size))

    return F.flatten(F.transform(span(lo_x, hi_x), lambda cx: F.transform(
        span(lo_y, hi_y), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy"))
    )))


def with_level(boxes: DataFrame) -> DataFrame:
    """Adds ``level``: the power of two not below the longer side."""
    longest = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"), F.lit(_SMALLEST))
    return boxes.withColumn("level", F.ceil(F.log2(longest)).cast("int"))


def _levels(boxes: DataFrame, scope: str) -> DataFrame:
    return boxes.groupBy(scope).agg(F.collect_set("level").alias("_levels"))


def points_in_boxes(points: DataFrame, boxes: DataFrame, scope: str) -> DataFrame:
    """Pairs of a point (``px, py``) and a box of the same scope that holds it (edges included)."""
    filed = with_level(boxes)
    cells = filed.withColumn("_c", F.explode(_cells(F.col("level"), *[F.col(c) for c in ("min_x", "min_y", "max_x", "max_y")])))
    probe = points.join(_levels(filed, scope), scope).withColumn("level", F.explode("_levels")).drop("_levels")
    size = F.pow(F.lit(2.0), F.col("level"))
    probe = probe.withColumns({"cx": F.floor(F.col("px") / size), "cy": F.floor(F.col("py") / size)})
    return probe.join(
        cells.withColumns({"cx": F.col("_c.cx"), "cy": F.col("_c.cy")}).drop("_c"), [scope, "level", "cx", "cy"]
    ).where("px between min_x and max_x and py between min_y and max_y").drop("level", "cx", "cy")


#: Scopes with at most so many times the pairs of a crowded cell need no cells.
ALONE = 16
#: A cell in which more pairs than this would be compared is halved, at most so many times.
CROWDED, HALVINGS = 1 << 16, 20
_KEY = ["_at", "cx", "cy", "path"]
_PART = [f"_{end}_{c}" for c in "xy" for end in ("min", "max")]


def _mid(c: str) -> Column:
    return (F.col(f"_lo_{c}") + F.col(f"_hi_{c}")) / 2.0


def _crowded(filed: DataFrame, scope: str, limit: int) -> DataFrame:
    """Cells with too many pairs, and the axis along which fewer of their boxes lie on both sides; cells that halving no longer thins out are left."""
    over = {c: F.count_if((F.col(f"_min_{c}") < _mid(c)) & (F.col(f"_max_{c}") >= _mid(c))) for c in "xy"}
    sums = filed.groupBy(scope, *_KEY).agg(F.count_if("_own").alias("_a"), F.count("*").alias("_b"), over["x"].alias("_x"), over["y"].alias("_y"))
    return sums.where((F.length("path") < HALVINGS) & (F.col("_a") * F.col("_b") > limit) & (F.least("_x", "_y") * 4 < F.col("_b") * 3)).select(scope, *_KEY, (F.col("_x") <= F.col("_y")).alias("_across"))


def _halved(filed: DataFrame, crowded: DataFrame, scope: str, segments: bool) -> DataFrame:
    """The boxes of crowded cells filed under the half or halves they reach; of a segment only the part in the half counts from then on."""
    rows = filed.join(crowded, [scope, *_KEY])

    def cut(side: int, c: str) -> list[Column]:
        """``_min_x, _max_x, _min_y, _max_y`` after halving along ``c``."""
        o = "y" if c == "x" else "x"
        ends = {f"_min_{c}": F.greatest(f"_min_{c}", _mid(c)) if side else F.col(f"_min_{c}"), f"_max_{c}": F.col(f"_max_{c}") if side else F.least(f"_max_{c}", _mid(c))}
        if segments:
            margin = F.least(f"{o}1", f"{o}2") - F.col(f"min_{o}")
            run = F.col(f"{c}2") - F.col(f"{c}1")

            def other(at: Column) -> Column:
                t = F.when(run == 0, F.lit(None)).otherwise((at - F.col(f"{c}1")) / run)
                return F.col(f"{o}1") + F.greatest(F.least(t, F.lit(1.0)), F.lit(0.0)) * (F.col(f"{o}2") - F.col(f"{o}1"))

            # The margin widens the stretch as well, so that what is within it of the stretch is not lost.
            reach = [other(ends[f"_min_{c}"] - margin), other(ends[f"_max_{c}"] + margin)]
            slack = F.abs(F.col(f"{o}1")) * 1e-12 + F.abs(F.col(f"{o}2")) * 1e-12
            ends[f"_min_{o}"] = F.when(run == 0, F.col(f"_min_{o}")).otherwise(F.greatest(F.col(f"_min_{o}"), F.least(*reach) - margin - slack))
            ends[f"_max_{o}"] = F.when(run == 0, F.col(f"_max_{o}")).otherwise(F.least(F.col(f"_max_{o}"), F.greatest(*reach) + margin + slack))
        else:
            ends[f"_min_{o}"], ends[f"_max_{o}"] = F.col(f"_min_{o}"), F.col(f"_max_{o}")
        return [ends[n].alias(n) for n in _PART]

    def half(side: int, c: str) -> Column:
        inside = F.col(f"_min_{c}") < _mid(c) if side == 0 else F.col(f"_max_{c}") >= _mid(c)
        bounds = [(_mid(k) if k == c and (end == "hi") == (side == 0) else F.col(f"_{end}_{k}")).alias(f"_{end}_{k}") for k in "xy" for end in ("lo", "hi")]
        return F.when(inside, F.struct(F.concat("path", F.lit(str(side))).alias("path"), *bounds, *cut(side, c)))

    new = ["path", *[f"_{end}_{k}" for k in "xy" for end in ("lo", "hi")], *_PART]
    kept = [c for c in filed.columns if c not in new]
    parts = []
    for side in (0, 1):
        h = F.when(F.col("_across"), half(side, "x")).otherwise(half(side, "y"))
        reached = rows.withColumn("_h", h).where("_h is not null").select(*kept, *[F.col(f"_h.{n}").alias(n) for n in new])
        parts.append(reached.where("_min_x <= _max_x and _min_y <= _max_y") if segments else reached)
    return parts[0].unionByName(parts[1]).select(*filed.columns)


def overlapping_boxes(boxes: DataFrame, scope: str, ident: str, segments: bool = False, limit: int = CROWDED) -> DataFrame:
    """Each unordered pair of overlapping boxes of a scope once, as columns a_* and b_*.

    In a scope of few boxes each box meets all others.  Elsewhere the
    pair is found where the coarser box is filed; the cell that holds the
    lower corner of the common part reports it, so no distinct is needed.  A
    crowded cell is halved along the axis that more of its boxes keep clear of, so
    many long boxes side by side do not meet under one key.

    ``segments``: the boxes are those of segments (``x1, y1, x2, y2``, with one
    margin on all sides).  In halved cells a segment is then filed only along its
    way, not all over its box; pairs whose boxes overlap while the segments are
    farther apart than their margins may be left out, and a pair that is near in
    several cells comes more than once.
    """
    levelled = cut_lineage(with_level(boxes))
    counts = levelled.groupBy(scope).agg(F.count("*").cast("double").alias("_k"))
    large = cut_lineage(counts.where(F.col("_k") * F.col("_k") > limit * ALONE).select(scope))
    if large.isEmpty():
        return _all_meet(levelled, scope, ident)
    few = _all_meet(levelled.join(large, scope, "left_anti"), scope, ident)
    return few.unionByName(_by_cells(levelled.join(large, scope, "left_semi"), scope, ident, segments, limit))


def _sides(scope: str, names: list[str]) -> list[str]:
    return [scope, *[f"{s}_{c}" for s in "ab" for c in names if c != "level"]]


def _once(ident: str) -> Column:
    return (F.col("a_level") > F.col("b_level")) | ((F.col("a_level") == F.col("b_level")) & (F.col(f"a_{ident}") < F.col(f"b_{ident}")))


def _all_meet(levelled: DataFrame, scope: str, ident: str) -> DataFrame:
    """The pairs of scopes with few boxes, without cells."""
    names = [c for c in levelled.columns if c != scope]
    dealt = levelled.repartition(scope)
    a, b = (dealt.select(scope, *[F.col(c).alias(f"{side}_{c}") for c in names]) for side in "ab")
    meet = F.lit(True)
    for c in "xy":
        meet = meet & (F.col(f"a_min_{c}") <= F.col(f"b_max_{c}")) & (F.col(f"b_min_{c}") <= F.col(f"a_max_{c}"))
    return a.join(shuffled(b), scope).where(meet & _once(ident)).select(*_sides(scope, names))


def _by_cells(levelled: DataFrame, scope: str, ident: str, segments: bool, limit: int) -> DataFrame:
    filed = levelled.join(_levels(levelled, scope), scope).withColumn("_at", F.explode(F.filter("_levels", lambda v: v >= F.col("level")))).drop("_levels")
    filed = filed.withColumn("_c", F.explode(_cells(F.col("_at"), *[F.col(c) for c in ("min_x", "min_y", "max_x", "max_y")]))).withColumn("_size", F.pow(F.lit(2.0), F.col("_at")))
    filed = filed.withColumns({"_own": F.col("level") == F.col("_at"), "cx": F.col("_c.cx"), "cy": F.col("_c.cy"), "path": F.lit("")}).withColumns(
        {f"_{end}_{c}": (F.col(f"c{c}") + k) * F.col("_size") for end, k in (("lo", 0), ("hi", 1)) for c in "xy"} | {n: F.col(n[1:]) for n in _PART}).drop("_c", "_size")
    state = cut_lineage(filed)
    parts = []
    while True:
        crowded = cut_lineage(_crowded(state, scope, limit))
        if crowded.isEmpty():
            parts.append(state)
            break
        parts.append(state.join(crowded, [scope, *_KEY], "left_anti"))
        state = cut_lineage(_halved(state, crowded, scope, segments))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    names = [c for c in levelled.columns if c != scope]
    a = whole.where("_own").select(scope, *_KEY, "_lo_x", "_lo_y", "_hi_x", "_hi_y", *[F.col(n).alias(f"_a{n}") for n in _PART], *[F.col(c).alias(f"a_{c}") for c in names])
    b = whole.select(scope, *_KEY, *[F.col(n).alias(f"_b{n}") for n in _PART], *[F.col(c).alias(f"b_{c}") for c in names])
    home, meet = None, None
    for c in "xy":
        corner = F.greatest(f"a_min_{c}", f"b_min_{c}")
        here = (corner >= F.col(f"_lo_{c}")) & (corner < F.col(f"_hi_{c}"))
        near = (F.col(f"_a_min_{c}") <= F.col(f"_b_max_{c}")) & (F.col(f"_b_min_{c}") <= F.col(f"_a_max_{c}")) if segments else (F.col(f"a_min_{c}") <= F.col(f"b_max_{c}")) & (F.col(f"b_min_{c}") <= F.col(f"a_max_{c}"))
        home, meet = (here, near) if home is None else (home & here, meet & near)
    if segments:
        home = home | (F.col("path") != "")
    return a.join(b, [scope, *_KEY]).where(meet & home & _once(ident)).select(*_sides(scope, names))
