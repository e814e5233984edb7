"""Colour palettes: distinct colours, clusters, groups, labels, group edits.

Only the order-dependent clustering leaves the JVM.  It sees one row per image
with at most ``budget`` colours, because colours are coarsened until they fit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgrid.functions.colour import bgr_to_lab, encode_hex, parse_hex, posterize_value
from inkgrid.functions.text import trimmed
from inkgrid.operators.pixels import per_image

COLOUR_BUDGET = 512
_LAST_STEP = 128


def _relevant(px: DataFrame) -> DataFrame:
    return px.where(F.col("a") > 0)


def _exact_colours(px: DataFrame) -> DataFrame:
    return _relevant(px).groupBy("image_id", "b", "g", "r").agg(
        F.count("*").alias("pixel_count"), F.bool_or(F.col("a") < 255).alias("has_partial_alpha")
    )


def colour_steps(colours: DataFrame, budget: int = COLOUR_BUDGET) -> DataFrame:
    """``image_id, step``: the smallest power of two that leaves at most ``budget`` colours.

    The colour cube is cut into 16x16x16 blocks.  Inside a block the finer
    steps are counted on at most 4096 codes, between blocks the coarser steps
    on at most 4096 blocks, so no row grows with the image.
    """
    def pack(shift: int) -> Column:
        parts = [F.shiftright(c, shift).cast("int") for c in ("b", "g", "r")]
        return parts[0] * 65536 + parts[1] * 256 + parts[2]

    def coarser(codes: Column, shift: int) -> Column:
        keep = (255 >> shift << shift) * 65793
        return F.size(F.array_distinct(F.transform(codes, lambda c: c.bitwiseAND(F.lit(keep)))))

    blocks = colours.groupBy("image_id", pack(4).alias("block")).agg(F.collect_set(pack(0)).alias("codes"))
    counted = blocks.select(
        "image_id", "block", *[coarser(F.col("codes"), k).cast("long").alias(f"n{k}") for k in range(4)]
    )
    per_image = counted.groupBy("image_id").agg(
        *[F.sum(f"n{k}").alias(f"n{k}") for k in range(4)], F.collect_set("block").alias("blocks")
    ).select(
        "image_id", *[f"n{k}" for k in range(4)],
        *[coarser(F.col("blocks"), k).cast("long").alias(f"n{k + 4}") for k in range(4)],
    )
    step = F.lit(_LAST_STEP)
    for k in range(6, -1, -1):
        step = F.when(F.col(f"n{k}") <= budget, F.lit(1 << k)).otherwise(step)
    return per_image.select("image_id", step.alias("step"))


def unique_colors(px: DataFrame, budget: int = COLOUR_BUDGET) -> DataFrame:
    """Distinct visible colours with counts, coarsened per image to the budget."""
    exact = _exact_colours(px)
    stepped = per_image(exact, colour_steps(exact, budget), ["b", "g", "r"])
    return stepped.groupBy(
        "image_id", "step", *[posterize_value(F.col(c), F.col("step")).alias(c) for c in "bgr"]
    ).agg(F.sum("pixel_count").alias("pixel_count"), F.bool_or("has_partial_alpha").alias("has_partial_alpha"))


class _Groups:
    """Groups of the colours of one image as weighted sums in Lab; ``of`` says where each colour is."""

    def __init__(self, points: np.ndarray, weights: np.ndarray, reach: float) -> None:
        """Heaviest colours first: a colour goes to the nearest group in reach, or opens one."""
        self.sums, self.mass = np.zeros_like(points), np.zeros(len(points))
        self.of = np.zeros(len(points), dtype=np.int64)
        opened, centres = 0, np.zeros(points.shape)
        for k, (point, weight) in enumerate(zip(points, weights)):
            away = np.sqrt(((centres[:opened] - point) ** 2).sum(axis=1))
            best = int(away.argmin()) if opened else -1
            if best < 0 or away[best] > reach:
                best, opened = opened, opened + 1
            self.sums[best] += point * weight
            self.mass[best] += weight
            centres[best] = self.sums[best] / self.mass[best]
            self.of[k] = best
        self.alive = np.arange(len(points)) < opened

    def _away(self, i: int) -> np.ndarray:
        """Distances of group i to all groups; infinite to itself and to groups that are gone."""
        with np.errstate(divide="ignore", invalid="ignore"):
            gap = np.sqrt(((self.sums / self.mass[:, None] - self.sums[i] / self.mass[i]) ** 2).sum(axis=1))
        gap[~self.alive] = np.inf
        gap[i] = np.inf
        return gap

    def _merge(self, keep: int, drop: int) -> None:
        self.sums[keep] += self.sums[drop]
        self.mass[keep] += self.mass[drop]
        self.alive[drop] = False
        self.of[self.of == drop] = keep

    def absorb_small(self, least: float) -> None:
        """The lightest group goes to its nearest one, as long as it is lighter than ``least``."""
        while self.alive.sum() > 1:
            lightest = int(np.where(self.alive, self.mass, np.inf).argmin())
            if self.mass[lightest] >= least:
                break
            self._merge(int(self._away(lightest).argmin()), lightest)

    def shrink_to(self, count: int) -> None:
        """Merges the closest two until ``count`` are left.  Every group remembers its nearest one and all distances, so a merge measures only from the group that grew."""
        left = int(self.alive.sum())
        if left <= count:
            return
        with np.errstate(divide="ignore", invalid="ignore"):
            centres = self.sums / self.mass[:, None]
            apart = np.sqrt(((centres[None, :, :] - centres[:, None, :]) ** 2).sum(axis=2))
        apart[~self.alive] = np.inf
        apart[:, ~self.alive] = np.inf
        np.fill_diagonal(apart, np.inf)
        near, gap = apart.argmin(axis=1), apart.min(axis=1)
        while left > count and left > 1:
            i = int(gap.argmin())
            keep, drop = sorted((i, int(near[i])))
            self._merge(keep, drop)
            left -= 1
            apart[drop] = apart[:, drop] = np.inf
            apart[keep] = apart[:, keep] = fresh = self._away(keep)
            again = self.alive & ((near == keep) | (near == drop))
            again[keep] = True
            near[again], gap[again], gap[drop] = apart[again].argmin(axis=1), apart[again].min(axis=1), np.inf
            closer = self.alive & ~again & ((fresh < gap) | ((fresh == gap) & (keep < near)))
            near[closer], gap[closer] = keep, fresh[closer]

    def numbers(self) -> np.ndarray:
        """Number of each colour's group, 0 for the heaviest; the earlier group first on ties."""
        order = sorted(np.flatnonzero(self.alive), key=lambda k: (-self.mass[k], k))
        number = np.zeros(len(self.alive), dtype=np.int64)
        number[order] = np.arange(len(order))
        return number[self.of]


def cluster_colors(
    colours: DataFrame, tolerance: float = 12.0, max_colors: int | None = None, tiny_ratio: float = 0.0
) -> DataFrame:
    """Colours with their final ``group_no`` (0 = largest group of the image).

    Colours are taken by count, then b, g, r; each joins the nearest centroid
    within the tolerance or founds a group.  Groups below ``tiny_ratio`` of the
    visible pixels then join their nearest, and the closest pairs are joined
    until ``max_colors`` are left.
    """
    lab = bgr_to_lab(F.col("b"), F.col("g"), F.col("r"))
    entry = F.struct(
        (-F.col("pixel_count")).alias("order"), "b", "g", "r",
        lab["lab_l"].alias("l0"), lab["lab_a"].alias("l1"), lab["lab_b"].alias("l2"),
    )
    per_image = colours.groupBy("image_id").agg(F.array_sort(F.collect_list(entry)).alias("c")).select(
        "image_id", *[F.col(f"c.{f}").alias(f) for f in ("order", "b", "g", "r", "l0", "l1", "l2")]
    )

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ranks = []
            for row in batch.itertuples(index=False):
                weight = -np.asarray(row.order, dtype=np.int64)
                points = np.stack([row.l0, row.l1, row.l2], axis=1).astype(float)
                groups = _Groups(points, weight, tolerance)
                if tiny_ratio > 0:
                    groups.absorb_small(tiny_ratio * int(weight.sum()))
                if max_colors is not None:
                    groups.shrink_to(max_colors)
                ranks.append(groups.numbers())
            if ranks:
                sizes = [len(r) for r in ranks]
                yield pd.DataFrame({
                    "image_id": np.repeat(batch["image_id"].to_numpy(), sizes),
                    **{c: np.concatenate(batch[c].to_numpy()) for c in ("b", "g", "r")}, "group_no": np.concatenate(ranks),
                })

    found = per_image.mapInPandas(fold, "image_id long, b int, g int, r int, group_no int")
    return colours.join(found, ["image_id", "b", "g", "r"])


def palette(
    px: DataFrame, tolerance: float = 12.0, max_colors: int | None = None, tiny_ratio: float = 0.001,
    budget: int = COLOUR_BUDGET,
) -> DataFrame:
    """One row per group: mean colour, pixel count, share of all pixels, partial alpha, and the step to which colours were coarsened."""
    members = cluster_colors(unique_colors(px, budget), tolerance, max_colors, tiny_ratio)
    return palette_groups(members, pixel_totals(px))


def pixel_totals(px: DataFrame) -> DataFrame:
    return px.groupBy("image_id").agg(
        F.count("*").alias("total_pixels"), F.count_if(F.col("a") == 0).alias("transparent_pixels")
    ).withColumn("transparent_percent", F.col("transparent_pixels") / F.col("total_pixels") * 100.0)


def palette_groups(members: DataFrame, totals: DataFrame) -> DataFrame:
    def mean(c: str) -> Column:
        return F.bround(F.sum(F.col(c) * F.col("pixel_count")) / F.sum("pixel_count"), 0).cast("int").alias(c)

    groups = members.groupBy("image_id", "group_no").agg(
        F.sum("pixel_count").alias("n"), F.bool_or("has_partial_alpha").alias("has_partial_alpha"),
        *[mean(c) for c in "bgr"], F.first("step").alias("step"),
    )
    return groups.join(totals, "image_id").select(
        "image_id", "group_no", encode_hex(F.col("b"), F.col("g"), F.col("r")).alias("color_hex"),
        F.col("n").alias("pixel_count"), (F.col("n") / F.col("total_pixels") * 100.0).alias("area_percent"),
        "has_partial_alpha", "transparent_percent", "step",
    )


def label_pixels(px: DataFrame, members: DataFrame, salts: int = 16) -> DataFrame:
    """Pixels with ``group_no``, -1 where fully transparent.

    A background colour may hold most pixels of an image, so pixels are spread
    by a salt and the (at most ``budget``) colours of each image repeated.
    """
    steps = members.groupBy("image_id").agg(F.first("step").alias("step"))
    seen = per_image(_relevant(px), steps, ["y", "x"], salts).select(
        "image_id", "y", "x", *[posterize_value(F.col(c), F.col("step")).alias(c) for c in "bgr"],
        F.pmod(F.xxhash64("y", "x"), F.lit(salts)).cast("int").alias("salt"),
    )
    lookup = members.select(
        "image_id", "b", "g", "r", "group_no", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    )
    labelled = seen.join(lookup, ["image_id", "b", "g", "r", "salt"]).select("image_id", "y", "x", "group_no")
    hidden = px.where(F.col("a") <= 0).select("image_id", "y", "x", F.lit(-1).alias("group_no"))
    return labelled.unionByName(hidden)


def border_touch(labels: DataFrame, canvas: DataFrame, flag_at: float = 0.5) -> DataFrame:
    """Share of the image perimeter that belongs to each group; corners count once."""
    w, h = F.col("width"), F.col("height")
    perimeter = F.when((w <= 1) | (h <= 1), w * h).otherwise(w * 2 + h * 2 - 4)
    on_border = (F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == w - 1) | (F.col("y") == h - 1)
    ratio = F.count_if(on_border) / F.first(perimeter)
    return per_image(labels.where("group_no >= 0"), canvas.select("image_id", "width", "height"), ["y", "x"]).groupBy("image_id", "group_no").agg(
        ratio.alias("border_ratio"), (ratio >= flag_at).alias("touches_border")
    )


def name_groups(groups: DataFrame) -> DataFrame:
    """``Color n`` in palette order; the largest group starts excluded iff it touches the border."""
    order = Window.partitionBy("image_id").orderBy("group_no")
    position = F.row_number().over(order)
    return groups.select(
        "*", F.concat(F.lit("Color "), position.cast("string")).alias("name"),
        ((position == 1) & F.col("touches_border")).alias("is_excluded"),
    )


def sort_groups(groups: DataFrame) -> DataFrame:
    """Palette order of each image as ``position``: share descending, then name."""
    order = Window.partitionBy("image_id").orderBy(F.col("area_percent").desc(), "name", "group_id")
    return groups.withColumn("position", F.row_number().over(order))


def valid_merges(groups: DataFrame, selection: DataFrame) -> DataFrame:
    """Selections ``image_id, new_id, group_id`` with at least two groups, all of them present."""
    wanted = selection.dropDuplicates(["image_id", "new_id", "group_id"])
    known = groups.select("image_id", "group_id", F.lit(True).alias("known"))
    state = wanted.join(known, ["image_id", "group_id"], "left").groupBy("image_id", "new_id").agg(
        (F.count("*") >= 2).alias("enough"), (F.count("*") == F.count("known")).alias("complete")
    )
    return wanted.join(state.where("enough and complete"), ["image_id", "new_id"], "left_semi")


def merge_edges(groups: DataFrame, selection: DataFrame) -> DataFrame:
    """Edge table parent -> child of every accepted merge, kept to undo it later."""
    return valid_merges(groups, selection).select(
        "image_id", F.col("new_id").alias("parent_group_id"), F.col("group_id").alias("child_group_id")
    )


def merge_groups(groups: DataFrame, selection: DataFrame) -> DataFrame:
    """Replace each accepted selection by one group; other groups stay as they are."""
    accepted = valid_merges(groups, selection)
    rows = sort_groups(groups).join(accepted, ["image_id", "group_id"])
    c = parse_hex(F.col("color_hex"))
    weight = F.sum("pixel_count")

    def mean(channel: str) -> Column:
        value = F.bround(F.sum(c[channel] * F.col("pixel_count")) / weight, 0).cast("int")
        return F.when(weight > 0, value).otherwise(0)

    part = F.array_sort(F.collect_list(F.struct("position", "name", "raw_group_ids")))
    chosen = F.max(F.nullif(trimmed(F.col("new_name")), F.lit(""))) if "new_name" in rows.columns else F.lit(None).cast("string")
    merged = rows.groupBy("image_id", "new_id").agg(
        weight.alias("pixel_count"), F.sum("area_percent").alias("area_percent"),
        F.bool_or("has_partial_alpha").alias("has_partial_alpha"), F.bool_and("is_excluded").alias("is_excluded"),
        encode_hex(mean("b"), mean("g"), mean("r")).alias("color_hex"),
        part.alias("parts"), chosen.alias("chosen"),
    ).select(
        "image_id", F.col("new_id").alias("group_id"),
        F.coalesce("chosen", F.array_join(F.col("parts.name"), " + ")).alias("name"),
        "color_hex", "pixel_count", "area_percent", "has_partial_alpha", "is_excluded",
        F.flatten(F.col("parts.raw_group_ids")).alias("raw_group_ids"),
    )
    untouched = groups.join(accepted, ["image_id", "group_id"], "left_anti")
    return untouched.select(merged.columns).unionByName(merged)


def unmerge_groups(groups: DataFrame, children: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Put the recorded parts back in place of merged groups; groups that were never merged stay."""
    undone = edges.join(
        ids.select("image_id", F.col("group_id").alias("parent_group_id")), ["image_id", "parent_group_id"], "left_semi"
    )
    parents = undone.select("image_id", F.col("parent_group_id").alias("group_id")).distinct()
    back = undone.select("image_id", F.col("child_group_id").alias("group_id"))
    kept = groups.join(parents, ["image_id", "group_id"], "left_anti")
    return kept.unionByName(children.join(back, ["image_id", "group_id"], "left_semi").select(kept.columns))


def not_merged(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Undo requests for groups that are no merge (a conflict in the catalogue)."""
    parents = edges.select("image_id", F.col("parent_group_id").alias("group_id"))
    return ids.join(parents, ["image_id", "group_id"], "left_anti")


def quantized_preview(px: DataFrame, labels: DataFrame, groups: DataFrame) -> DataFrame:
    """Each pixel in the colour of its group; pixels without a group fully transparent."""
    paint = groups.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("group_no", parse_hex(F.col("color_hex")).alias("c")))).alias("paint"))
    seen = px.select("image_id", "y", "x").join(labels, ["image_id", "y", "x"], "left")
    every = px.select("image_id").distinct().join(paint, "image_id", "left")
    painted = per_image(seen, every, ["y", "x"]).withColumn("c", F.try_element_at("paint", F.col("group_no")))
    return painted.select(
        "image_id", "y", "x", *[F.coalesce(F.col(f"c.{k}"), F.lit(0)).alias(k) for k in "bgr"],
        F.when(F.col("c").isNull(), 0).otherwise(255).alias("a"),
    )


def nearest_color(points: DataFrame, palette_lab: DataFrame) -> DataFrame:
    """Closest palette colour of each point (first on ties), palettes being at most ``budget`` rows per image."""
    axes = ("lab_l", "lab_a", "lab_b")
    colours = palette_lab.groupBy("image_id").agg(F.collect_list(F.struct("group_no", *axes)).alias("palette"))

    def gap(q: Column) -> Column:
        return F.sqrt(sum(((F.col(f) - q[f]) * (F.col(f) - q[f]) for f in axes), F.lit(0.0)))

    nearest = F.array_min(F.transform("palette", lambda q: F.struct(gap(q).alias("distance"), q["group_no"].alias("group_no"))))
    best = per_image(points, colours, ["point_id"]).withColumn("best", nearest)
    return best.select("image_id", "point_id", "best.group_no", "best.distance")
