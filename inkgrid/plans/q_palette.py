"""Palette and mask queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkgrid.functions.colour import bgr_to_lab
from inkgrid.operators import masks, palette
from inkgrid.plans import views
from inkgrid.plans.q_pixels import lab_sql
from inkgrid.plans.registry import query
from inkgrid.plans.views import ctes

STEPS = ", ".join(
    f"count(distinct floor(b/{s})*65536+floor(g/{s})*256+floor(r/{s})) as n{s}" for s in (1, 2, 4, 8, 16, 32, 64)
)


def _unique_sql(source: str, budget: int) -> str:
    pick = " ".join(f"when n{s} <= {budget} then {s}" for s in (1, 2, 4, 8, 16, 32, 64))
    return f"""
, counts as (select image_id, {STEPS} from {source} where a > 0 group by image_id)
, steps as (select image_id, case {pick} else 128 end as step from counts)
, colours as (select image_id, step, cast(floor(b/step)*step as int) as b, cast(floor(g/step)*step as int) as g,
  cast(floor(r/step)*step as int) as r, count(*) as pixel_count, bool_or(a < 255) as has_partial_alpha
  from {source} join steps using (image_id) where a > 0 group by 1,2,3,4,5)
"""


@query("unique_colors", ctes("px_mosaic") + _unique_sql("px_mosaic", 512) + "select * from colours")
def unique_colors(spark, d):
    return palette.unique_colors(views.px_mosaic(spark, d))


# With tolerance 0 a group is one Lab value; groups rank by size, then by the first colour taken.
_GROUPS = """
, taken as (select *, row_number() over (partition by image_id order by pixel_count desc, b, g, r) as pos from lab)
, sized as (select *, sum(pixel_count) over (partition by image_id, lab_l, lab_a, lab_b) as size,
  min(pos) over (partition by image_id, lab_l, lab_a, lab_b) as first_pos from taken)
, ranked as (select *, dense_rank() over (partition by image_id order by size desc, first_pos) - 1 as group_no from sized)
"""
_CLUSTERS = ctes("px") + _unique_sql("px", 512) + lab_sql("colours") + _GROUPS
_TOTALS = """, totals as (select image_id, count(*) as total,
  count(*) filter (where a = 0) / count(*) * 100.0 as transparent_percent from px group by image_id)
"""


def _mean(c):
    return f"cast(round_even(sum({c}*pixel_count)/sum(pixel_count), 0) as int)"


def _exact_clusters(spark, d):
    return palette.cluster_colors(palette.unique_colors(views.px(spark, d)), tolerance=0.0)


@query("cluster_colors", _CLUSTERS + """select image_id, step, b, g, r, pixel_count, has_partial_alpha,
  cast(group_no as int) as group_no from ranked""")
def cluster_colors(spark, d):
    return _exact_clusters(spark, d)


@query("palette", _CLUSTERS + _TOTALS + f"""select image_id, cast(group_no as int) as group_no,
  printf('#%02x%02x%02x', {_mean('r')}, {_mean('g')}, {_mean('b')}) as color_hex,
  cast(sum(pixel_count) as bigint) as pixel_count, round(sum(pixel_count)/any_value(total)*100.0, 6) as area_percent,
  bool_or(has_partial_alpha) as has_partial_alpha, round(any_value(transparent_percent), 6) as transparent_percent, any_value(step) as step
  from ranked join totals using (image_id) group by image_id, group_no""")
def palette_exact(spark, d):
    return _rounded(palette.palette(views.px(spark, d), tolerance=0.0, tiny_ratio=0.0))


def _rounded(groups):
    return groups.withColumns({c: F.round(c, 6) for c in ("area_percent", "transparent_percent")})


@query("palette_default")
def palette_default(spark, d):
    return _rounded(palette.palette(views.px_mosaic(spark, d)))


@query("merge_tiny_groups", ctes("px") + _unique_sql("px", 512) + """select image_id, cast(0 as int) as group_no,
  cast(sum(pixel_count) as bigint) as pixel_count, count(*) as colours from colours group by image_id""")
def merge_tiny_groups(spark, d):
    """Every group is tiny against twice the visible area, so exactly one remains; other ratios are tested against the plain way."""
    found = palette.cluster_colors(palette.unique_colors(views.px(spark, d)), 12.0, None, tiny_ratio=2.0)
    return found.groupBy("image_id", "group_no").agg(
        F.sum("pixel_count").alias("pixel_count"), F.count("*").alias("colours")
    )


@query("merge_to_max_colors", ctes("px") + _unique_sql("px", 512) + """select image_id, count(*) as colours,
  cast(least(count(*), 6) as bigint) as groups, cast(sum(pixel_count) as bigint) as pixel_count
  from (select * from colours) group by image_id""")
def merge_to_max_colors(spark, d):
    """At tolerance 0 every image here has at least six Lab values, which are folded to six groups."""
    found = palette.cluster_colors(palette.unique_colors(views.px(spark, d)), 0.0, max_colors=6)
    return found.groupBy("image_id").agg(
        F.count("*").alias("colours"), F.countDistinct("group_no").alias("groups"),
        F.sum("pixel_count").alias("pixel_count"),
    )


_LABELS = _CLUSTERS + """, labels as (
  select p.image_id, p.y, p.x, cast(coalesce(c.group_no, -1) as int) as group_no from px p
  left join ranked c on p.a > 0 and c.image_id = p.image_id
    and c.b = floor(p.b/c.step)*c.step and c.g = floor(p.g/c.step)*c.step and c.r = floor(p.r/c.step)*c.step)
"""


@query("label_pixels", _LABELS + "select * from labels")
def label_pixels(spark, d):
    return palette.label_pixels(views.px(spark, d), _exact_clusters(spark, d))


_FLAT = ctes("px_flat") + """, labels as (
  select image_id, y, x, case when a > 0 then cast(floor(g/64) as int) else -1 end as group_no from px_flat)
, border as (select image_id, group_no, round(count(*) filter (where x in (0,7) or y in (0,7)) / 28.0, 6) as border_ratio,
  count(*) filter (where x in (0,7) or y in (0,7)) / 28.0 >= 0.5 as touches_border
  from labels where group_no >= 0 group by 1,2)
"""


def _flat_labels(spark, d):
    return views.px_flat(spark, d).select(
        "image_id", "y", "x", F.when(F.col("a") > 0, F.floor(F.col("g") / 64)).otherwise(-1).cast("int").alias("group_no")
    )


def _border(spark, d):
    found = palette.border_touch(_flat_labels(spark, d), views.canvas(spark, d))
    return found.withColumn("border_ratio", F.round("border_ratio", 6))


@query("border_touch", _FLAT + "select * from border")
def border_touch(spark, d):
    return _border(spark, d)


@query("default_exclusion", _FLAT + """, named as (select *, row_number() over (partition by image_id order by group_no) as n
  from border) select image_id, group_no, border_ratio, touches_border, concat('Color ', n) as name,
  n = 1 and touches_border as is_excluded from named""")
def default_exclusion(spark, d):
    return palette.name_groups(_border(spark, d))


@query("quantized_preview", ctes("colour_groups") + """select p.image_id, p.y, p.x, coalesce(c.b,0) as b,
  coalesce(c.g,0) as g, coalesce(c.r,0) as r, case when c.b is null then 0 else 255 end as a
  from px_flat p left join colour_groups c on p.a > 0 and c.image_id = p.image_id
    and c.group_no = cast(floor(p.g/64) as int)""")
def quantized_preview(spark, d):
    return palette.quantized_preview(views.px_flat(spark, d), _flat_labels(spark, d), views.colour_groups(spark, d))


@query("sort_groups", ctes("colour_groups") + """select image_id, group_id, name, area_percent,
  cast(row_number() over (partition by image_id order by area_percent desc, name, group_id) as int) as position
  from colour_groups""")
def sort_groups(spark, d):
    return palette.sort_groups(views.colour_groups(spark, d)).select(
        "image_id", "group_id", "name", "area_percent", "position"
    )


def _selection(spark, d):
    """Merge the two darkest groups of every image (rejected where one is missing)."""
    return views.table(spark, d, "embeddings").select(
        F.col("vec_id").alias("image_id"), F.lit("m0").alias("new_id"), F.explode(F.array(F.lit("g1"), F.lit("g2"))).alias("group_id")
    )


_MERGE = ctes("colour_groups") + """
, sel as (select image_id from colour_groups where group_id in ('g1','g2') group by 1 having count(*) = 2)
, parts as (select c.*, row_number() over (partition by image_id order by area_percent desc, name, group_id) as position
  from colour_groups c where group_id in ('g1','g2') and image_id in (select image_id from sel))
, merged as (select image_id, 'm0' as group_id, string_agg(name, ' + ' order by position) as name,
  printf('#%02x%02x%02x', cast(round_even(sum(r*pixel_count)/sum(pixel_count),0) as int),
    cast(round_even(sum(g*pixel_count)/sum(pixel_count),0) as int),
    cast(round_even(sum(b*pixel_count)/sum(pixel_count),0) as int)) as color_hex,
  cast(sum(pixel_count) as bigint) as pixel_count, round(sum(area_percent),6) as area_percent,
  bool_or(has_partial_alpha) as has_partial_alpha, bool_and(is_excluded) as is_excluded,
  string_agg(cast(group_no as varchar), ',' order by position) as raw_group_ids from parts group by image_id)
"""
_PLAIN = """select image_id, group_id, name, color_hex, pixel_count, round(area_percent,6) as area_percent,
  has_partial_alpha, is_excluded, cast(group_no as varchar) as raw_group_ids from colour_groups"""


def _flat_row(groups):
    return groups.select(
        "image_id", "group_id", "name", "color_hex", "pixel_count", F.round("area_percent", 6).alias("area_percent"),
        "has_partial_alpha", "is_excluded",
        F.array_join(F.transform("raw_group_ids", lambda v: v.cast("string")), ",").alias("raw_group_ids"),
    )


@query("merge_groups", _MERGE + "select * from merged union all " + _PLAIN
       + " where not (group_id in ('g1','g2') and image_id in (select image_id from sel))")
def merge_groups(spark, d):
    return _flat_row(palette.merge_groups(views.colour_groups(spark, d), _selection(spark, d)))


@query("flatten_raw_ids", _MERGE + "select image_id, raw_group_ids from merged")
def flatten_raw_ids(spark, d):
    merged = _flat_row(palette.merge_groups(views.colour_groups(spark, d), _selection(spark, d)))
    return merged.where("group_id = 'm0'").select("image_id", "raw_group_ids")


@query("unmerge_groups", ctes("colour_groups") + _PLAIN)
def unmerge_groups(spark, d):
    """Merging and undoing the merge gives the groups of before."""
    groups, chosen = views.colour_groups(spark, d), _selection(spark, d)
    edges = palette.merge_edges(groups, chosen)
    ids = chosen.select("image_id", F.col("new_id").alias("group_id")).distinct()
    return _flat_row(palette.unmerge_groups(palette.merge_groups(groups, chosen), groups, edges, ids))


@query("nearest_color", ctes("px", "colour_groups") + lab_sql("px")
       + ", points as (select image_id, y*8+x as point_id, lab_l, lab_a, lab_b from lab)"
       + lab_sql("colour_groups").replace("lin as", "lin2 as").replace("xyz as", "xyz2 as").replace("roots as", "roots2 as")
       .replace("lab as", "pal as").replace("from lin)", "from lin2)").replace("from xyz)", "from xyz2)").replace("from roots)", "from roots2)")
       + """, gaps as (select p.image_id, p.point_id, q.group_no, sqrt(pow(p.lab_l-q.lab_l,2)+pow(p.lab_a-q.lab_a,2)
  +pow(p.lab_b-q.lab_b,2)) as distance from points p join pal q using (image_id))
select image_id, point_id, group_no, round(distance,6) as distance from (select *, row_number() over (
  partition by image_id, point_id order by distance, group_no) as n from gaps) where n = 1""")
def nearest_color(spark, d):
    lab = bgr_to_lab(F.col("b"), F.col("g"), F.col("r"))
    points = views.px(spark, d).select("image_id", (F.col("y") * 8 + F.col("x")).alias("point_id"), lab.alias("lab"))
    groups = views.colour_groups(spark, d).select(
        "image_id", "group_no", F.expr("conv(substring(color_hex,6,2),16,10)").cast("int").alias("b"),
        F.expr("conv(substring(color_hex,4,2),16,10)").cast("int").alias("g"),
        F.expr("conv(substring(color_hex,2,2),16,10)").cast("int").alias("r"),
    ).select("image_id", "group_no", lab.alias("lab"))
    found = palette.nearest_color(
        points.select("image_id", "point_id", "lab.*"), groups.select("image_id", "group_no", "lab.*")
    )
    return found.withColumn("distance", F.round("distance", 6))


# ---------------------------------------------------------------------- masks

@query("empty_mask_filter", ctes("mask_pixels", "masks") + """select image_id, mask_id, 'empty_mask' as reason from masks
  where not exists (select 1 from mask_pixels p where p.image_id = masks.image_id and p.mask_id = masks.mask_id)""")
def empty_mask_filter(spark, d):
    return masks.empty_masks(views.mask_pixels(spark, d), views.masks(spark, d))


@query("union_masks", ctes("mask_pixels") + """select distinct image_id, cast(floor(mask_id/2) as int) as mask_id, y, x
  from mask_pixels""")
def union_masks(spark, d):
    pairs = views.masks(spark, d).withColumn("new_id", F.floor(F.col("mask_id") / 2).cast("int"))
    return masks.union_masks(views.mask_pixels(spark, d), pairs)


def _shifted(spark, d):
    """The masks moved one pixel to the right, inside the canvas."""
    return views.mask_pixels(spark, d).withColumn("x", F.col("x") + 1).where("x < 8")


_REC = ctes("mask_pixels") + ", rec as (select image_id, mask_id, y, x+1 as x from mask_pixels where x < 7)\n"


@query("intersect_masks", _REC + """select image_id, mask_id, y, x from rec
  intersect select image_id, mask_id, y, x from mask_pixels""")
def intersect_masks(spark, d):
    return masks.intersect_masks(_shifted(spark, d), views.mask_pixels(spark, d))


@query("xor_masks", _REC + """, a as (select image_id, mask_id, y, x from rec)
, b as (select image_id, mask_id, y, x from mask_pixels)
(select * from a except select * from b) union all (select * from b except select * from a)""")
def xor_masks(spark, d):
    return masks.xor_masks(_shifted(spark, d), views.mask_pixels(spark, d))


_FIDELITY = _REC + """, cells as (select coalesce(r.image_id,m.image_id) as image_id, coalesce(r.mask_id,m.mask_id) as mask_id,
  r.x is not null as in_rec, m.x is not null as in_own from rec r full join mask_pixels m using (image_id, mask_id, y, x))
, fid as (select image_id, mask_id, count(*) filter (where in_own) as own_pixels,
  count(*) filter (where in_rec) as reconstructed_pixels,
  count(*) filter (where in_own <> in_rec) / greatest(count(*) filter (where in_own), 1) as ratio
  from cells group by 1,2)
, con as (select r.image_id, r.mask_id, count(*) filter (where exists (select 1 from mask_pixels m
    where m.image_id=r.image_id and m.y=r.y and m.x=r.x and m.mask_id<>r.mask_id)) / count(*) as ratio
  from rec r group by 1,2)
"""


@query("layer_fidelity", _FIDELITY + """select image_id, mask_id, own_pixels, reconstructed_pixels,
  round(ratio,6) as own_mismatch_ratio, ratio <= 0.15 as own_mismatch_within_tolerance from fid""")
def layer_fidelity(spark, d):
    found = masks.layer_fidelity(_shifted(spark, d), views.mask_pixels(spark, d))
    return found.withColumn("own_mismatch_ratio", F.round("own_mismatch_ratio", 6))


@query("layer_contamination", _FIDELITY + """select image_id, mask_id, round(ratio,6) as contamination_ratio,
  ratio <= 0.01 as contamination_within_tolerance from con""")
def layer_contamination(spark, d):
    found = masks.layer_contamination(_shifted(spark, d), views.mask_pixels(spark, d))
    return found.withColumn("contamination_ratio", F.round("contamination_ratio", 6))


@query("layer_warnings", _FIDELITY + """select image_id, mask_id, round(f.ratio,6) as own_mismatch_ratio,
  round(coalesce(c.ratio,0.0),6) as contamination_ratio,
  concat_ws(',', case when f.ratio > 0.15 then 'own_mismatch' end, case when c.ratio > 0.01 then 'contamination' end) as warnings
  from fid f left join con c using (image_id, mask_id)""")
def layer_warnings(spark, d):
    shifted, own = _shifted(spark, d), views.mask_pixels(spark, d)
    found = masks.layer_warnings(masks.layer_fidelity(shifted, own), masks.layer_contamination(shifted, own))
    return found.withColumns({c: F.round(c, 6) for c in ("own_mismatch_ratio", "contamination_ratio")})
