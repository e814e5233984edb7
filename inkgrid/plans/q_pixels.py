"""Pixel queries: projections, stencils, per-image statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkgrid.functions import colour
from inkgrid.operators import pixels
from inkgrid.plans import views
from inkgrid.plans.registry import query
from inkgrid.plans.views import ctes
from inkgrid.session import run_dir
from inkgrid.sources import files

LUMA = "cast(floor((4899*r+9617*g+1868*b+8192)/16384.0) as int)"


def _pixel_bytes(spark, d):
    """Images as the image source yields them, packed from the pixel view.

    An embedding always holds the 64 cells of one image.
    """
    cell = F.struct("y", "x", F.concat(*[F.unhex(F.lpad(F.hex(c), 2, "0")) for c in "bgra"]).alias("bytes"))
    rows = F.array_sort(F.collect_list(cell))
    return views.px(spark, d).groupBy("image_id").agg(rows.alias("cells")).select(
        "image_id", F.lit(8).alias("width"), F.lit(8).alias("height"), F.lit(4).alias("n_channels"),
        F.unhex(F.array_join(F.transform("cells", lambda c: F.hex(c["bytes"])), "")).alias("data"),
    )


@query("explode_pixels", ctes("px") + "select image_id, y, x, b, g, r, a from px")
def explode_pixels(spark, d):
    return pixels.explode_pixels(_pixel_bytes(spark, d))


@query("grayscale", ctes("px") + f"""select image_id, y, x, {LUMA} as b, {LUMA} as g, {LUMA} as r, a from px""")
def grayscale(spark, d):
    return pixels.grayscale(views.px(spark, d))


def _cb(c):
    return f"cast(floor(least(greatest(round({c}*1.3+(-20.0),9),0.0),255.0)) as int) as {c}"


@query("contrast_brightness", ctes("px") + f"select image_id, y, x, {_cb('b')}, {_cb('g')}, {_cb('r')}, a from px")
def contrast_brightness(spark, d):
    return pixels.contrast_brightness(views.px(spark, d), 1.3, -20)


def _blur_sql(source: str, strength: int) -> str:
    """Two explode-and-sum passes with reflected coordinates."""
    weights = ", ".join(repr(w) for w in pixels.gaussian_kernel(strength))

    def reflect(p):
        return f"case when (({p})%14+14)%14 < 8 then (({p})%14+14)%14 else 14-(({p})%14+14)%14 end"

    def final(c):
        return f"cast(least(greatest(floor(round(sum({c}*w),6)+0.5),0),255) as int) as {c}"

    return f"""
, kern as (select cast(unnest([{weights}]) as double) as w, unnest(range({-strength},{strength + 1})) as k)
, taps as (select p as pos, k, w, {reflect('p+k')} as src from (select unnest(range(0,8)) as p) cross join kern)
, pass1 as (select s.image_id, s.y, t.pos as x, sum(s.b*t.w) as b, sum(s.g*t.w) as g, sum(s.r*t.w) as r
  from {source} s join taps t on t.src = s.x group by 1,2,3)
, pass2 as (select s.image_id, cast(t.pos as int) as y, cast(s.x as int) as x, {final('b')}, {final('g')}, {final('r')}
  from pass1 s join taps t on t.src = s.y group by 1,2,3)
"""


def _png(px):
    """PNG files of 8 x 8 images with alpha, as bytes: stored deflate blocks, checksums by formula."""
    two = lambda v: F.lpad(F.hex(v), 2, "0")
    pixels_ = F.sort_array(F.collect_list(F.struct("y", "x", F.concat(F.when(F.col("x") == 0, "00").otherwise(""), two("r"), two("g"), two("b"), two("a")).alias("h"))))
    raw = px.groupBy("image_id").agg(F.array_join(F.transform(pixels_, lambda p: p["h"]), "").alias("raw"))
    values = F.transform(F.sequence(F.lit(0), F.lit(263)), lambda i: F.conv(F.substring(F.col("raw"), (i * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("long"))
    sums = F.aggregate(values, F.struct(F.lit(1).cast("long").alias("a"), F.lit(0).cast("long").alias("b")),
                       lambda s, v: F.struct(((s["a"] + v) % 65521).alias("a"), ((s["b"] + s["a"] + v) % 65521).alias("b")))
    adler = F.concat(F.lpad(F.hex(sums["b"]), 4, "0"), F.lpad(F.hex(sums["a"]), 4, "0"))
    body = F.concat(F.lit("7801010801F7FE"), F.col("raw"), adler)  # one stored block of 264 bytes

    def chunk(kind, data):
        whole = F.concat(F.lit(kind), data)
        return F.concat(F.lpad(F.hex((F.length(data) / 2).cast("int")), 8, "0"), whole, F.lpad(F.hex(F.crc32(F.unhex(whole))), 8, "0"))

    head = F.lit("00000008000000080806000000")
    return raw.select("image_id", F.unhex(F.concat(F.lit("89504E470D0A1A0A"), chunk("49484452", head), chunk("49444154", body), chunk("49454E44", F.lit("")))).alias("content"))


@query("load_images", ctes("px") + "select y, x, b, g, r, a, count(*) as n from px group by 1,2,3,4,5,6")
def load_images(spark, d):
    """Images written as one PNG file each, decoded again, and counted by pixel."""
    folder = run_dir(spark, "images")
    files.write_files(spark, _png(views.px(spark, d)).select(F.col("image_id").cast("string").alias("name"), "content"), folder)
    good, _ = files.load_images(spark, folder)
    shown = pixels.explode_pixels(good)
    return shown.groupBy("y", "x", "b", "g", "r", "a").agg(F.count("*").alias("n"))


_GUARDED = ctes("px") + """, files as (select distinct image_id, case image_id % 4 when 1 then 'dimensions_exceeded' when 2 then 'corrupt_image' end as reason from px)
select f.reason, count(distinct f.image_id) as files, case when f.reason is null then sum(p.r + p.g + p.b) end as channel_sum
  from files f left join px p on p.image_id = f.image_id group by f.reason"""


@query("guarded_images", _GUARDED)
def guarded_images(spark, d):
    """One kind of files names 30 000 x 30 000 pixels in its header, another ends early; what is left is decoded and summed."""
    folder = run_dir(spark, "guarded")
    body, kind = F.col("content"), F.col("image_id") % 4
    side = F.unhex(F.lit("0000753000007530"))
    wide = F.concat(F.substring(body, 1, 16), side, F.expr("substring(content, 25)"))
    bytes_ = F.when(kind == 1, wide).when(kind == 2, F.substring(body, 1, 40)).otherwise(body)
    files.write_files(spark, _png(views.px(spark, d)).select(F.col("image_id").cast("string").alias("name"), bytes_.alias("content")), folder)
    good, bad = files.load_images(spark, folder)
    sums = pixels.explode_pixels(good).groupBy("image_id").agg(F.sum(F.col("r") + F.col("g") + F.col("b")).alias("s"))
    fine = sums.agg(F.lit(None).cast("string").alias("reason"), F.count("*").alias("files"), F.sum("s").alias("channel_sum"))
    return fine.unionByName(bad.groupBy("reason").agg(F.count("*").alias("files")).withColumn("channel_sum", F.lit(None).cast("long")))


@query("denoise", ctes("px") + _blur_sql("px", 2) + "select pass2.*, px.a from pass2 join px using (image_id, y, x)")
def denoise(spark, d):
    return pixels.denoise(views.px(spark, d), views.canvas(spark, d), 2)


_PRE = ctes("px") + f""", grey as (select image_id, y, x, {LUMA} as l, a from px)
, adj as (select image_id, y, x, a, cast(floor(least(greatest(round(l*1.2+10.0,9),0.0),255.0)) as int) as b from grey)
, adj3 as (select image_id, y, x, a, b, b as g, b as r from adj)"""


@query("preprocess", _PRE + _blur_sql("adj3", 1)
       + f""", res as (select image_id, {LUMA} as l from pass2)
select image_id, round(avg(l),6) as mean_brightness, round(stddev_pop(l),6) as std_dev,
  min(l) as min_value, max(l) as max_value from res group by image_id""")
def preprocess(spark, d):
    done = pixels.preprocess(views.px(spark, d), views.canvas(spark, d), True, 1.2, 10, 1)
    return _rounded_metrics(done)


def _rounded_metrics(px):
    return pixels.image_metrics(px).select(
        "image_id", F.round("mean_brightness", 6).alias("mean_brightness"),
        F.round("std_dev", 6).alias("std_dev"), "min_value", "max_value",
    )


@query("image_metrics", ctes("px") + f"""select image_id, round(avg(l),6) as mean_brightness,
  round(stddev_pop(l),6) as std_dev, min(l) as min_value, max(l) as max_value
  from (select image_id, {LUMA} as l from px) group by image_id""")
def image_metrics(spark, d):
    return _rounded_metrics(views.px(spark, d))


_MASK = ctes("px") + f", mask as (select image_id, y, x, a, case when {LUMA} > 128 then 255 else 0 end as v from px)"


@query("threshold", _MASK + "select image_id, y, x, v, a from mask")
def threshold(spark, d):
    return pixels.threshold(views.px(spark, d), 128)


@query("threshold_inverted", ctes("px") + f"""select image_id, y, x, a,
  case when {LUMA} <= 90 then 255 else 0 end as v from px""")
def threshold_inverted(spark, d):
    return pixels.threshold(views.px(spark, d), 90, invert=True)


@query("alpha_background", _MASK + "select image_id, y, x, a, case when a <= 0 then 0 else v end as v from mask")
def alpha_background(spark, d):
    return pixels.alpha_background(pixels.threshold(views.px(spark, d), 128))


@query("rebinarize", ctes("px") + """select image_id, y, x, a,
  case when cast(floor((4899*r+9617*g+1868*b+8192)/16384.0) as int) > 127 then 255 else 0 end as v from px""")
def rebinarize(spark, d):
    grey = pixels.grayscale(views.px(spark, d)).select("image_id", "y", "x", F.col("g").alias("v"), "a")
    return pixels.rebinarize(grey)


_METRICS = _MASK + """, cleared as (select image_id, case when a <= 0 then 0 else v end as v from mask)
, metrics as (select image_id, round(count(*) filter (where v=255) / count(*) * 100.0, 6) as foreground_percent,
  round(100.0 - count(*) filter (where v=255) / count(*) * 100.0, 6) as background_percent
  from cleared group by image_id)"""


def _metrics(spark, d):
    mask = pixels.alpha_background(pixels.threshold(views.px(spark, d), 128))
    found = pixels.threshold_metrics(mask)
    return found.select("image_id", *[F.round(c, 6).alias(c) for c in ("foreground_percent", "background_percent")])


@query("threshold_metrics", _METRICS + "select * from metrics")
def threshold_metrics(spark, d):
    return _metrics(spark, d)


@query("mask_warnings", _METRICS + """select *, case when foreground_percent <= 20 then 'near_empty'
  when foreground_percent >= 80 then 'near_full' end as warning from metrics""")
def mask_warnings(spark, d):
    return pixels.mask_warnings(_metrics(spark, d), empty_at=20.0, full_at=80.0)


def _lin(c):
    return f"case when {c}/255.0 > 0.04045 then pow(({c}/255.0+0.055)/1.055, 2.4) else {c}/255.0/12.92 end"


def _root(t):
    return f"case when {t} > 0.008856 then pow({t}, 1.0/3.0) else {t}*7.787+16.0/116.0 end"


def _byte(e):
    return f"cast(least(greatest(round(round({e},6),0),0.0),255.0) as int)"


def lab_sql(source: str) -> str:
    """CTEs ending in ``lab``: the rows of ``source`` with lab_l, lab_a, lab_b."""
    return f"""
, lin as (select *, {_lin('cast(r as double)')} as rl, {_lin('cast(g as double)')} as gl, {_lin('cast(b as double)')} as bl from {source})
, xyz as (select *, (rl*0.412453+gl*0.357580+bl*0.180423)/0.950456 as cx, rl*0.212671+gl*0.715160+bl*0.072169 as cy,
  (rl*0.019334+gl*0.119193+bl*0.950227)/1.088754 as cz from lin)
, roots as (select *, {_root('cx')} as fx, {_root('cy')} as fy, {_root('cz')} as fz from xyz)
, lab as (select * exclude (rl,gl,bl,cx,cy,cz,fx,fy,fz),
  {_byte('(case when cy > 0.008856 then 116.0*fy-16.0 else cy*903.3 end)*255.0/100.0')} as lab_l,
  {_byte('(fx-fy)*500.0+128.0')} as lab_a, {_byte('(fy-fz)*200.0+128.0')} as lab_b from roots)
"""


@query("bgr_to_lab", ctes("px") + lab_sql("px") + "select * from lab")
def bgr_to_lab(spark, d):
    return pixels.to_lab(views.px(spark, d))


@query("lab_distance", ctes("px") + lab_sql("px") + """select image_id, y, x,
  round(sqrt((lab_l-128)*(lab_l-128)+(lab_a-120)*(lab_a-120)+(lab_b-140)*(lab_b-140)), 6) as distance from lab""")
def lab_distance(spark, d):
    target = F.struct(F.lit(128).alias("lab_l"), F.lit(120).alias("lab_a"), F.lit(140).alias("lab_b"))
    mine = colour.bgr_to_lab(F.col("b"), F.col("g"), F.col("r"))
    return views.px(spark, d).select(
        "image_id", "y", "x", F.round(colour.lab_distance(mine, target), 6).alias("distance")
    )


@query("posterize", ctes("px") + """select image_id, y, x, cast(floor(b/32)*32 as int) as b,
  cast(floor(g/32)*32 as int) as g, cast(floor(r/32)*32 as int) as r, a from px""")
def posterize(spark, d):
    return pixels.posterize(views.px(spark, d), 32)


@query("encode_hex", ctes("px") + "select image_id, y, x, printf('#%02x%02x%02x', r, g, b) as color_hex from px")
def encode_hex(spark, d):
    return views.px(spark, d).select(
        "image_id", "y", "x", colour.encode_hex(F.col("b"), F.col("g"), F.col("r")).alias("color_hex")
    )


@query("parse_hex", ctes("colour_groups") + "select image_id, group_id, b, g, r from colour_groups")
def parse_hex(spark, d):
    return views.colour_groups(spark, d).select(
        "image_id", "group_id", colour.parse_hex(F.col("color_hex")).alias("c")
    ).select("image_id", "group_id", "c.*")


@query("round_half_even", """select o_orderkey, cast(round_even(o_orderkey/2.0, 0) as bigint) as half
  from orders""")
def round_half_even(spark, d):
    return views.table(spark, d, "orders").select(
        "o_orderkey", colour.round_half_even(F.col("o_orderkey") / 2.0).cast("long").alias("half")
    )
