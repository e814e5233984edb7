"""Input views derived from the driver tables.

Every view exists twice: as a DataFrame for Spark and as a CTE text for DuckDB.
``ctes("px", "px_flat")`` strings the texts together in dependency order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --------------------------------------------------------------------- pixels

def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.posexplode("embedding").alias("i", "v")
    )
    level = F.floor(F.col("v").cast("double") * 200) + 128
    return cells.select(
        "vec_id", "label", "i", F.greatest(F.lit(0), F.least(F.lit(255), level)).cast("int").alias("g")
    )


def _channels() -> list:
    i, g = F.col("i"), F.col("g")
    return [
        ((g * 7 + i) % 256).cast("int").alias("b"),
        g,
        ((g * 3 + F.col("label") * 20) % 256).cast("int").alias("r"),
        F.when(i % 16 == 0, 0).when(i % 16 == 1, 128).otherwise(255).cast("int").alias("a"),
    ]


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8x8 BGRA images, one per embedding."""
    i = F.col("i")
    return _cells(spark, sf_dir).select(
        F.col("vec_id").alias("image_id"),
        F.floor(i / 8).cast("int").alias("y"),
        (i % 8).cast("int").alias("x"),
        *_channels(),
    )


def px_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same images in steps of 64 per channel."""
    flat = [(F.floor(F.col(c) / 64) * 64).cast("int").alias(c) for c in "bgr"]
    return px(spark, sf_dir).select("image_id", "y", "x", *flat, "a")


def px_mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 small images packed into one 80x80 canvas."""
    v, i = F.col("vec_id"), F.col("i")
    return _cells(spark, sf_dir).select(
        F.floor(v / 100).alias("image_id"),
        (F.floor((v % 100) / 10) * 8 + F.floor(i / 8)).cast("int").alias("y"),
        ((v % 10) * 8 + i % 8).cast("int").alias("x"),
        *_channels(),
    )


def canvas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("image_id"), F.lit(8).alias("width"), F.lit(8).alias("height")
    )


def mask_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four masks per image: the green level of the opaque pixels."""
    return px_flat(spark, sf_dir).where("a > 0").select(
        "image_id", (F.col("g") / 64).cast("int").alias("mask_id"), "y", "x"
    )


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mask that was asked for, with or without foreground."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("image_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("mask_id")
    )


def colour_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Palette rows of every image: one group per green level."""
    pixels = px_flat(spark, sf_dir)
    return (
        pixels.where("a > 0")
        .groupBy("image_id", (F.col("g") / 64).cast("int").alias("group_no"))
        .agg(
            F.count("*").alias("pixel_count"),
            F.bround(F.avg("b")).cast("int").alias("b"),
            F.bround(F.avg("g")).cast("int").alias("g"),
            F.bround(F.avg("r")).cast("int").alias("r"),
            F.bool_or(F.col("a") < 255).alias("has_partial_alpha"),
        )
        .select(
            "image_id",
            "group_no",
            F.concat(F.lit("g"), F.col("group_no").cast("string")).alias("group_id"),
            F.concat(F.lit("Color "), (F.col("group_no") + 1).cast("string")).alias("name"),
            F.lower(F.concat(F.lit("#"), *[F.lpad(F.hex(c), 2, "0") for c in "rgb"])).alias("color_hex"),
            "pixel_count",
            (F.col("pixel_count") / 64.0 * 100.0).alias("area_percent"),
            "has_partial_alpha",
            (F.col("group_no") == 0).alias("is_excluded"),
            F.array(F.col("group_no")).alias("raw_group_ids"),
        )
    )


# ------------------------------------------------------------------- outlines

def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of 40 shapes: frames, holes, open outlines and copies."""
    k, size = F.col("k"), F.col("p_size")
    shapes = table(spark, sf_dir, "part").select(
        F.floor(F.col("p_partkey") / 40).alias("doc_id"),
        (F.col("p_partkey") % 40).cast("int").alias("k"),
        "p_brand",
        "p_type",
        "p_size",
        "p_partkey",
    ).select(
        "doc_id", "k", "p_brand", "p_type",
        ((F.col("p_partkey") % 8) * 60).cast("double").alias("x0"),
        (F.floor(k / 8) * 60).cast("double").alias("y0"),
        (size + 10).cast("double").alias("w"),
        ((size * 7) % 50 + 10).cast("double").alias("h"),
    )

    def ring(path, sub, closed, inset):
        return F.struct(
            path.cast("int").alias("path_index"),
            F.lit(sub).alias("subpath_index"),
            closed.alias("closed"),
            (F.col("x0") + inset).alias("x0"),
            (F.col("y0") + inset).alias("y0"),
            (F.col("x0") + F.col("w") - inset).alias("x1"),
            (F.col("y0") + F.col("h") - inset).alias("y1"),
        )

    is_open = F.col("p_brand") == "Brand#2"
    holed = F.col("p_type").isin("SMALL", "LARGE") & (F.col("w") > 20) & (F.col("h") > 20) & ~is_open
    outline = ring(k, 0, ~is_open, 0.0)
    hole = F.when(holed, ring(k, 1, F.lit(True), 5.0))
    copy = F.when(F.col("p_brand") == "Brand#1", ring(k + 40, 0, F.lit(True), 0.0))
    return (
        shapes.select("doc_id", F.explode(F.array_compact(F.array(outline, hole, copy))).alias("s"))
        .select("doc_id", "s.*")
    )


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    def corner(i, x, y):
        return F.struct(F.lit(i).alias("i"), x.alias("x"), y.alias("y"))

    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    base = [corner(0, x0, y0), corner(1, x1, y0), corner(2, x1, y1), corner(3, x0, y1)]
    tail = F.when(~F.col("closed"), corner(4, x0 + 0.3, y0 + 0.2))
    return (
        rings(spark, sf_dir)
        .select(
            "doc_id", "path_index", "subpath_index", "closed",
            F.explode(F.array_compact(F.array(*base, tail))).alias("p"),
        )
        .select("doc_id", "path_index", "subpath_index", "closed", "p.*")
    )


# ------------------------------------------------------------------ catalogue

def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, day = F.col("o_orderstatus"), F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("owner_id"),
        F.concat_ws(" ", "o_orderpriority", F.col("o_orderkey").cast("string")).alias("name"),
        day.alias("created_at"),
        F.when(status == "F", day + F.expr("interval 7 days")).otherwise(day).alias("updated_at"),
        F.when(status == "P", day + F.expr("interval 30 days")).alias("deleted_at"),
    )


def vector_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per computed artefact; arrival order is created_at, artifact_id, seq."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("project_id"),
        (F.col("l_partkey") % 5).alias("image_id"),
        (F.col("l_partkey") % 10).alias("source_id"),
        F.col("l_orderkey").alias("artifact_id"),
        F.col("l_shipdate").alias("created_at"),
        F.floor("l_quantity").cast("int").alias("path_count"),
        F.floor("l_extendedprice").alias("node_count"),
        F.col("l_linenumber").alias("seq"),
        F.concat(
            F.lit("v="), F.floor(F.col("l_discount") * 100 + 0.5).cast("int").cast("string"),
            F.lit("|inv="), F.col("l_linestatus"),
        ).alias("cache_key"),
    )


def edit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    return table(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        F.col("user_id").alias("layer_id"),
        F.when(kind == "purchase", "cut").when(kind == "click", "engrave").when(kind == "error", "ignore")
        .alias("operation"),
        F.when(kind == "view", F.col("value") > 10).alias("visible"),
        F.when(kind == "signup", F.concat(F.lit("L"), user)).alias("name"),
        F.when(F.col("value") < 1, "").otherwise(
            F.concat_ws("-", user, kind, F.floor("value").cast("int").cast("string"))
        ).alias("idempotency_key"),
    )


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers of document versions: version = order, group = part."""
    items = table(spark, sf_dir, "lineitem")
    return items.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"),
        F.col("l_orderkey").alias("version_id"),
        F.col("l_partkey").alias("group_id"),
        (F.col("l_partkey") % 64).alias("color_id"),
        F.concat(F.lit("Layer "), F.col("l_linenumber").cast("string")).alias("name"),
        (F.lit(8) - F.col("l_linenumber")).cast("int").alias("order"),
        F.when(F.col("l_returnflag") != "R", F.col("l_returnflag") == "A").alias("visible"),
        (F.col("l_linestatus") == "F").alias("locked"),
        F.when(F.col("l_returnflag") == "A", "cut")
        .when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O"), "engrave")
        .when(F.col("l_tax") < 0.02, "ignore")
        .alias("operation"),
        F.floor("l_quantity").cast("int").alias("path_count"),
    )


# ------------------------------------------------------------------- DuckDB

_CTES = {
    "px_cells": """px_cells as (
  select vec_id, label, i, cast(greatest(0, least(255, floor(cast(v as double)*200)+128)) as int) as g
  from (select vec_id, label, unnest(embedding) as v, generate_subscripts(embedding,1)-1 as i from embeddings))""",
    "px": """px as (
  select vec_id as image_id, cast(floor(i/8) as int) as y, cast(i%8 as int) as x,
    cast((g*7+i)%256 as int) as b, g, cast((g*3+label*20)%256 as int) as r,
    cast(case when i%16=0 then 0 when i%16=1 then 128 else 255 end as int) as a from px_cells)""",
    "px_flat": """px_flat as (
  select image_id, y, x, cast(floor(b/64)*64 as int) as b, cast(floor(g/64)*64 as int) as g,
    cast(floor(r/64)*64 as int) as r, a from px)""",
    "px_mosaic": """px_mosaic as (
  select cast(floor(vec_id/100) as bigint) as image_id,
    cast(floor((vec_id%100)/10)*8+floor(i/8) as int) as y, cast((vec_id%10)*8+i%8 as int) as x,
    cast((g*7+i)%256 as int) as b, g, cast((g*3+label*20)%256 as int) as r,
    cast(case when i%16=0 then 0 when i%16=1 then 128 else 255 end as int) as a from px_cells)""",
    "canvas": "canvas as (select vec_id as image_id, 8 as width, 8 as height from embeddings)",
    "mask_pixels": """mask_pixels as (
  select image_id, cast(floor(g/64) as int) as mask_id, y, x from px_flat where a > 0)""",
    "masks": """masks as (
  select vec_id as image_id, unnest([0,1,2,3]) as mask_id from embeddings)""",
    "colour_groups": """colour_groups as (
  select image_id, group_no, concat('g', group_no) as group_id, concat('Color ', group_no+1) as name,
    printf('#%02x%02x%02x', r, g, b) as color_hex, r, g, b, pixel_count,
    pixel_count/64.0*100.0 as area_percent, has_partial_alpha, group_no = 0 as is_excluded
  from (select image_id, cast(floor(g/64) as int) as group_no, count(*) as pixel_count,
    cast(round_even(avg(b),0) as int) as b, cast(round_even(avg(g),0) as int) as g,
    cast(round_even(avg(r),0) as int) as r, bool_or(a<255) as has_partial_alpha
    from px_flat where a > 0 group by 1, 2))""",
    "shapes": """shapes as (
  select cast(floor(p_partkey/40) as bigint) as doc_id, cast(p_partkey%40 as int) as k,
    p_brand, p_type, cast((p_partkey%8)*60 as double) as x0,
    cast(floor((p_partkey%40)/8)*60 as double) as y0,
    cast(10+p_size as double) as w, cast(10+(p_size*7)%50 as double) as h from part)""",
    "rings": """rings as (
  select doc_id, k as path_index, 0 as subpath_index, p_brand<>'Brand#2' as closed,
    x0, y0, x0+w as x1, y0+h as y1 from shapes
  union all select doc_id, k, 1, true, x0+5, y0+5, x0+w-5, y0+h-5 from shapes
    where p_type in ('SMALL','LARGE') and w>20 and h>20 and p_brand<>'Brand#2'
  union all select doc_id, k+40, 0, true, x0, y0, x0+w, y0+h from shapes where p_brand='Brand#1')""",
    "vertices": """vertices as (
  select doc_id, path_index, subpath_index, closed, i,
    case i when 0 then x0 when 1 then x1 when 2 then x1 when 3 then x0 else x0+0.3 end as x,
    case i when 0 then y0 when 1 then y0 when 2 then y1 when 3 then y1 else y0+0.2 end as y
  from rings cross join (select unnest([0,1,2,3,4]) as i) where i<4 or not closed)""",
    "projects": """projects as (
  select o_orderkey as id, o_custkey as owner_id, concat(o_orderpriority,' ',cast(o_orderkey as varchar)) as name,
    o_orderdate as created_at,
    case when o_orderstatus='F' then o_orderdate + interval 7 day else o_orderdate end as updated_at,
    case when o_orderstatus='P' then o_orderdate + interval 30 day end as deleted_at from orders)""",
    "vector_history": """vector_history as (
  select l_suppkey as project_id, l_partkey%5 as image_id, l_partkey%10 as source_id,
    l_orderkey as artifact_id, l_shipdate as created_at, cast(floor(l_quantity) as int) as path_count,
    cast(floor(l_extendedprice) as bigint) as node_count, l_linenumber as seq,
    concat('v=',cast(cast(floor(l_discount*100+0.5) as int) as varchar),'|inv=',l_linestatus) as cache_key
  from lineitem)""",
    "edit_log": """edit_log as (
  select event_id, ts, user_id as layer_id,
    case event_type when 'purchase' then 'cut' when 'click' then 'engrave' when 'error' then 'ignore' end as operation,
    case when event_type='view' then value>10 end as visible,
    case when event_type='signup' then concat('L',cast(user_id as varchar)) end as name,
    case when value<1 then '' else concat(cast(user_id as varchar),'-',event_type,'-',
      cast(cast(floor(value) as int) as varchar)) end as idempotency_key
  from events)""",
    "layers": """layers as (
  select concat(l_orderkey,'-',l_linenumber) as id, l_orderkey as version_id, l_partkey as group_id,
    l_partkey%64 as color_id, concat('Layer ', l_linenumber) as name, 8-l_linenumber as "order",
    case when l_returnflag<>'R' then l_returnflag='A' end as visible, l_linestatus='F' as locked,
    case when l_returnflag='A' then 'cut' when l_returnflag='N' and l_linestatus='O' then 'engrave'
      when l_tax<0.02 then 'ignore' end as operation, cast(floor(l_quantity) as int) as path_count
  from lineitem)""",
}

_NEEDS = {
    "px": ["px_cells"],
    "px_flat": ["px"],
    "px_mosaic": ["px_cells"],
    "mask_pixels": ["px_flat"],
    "colour_groups": ["px_flat"],
    "rings": ["shapes"],
    "vertices": ["rings"],
}


def ctes(*names: str) -> str:
    """``with a as (...), b as (...)`` for the named views and what they build on."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in _NEEDS.get(name, []):
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    return "with " + ",\n".join(_CTES[name] for name in ordered) + "\n"
