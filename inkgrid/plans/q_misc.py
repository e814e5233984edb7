"""Validation, scalar, sizing, export and source queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkgrid.functions import geometry, svgtext, text
from inkgrid.operators import catalog, svg, validation
from inkgrid.plans import views
from inkgrid.plans.q_outlines import _SUBTEXT, _V, _docs
from inkgrid.plans.registry import query
from inkgrid.session import run_dir
from inkgrid.sources import files
from inkgrid.streaming import ingest


def _t(spark, d, name):
    return views.table(spark, d, name)


# -------------------------------------------------------------------- uploads
# Documents as uploaded files: an image header in front of the whole text.

_MIMES = ["image/png", "image/jpeg", "image/webp", "image/gif"]
_HEADS = ["89504E470D0A1A0A", "FFD8FF", "5249464600000000574542505650385800000000", "47494638"]


def _files(spark, d):
    k = F.col("doc_id") % 4
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (k + 1).cast("int"))
    head = F.unhex(F.when(F.col("doc_id") % 7 == 0, "00").otherwise(pick(_HEADS)))
    body = F.encode(F.col("text"), "UTF-8")
    name = F.concat(F.lit("set/"), F.col("source"), F.lit("/f"), F.col("doc_id").cast("string"), pick([".png", ".JPG", ".webp", ".gif"]))
    return _t(spark, d, "documents").select(
        "doc_id", name.alias("path"), pick(_MIMES).alias("mime"), F.when(F.col("doc_id") % 11 == 0, F.unhex(F.lit(""))).otherwise(F.concat(head, body)).alias("content"),
    )


_FILES = """with files as (select doc_id, concat('set/', source, '/f', doc_id, ['.png','.JPG','.webp','.gif'][doc_id%4+1]) as path,
  ['image/png','image/jpeg','image/webp','image/gif'][doc_id%4+1] as mime,
  case when doc_id%11=0 then ''::blob else unhex(case when doc_id%7=0 then '00' else ['89504E470D0A1A0A','FFD8FF','5249464600000000574542505650385800000000','47494638'][doc_id%4+1] end) || encode(text) end as content
  from documents)
"""


@query("validate_uploads", _FILES + """select doc_id, case when octet_length(content)=0 then 'empty_file' when octet_length(content) > 5000 then 'file_too_large'
  when doc_id%4=3 then 'unsupported_format' when doc_id%7=0 then 'corrupt_file' end as reason from files""")
def validate_uploads(spark, d):
    rows = _files(spark, d).withColumnRenamed("path", "name")
    return validation.validate_uploads(rows, max_bytes=5000).select("doc_id", "reason")


@query("image_catalog", _FILES + """select concat('f', doc_id, ['.png','.JPG','.webp','.gif'][doc_id%4+1]) as file_name, case when doc_id%4=3 then null else mime end as mime,
  octet_length(content) as size, sha256(content) as checksum, 'uploaded' as status from files""")
def image_catalog(spark, d):
    return files.image_catalog(_files(spark, d).select("path", "content")).select("file_name", "mime", "size", "checksum", "status")


@query("header_dims", """select p_partkey, case p_partkey%5 when 4 then null else cast(p_size*37+1 as int) end as width,
  case p_partkey%5 when 4 then null else cast(p_size*11+3 as int) end as height from part""")
def header_dims(spark, d):
    """Headers of five kinds built from the part table: PNG, JPEG, WebP VP8X and VP8, none."""
    w, h = F.col("p_size") * 37 + 1, F.col("p_size") * 11 + 3

    def be(v, n):
        return F.lpad(F.hex(v), n * 2, "0")

    def le(v, n):
        text_ = be(v, n)
        return F.concat(*[F.substring(text_, 2 * (n - k) - 1, 2) for k in range(n)])

    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), be(w, 4), be(h, 4), F.lit("08060000"))
    jpeg = F.concat(F.lit("FFD8FFE000104A46494600010100000100010000FFC2001108"), be(h, 2), be(w, 2), F.lit("03012200"))
    vp8x = F.concat(F.lit("524946460000000057454250565038580A00000000000000"), le(w - 1, 3), le(h - 1, 3))
    vp8 = F.concat(F.lit("52494646000000005745425056503820100000000000009D012A"), le(w, 2), le(h, 2))
    k = F.col("p_partkey") % 5
    data = F.unhex(F.when(k == 0, png).when(k == 1, jpeg).when(k == 2, vp8x).when(k == 3, vp8).otherwise("0001"))
    return files.header_dims(_t(spark, d, "part").select("p_partkey", data.alias("content"))).select("p_partkey", "width", "height")


@query("load_svg", _V + _SUBTEXT + """select doc_id, case when length(svg) > 3600 then 'svg_too_large' when doc_id % 3 = 0 then 'invalid_input_svg' end as reason from docs""")
def load_svg(spark, d):
    """Written documents as files; every third one is broken UTF-8."""
    raw = F.encode("svg", "UTF-8")
    rows = _docs(spark, d).select(
        F.col("doc_id").cast("string").alias("path"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.unhex(F.lit("FF")), raw)).otherwise(raw).alias("content")
    )
    good, bad = files.load_svg(rows, max_bytes=3600)
    return good.select(F.col("path").cast("long").alias("doc_id"), F.lit(None).cast("string").alias("reason")).unionByName(
        bad.select(F.col("path").cast("long").alias("doc_id"), "reason")
    )


_RECORD = T.StructType([
    T.StructField("project_id", T.LongType()), T.StructField("version", T.LongType()), T.StructField("key", T.StringType()),
])
_RECORDS = "select l_suppkey as project_id, l_orderkey as version, concat(l_partkey, '-', l_linenumber) as key from lineitem"


def _records(spark, d):
    return _t(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("project_id"), F.col("l_orderkey").alias("version"),
        F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string")).alias("key"),
    )


@query("append_registry", _RECORDS)
def append_registry(spark, d):
    """Two appends to a partitioned history, read back."""
    folder = run_dir(spark, "registry")
    rows = _records(spark, d)
    files.append_registry(rows.where("version % 2 = 0"), folder)
    files.append_registry(rows.where("version % 2 = 1"), folder)
    return files.read_registry(spark, folder, _RECORD).select("project_id", "version", "key")


@query("load_registry", "select l_suppkey as project_id, l_orderkey as version from lineitem where l_orderkey % 10 > 0")
def load_registry(spark, d):
    """JSON records read back from files; broken ones are skipped."""
    folder = run_dir(spark, "records")
    good = F.to_json(F.struct("project_id", "version", "key"))
    rows = _records(spark, d).select(F.when(F.col("version") % 10 > 0, good).otherwise(F.lit('{"project_id": oops')).alias("value"))
    rows.write.text(folder)
    return files.load_registry(spark, folder, _RECORD, one_per_file=False).select("project_id", "version")


@query("stream_latest", """select l_suppkey as project_id, max(l_orderkey*10+l_linenumber) as version, arg_max(concat(l_partkey, '-', l_linenumber), l_orderkey*10+l_linenumber) as key
  from lineitem group by 1""")
def stream_latest(spark, d):
    """Records arrive as JSON files in two batches; the newest per project is kept."""
    folder = run_dir(spark, "stream")
    rows = _records(spark, d).withColumn("version", F.col("version") * 10 + F.split_part("key", F.lit("-"), F.lit(2)).cast("int"))
    for part in (0, 1):
        rows.where(F.pmod(F.xxhash64("version"), F.lit(2)) == part).select(F.to_json(F.struct("project_id", "version", "key")).alias("value")).write.mode("append").text(f"{folder}/in")
        ingest.stream_latest(spark, f"{folder}/in", _RECORD, ["project_id"], "version", f"{folder}/out", f"{folder}/state", 16).awaitTermination()
    return ingest.latest_snapshot(spark, _RECORD, f"{folder}/out")


@query("stream_earliest", """select l_suppkey as project_id, min(l_orderkey*10+l_linenumber) as version, (min(struct_pack(v := l_orderkey*10+l_linenumber, k := concat(l_partkey, '-', l_linenumber)))).k as key
  from lineitem group by 1""")
def stream_earliest(spark, d):
    """Uploads arrive as JSON files in three batches, late ones among them; the earliest per idempotency key is kept."""
    folder = run_dir(spark, "uploads")
    rows = _records(spark, d).withColumn("version", F.col("version") * 10 + F.split_part("key", F.lit("-"), F.lit(2)).cast("int")).select(F.col("project_id").cast("string").alias("project"), "version", "key")
    for part in (0, 1, 2):
        rows.where(F.pmod(F.xxhash64("version"), F.lit(3)) == part).select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(f"{folder}/in")
        ingest.stream_earliest(spark, f"{folder}/in", rows.schema, "project", ["version"], f"{folder}/out", f"{folder}/state", 16).awaitTermination()
    return ingest.latest_snapshot(spark, rows.schema, f"{folder}/out").select(F.col("project").cast("long").alias("project_id"), "version", "key")


# ----------------------------------------------------------------- validation

@query("validate_assets", """select l_orderkey, l_linenumber, case when not regexp_matches(lower(trim(l_returnflag || ['', ' x', '_svg'][l_linenumber%3+1])), '^[a-z0-9_-]{1,40}$') then 'invalid_type'
  when l_quantity = 1 then 'empty_file' when l_extendedprice > 50000 then 'file_too_large'
  when l_partkey%5 = 4 then 'unsupported_format' end as reason from lineitem""")
def validate_assets(spark, d):
    pick = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), (k + 1).cast("int"))
    rows = _t(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.concat("l_returnflag", pick(["", " x", "_svg"], F.col("l_linenumber") % 3)).alias("type"),
        pick(["image/png", " IMAGE/JPEG", "image/webp", "image/svg+xml", "text/plain"], F.col("l_partkey") % 5).alias("mime"),
        F.when(F.col("l_quantity") == 1, 0.0).otherwise(F.col("l_extendedprice")).alias("size"),
    )
    return validation.validate_assets(rows, max_bytes=50000).select("l_orderkey", "l_linenumber", "reason")


@query("dimension_guard", """select l_orderkey, l_linenumber, case when l_quantity*150 > 6000 or l_partkey*4 > 6000 or cast(l_quantity*150 as bigint)*(l_partkey*4) > 25000000 then 'dimensions_exceeded' end as reason from lineitem""")
def dimension_guard(spark, d):
    rows = _t(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") * 150).cast("long").alias("width"), (F.col("l_partkey") * 4).alias("height")
    )
    return validation.dimension_guard(rows).select("l_orderkey", "l_linenumber", "reason")


@query("validate_params", """select o_orderkey, 'preprocess' as kind, coalesce(case when o_orderkey%9>0 then o_totalprice/100000 end, 1.0) between 0.5 and 3.0
    and o_orderkey%250-120 between -100 and 100 and o_custkey%13 between 0 and 10 as ok from orders
  union all select o_orderkey, 'threshold', coalesce(nullif(o_custkey%300, 7), 128) between 0 and 255 from orders
  union all select o_orderkey, 'palette', o_totalprice/3000 between 0 and 100 and coalesce(nullif(o_custkey%70,5),1) between 1 and 64 and (o_orderkey%7)/10.0 between 0 and 0.5 from orders
  union all select o_orderkey, 'check', (o_orderkey%12)/20.0 > 0 and (o_orderkey%12)/20.0 <= 0.5 from orders
  union all select o_orderkey, 'simplify', case o_orderkey%4 when 0 then true when 1 then (o_custkey%12)/20.0 > 0 and (o_custkey%12)/20.0 <= 0.5 else false end from orders""")
def validate_params(spark, d):
    o = _t(spark, d, "orders")
    key, cust, price = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    requests = {
        "preprocess": o.select("o_orderkey", F.when(key % 9 > 0, price / 100000).alias("contrast"), (key % 250 - 120).alias("brightness"), (cust % 13).alias("denoise")),
        "threshold": o.select("o_orderkey", F.nullif(cust % 300, F.lit(7)).alias("value")),
        "palette": o.select("o_orderkey", (price / 3000).alias("tolerance"), F.nullif(cust % 70, F.lit(5)).alias("max_colors"), (key % 7 / 10.0).alias("tiny_ratio")),
        "check": o.select("o_orderkey", (key % 12 / 20.0).alias("gap_ratio"), F.lit(None).cast("double").alias("duplicate_ratio")),
        "simplify": o.select(
            "o_orderkey", F.when(key % 4 == 0, " High ").when(key % 4 == 2, "extreme").when(key % 4 == 3, "low").alias("preset"),
            F.when(key % 4 == 1, cust % 12 / 20.0).when(key % 4 == 3, F.lit(0.1)).alias("tolerance"),
        ),
    }
    out = None
    for kind, rows in requests.items():
        part = validation.validate_params(rows, kind).select("o_orderkey", F.lit(kind).alias("kind"), F.col("reason").isNull().alias("ok"))
        out = part if out is None else out.unionByName(part)
    return out


@query("resolve_preset", "select o_orderkey, case o_orderkey%4 when 0 then 0.0015::double when 1 then 0.004::double when 2 then 0.012::double end as epsilon from orders")
def resolve_preset(spark, d):
    name = F.element_at(F.array(*[F.lit(v) for v in (" low", "MEDIUM", "High ", "huge")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return _t(spark, d, "orders").select("o_orderkey", validation.resolve_preset(name).alias("epsilon"))


@query("physical_size", """select l_orderkey, l_linenumber, floor(w*1000)/1000 as out_width_mm, floor(h*1000)/1000 as out_height_mm, case when lock and n <> 1 then 'one_side_required' when not lock and n <> 2 then 'both_sides_required'
  when wm < 1 or wm > 1000 or hm < 1 or hm > 1000 then 'invalid_parameters' when w < 1 or w > 1000 or h < 1 or h > 1000 then 'dimension_out_of_range' end as reason
  from (select *, (wm is not null)::int + (hm is not null)::int as n, case when lock and wm is null then hm*(wp/hp) else wm end as w, case when lock and hm is null then wm/(wp/hp) else hm end as h
  from (select l_orderkey, l_linenumber, case when l_linenumber%3 <> 1 then l_extendedprice/50 end as wm, case when l_linenumber%3 <> 2 then l_quantity/2 end as hm,
  l_returnflag <> 'A' as lock, cast(l_partkey+1 as double) as wp, cast(l_suppkey+1 as double) as hp from lineitem))""")
def physical_size(spark, d):
    line = F.col("l_linenumber") % 3
    rows = _t(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(line != 1, F.col("l_extendedprice") / 50).alias("width_mm"), F.when(line != 2, F.col("l_quantity") / 2).alias("height_mm"),
        (F.col("l_returnflag") != "A").alias("lock"), (F.col("l_partkey") + 1).alias("width_px"), (F.col("l_suppkey") + 1).alias("height_px"),
    )
    return validation.physical_size(rows).select(
        "l_orderkey", "l_linenumber", *[(F.floor(F.col(c) * 1000) / 1000).alias(c) for c in ("out_width_mm", "out_height_mm")], "reason"
    )


@query("result_quality", """select o_orderkey, case when o_orderkey%13=0 then 'not_svg' when o_custkey%50=0 then 'bad_dimensions' when o_orderkey%17=0 then 'negative_counts'
  when o_orderkey%19=0 then 'bounds_not_finite' when o_orderkey%23=0 then 'bounds_reversed' when o_orderkey%29=0 then 'bounds_size' when o_orderkey%31=0 then 'content_type' end as reason from orders""")
def result_quality(spark, d):
    k = F.col("o_orderkey")
    rows = _t(spark, d, "orders").select(
        "o_orderkey", F.when(k % 13 == 0, "<html/>").otherwise("<svg width='1'/>").alias("svg"), (F.col("o_custkey") % 50).alias("width"), F.lit(10).alias("height"),
        F.when(k % 17 == 0, -1).otherwise(3).alias("path_count"), F.lit(5).alias("node_count"),
        F.when(k % 19 == 0, float("nan")).otherwise(1.0).alias("min_x"), F.lit(0.0).alias("min_y"), F.when(k % 23 == 0, 0.0).otherwise(4.0).alias("max_x"),
        F.lit(2.0).alias("max_y"), F.when(k % 29 == 0, 3.5).otherwise(3.0).alias("bounds_width"), F.lit(2.0).alias("bounds_height"),
        F.when(k % 31 == 0, "text/xml").otherwise("image/SVG+xml").alias("content_type"),
    )
    return validation.result_quality(rows).select("o_orderkey", "reason")


@query("summary_quality", """select o_orderkey as id, o_orderkey%8 as stated, coalesce(n, 0) as found from orders left join
  (select l_orderkey, count(*) as n from lineitem group by 1) on l_orderkey = o_orderkey where o_orderkey%8 <> coalesce(n, 0)""")
def summary_quality(spark, d):
    rows = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"))
    summary = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 8).alias("stated"))
    return validation.summary_quality(rows, summary, "id", "stated")


@query("batch_complete", """with w as (select l_orderkey as k, l_linenumber as i, count(*) as n from lineitem group by 1,2)
, g as (select l_orderkey as k, l_linenumber as i, count(*) as n from lineitem where l_quantity > 5 group by 1,2)
select w.k as image_id, cast(sum(w.n) as bigint) as requested, cast(sum(coalesce(g.n,0)) as bigint) as produced, bool_and(w.n = coalesce(g.n,0)) as complete from w left join g using (k, i) group by 1""")
def batch_complete(spark, d):
    rows = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("item"), "l_quantity")
    return validation.batch_complete(rows, rows.where("l_quantity > 5"), "image_id", "item")


@query("large_design", """select l_orderkey, l_linenumber from lineitem where l_quantity*12 > 500 or l_extendedprice > 50000 or l_partkey*l_suppkey*50 > 4000000""")
def large_design(spark, d):
    rows = _t(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") * 12).alias("path_count"), (F.col("l_extendedprice") / 10).alias("node_count"),
        F.col("l_partkey").alias("width"), (F.col("l_suppkey") * 50).alias("height"),
    )
    return validation.large_designs(rows).select("l_orderkey", "l_linenumber")


# --------------------------------------------------------------------- export

_SAFE = r"""case when n is null or trim(final) = '' then 'export' when regexp_matches(final, '(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])$') then concat('_', final) else final end"""


def _safe_sql(source: str, column: str) -> str:
    """CTEs ending in ``named``: the rows of ``source`` with ``base``."""
    return rf"""
, s1 as (select *, {column} as n, regexp_replace({column}, '(?s)^.*[/\\]', '') as last from {source})
, s2 as (select *, case when regexp_matches(last, '(?s)^.+\.[^.]*$') then regexp_replace(last, '(?s)\.[^.]*$', '') else last end as stem from s1)
, s3 as (select *, regexp_replace(stem, '[\x00-\x1f\x7f<>:"/\\|?*]', '_', 'g') as plain from s2)
, s4 as (select *, regexp_replace(regexp_replace(regexp_replace(plain, '^\s+|\s+$', '', 'g'), '^[. ]+', ''), '[. ]+$', '') as tr from s3)
, s5 as (select *, case when length(tr) > 80 then regexp_replace(substring(tr, 1, 80), '[. _]+$', '') else tr end as final from s4)
, named as (select *, {_SAFE} as base from s5)
"""


@query("safe_file_name", "with x as (select doc_id, text from documents union all select -page_id-1, url from pages)" + _safe_sql("x", "text")
       + "select doc_id, concat(base, '-vector-v1.svg') as file_name from named")
def safe_file_name(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", "text").unionAll(_t(spark, d, "pages").select(-F.col("page_id") - 1, "url"))
    return rows.select("doc_id", text.safe_file_name(F.col("text"), F.lit("vector-v1")).alias("file_name"))


@query("export_manifest", """with req as (select l_orderkey as r, l_linenumber as n, ['vector','simplification','dimension','poster'][l_linenumber%4+1] as kind, l_partkey as source_id from lineitem)
, hist as (select ['vector','simplification','dimension'][p_partkey%3+1] as kind, p_partkey as source_id, p_partkey%50 as project_id, concat('k/', p_partkey, '.svg') as storage_key, p_size as version from part)
select concat(r,'-',n) as request_id, storage_key, case when storage_key is not null then 'image/svg+xml' end as content_type, version,
  case when storage_key is not null then concat(coalesce('My_' || s_name, 'export'), '-', kind, '-v', version, '.svg') end as download_name,
  case when kind = 'poster' then 'invalid_parameters' when storage_key is null then 'not_found' end as reason
  from req left join hist using (kind, source_id) left join supplier on s_suppkey = project_id""")
def export_manifest(spark, d):
    names = F.array(*[F.lit(v) for v in (" Vector", "SIMPLIFICATION", "dimension", "poster")])
    requests = _t(spark, d, "lineitem").select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("request_id"),
        F.element_at(names, (F.col("l_linenumber") % 4 + 1).cast("int")).alias("kind"), F.col("l_partkey").alias("source_id"),
    )
    part = _t(spark, d, "part")
    histories = {
        kind: part.where(F.col("p_partkey") % 3 == k).select(
            F.col("p_partkey").alias("source_id"), (F.col("p_partkey") % 50).alias("project_id"),
            F.concat(F.lit("k/"), F.col("p_partkey").cast("string"), F.lit(".svg")).alias("storage_key"), F.lit("image/svg+xml").alias("content_type"),
            F.col("p_size").alias("version"),
        ) for k, kind in enumerate(("vector", "simplification", "dimension"))
    }
    projects = _t(spark, d, "supplier").select(
        F.col("s_suppkey").alias("project_id"), F.concat(F.lit("C:\\dir/My?"), "s_name", F.lit(".png")).alias("file_name")
    )
    return validation.export_manifest(requests, histories, projects)


@query("asset_keys", "select l_orderkey, l_linenumber, concat('projects/', l_orderkey, '/mask/', l_partkey, ['.png','.jpg','.webp','.svg'][l_linenumber%4+1]) as key from lineitem")
def asset_keys(spark, d):
    mimes = F.array(*[F.lit(v) for v in ("image/png", "image/jpeg", "image/webp", "Image/svg+xml")])
    mime = F.element_at(mimes, (F.col("l_linenumber") % 4 + 1).cast("int"))
    return _t(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", text.asset_key(F.col("l_orderkey"), F.lit("mask"), F.col("l_partkey"), mime).alias("key")
    )


# -------------------------------------------------------------------- scalars

@query("clean_name", """select doc_id, trim(text) as name, case when trim(text) = '' or length(trim(text)) > 200 then 'invalid_name' end as reason from documents""")
def clean_name(spark, d):
    name, reason = catalog.clean_name(F.col("text"))
    return _t(spark, d, "documents").select("doc_id", name.alias("name"), reason.alias("reason"))


@query("cache_key", """select o_orderkey, concat('gs=', case when o_custkey%2=0 then 'True' else 'False' end, '|c=', regexp_replace(regexp_replace(printf('%.3f', (o_orderkey%30)/10.0), '0+$', ''), '\\.$', ''), '|b=', o_orderkey%90, '|d=', o_custkey%10) as preprocess_key,
  concat('v=', o_orderkey%256, '|inv=', case when o_custkey%2=0 then 'True' else 'False' end) as threshold_key,
  concat('tolerance=', printf('%.6f', (o_orderkey%100)/4.0), ';maxColors=', case when o_custkey%3=0 then 'none' else cast(o_custkey%64 as varchar) end, ';tinyAreaRatio=0.001000') as palette_key,
  concat('epsilon=', printf('%.6f', (o_orderkey%100)/1000.0)) as simplification_key,
  concat('width=', printf('%.6f', o_orderkey/8.0), '|height=', printf('%.6f', o_custkey/4.0), '|lock=True') as dimension_key, 'engine=vtracer' as vector_key from orders""")
def cache_key(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    even = c % 2 == 0
    return _t(spark, d, "orders").select(
        "o_orderkey", text.preprocess_key(even, k % 30 / 10.0, k % 90, c % 10).alias("preprocess_key"), text.threshold_key(k % 256, even).alias("threshold_key"),
        text.palette_key(k % 100 / 4.0, F.when(c % 3 != 0, c % 64), F.lit(0.001)).alias("palette_key"),
        text.simplification_key(k % 100 / 1000.0).alias("simplification_key"), text.dimension_key(k / 8.0, c / 4.0, F.lit(True)).alias("dimension_key"), text.vector_key().alias("vector_key"),
    )


@query("format_mm", "select l_orderkey, l_linenumber, concat(regexp_replace(regexp_replace(printf('%.3f', l_extendedprice/7), '0+$', ''), '\\.$', ''), 'mm') as mm from lineitem")
def format_mm(spark, d):
    """Prices as lengths; sevenths never fall on a tie of the third decimal, where formatters differ."""
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.format_mm(F.col("l_extendedprice") / 7).alias("mm"))


@query("parse_enum", "select o_orderkey, case when lower(trim(substring(o_orderpriority, 3))) in ('urgent','high','low') then lower(trim(substring(o_orderpriority, 3))) end as level from orders")
def parse_enum(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", text.parse_enum(F.expr("substring(o_orderpriority, 3)"), ["urgent", "high", "low"]).alias("level"))


@query("parse_mm", "select event_id, case when event_id%3=0 then null else value end as mm from events")
def parse_mm(spark, d):
    raw = F.when(F.col("event_id") % 6 == 0, "  ").when(F.col("event_id") % 3 == 0, "12 mm").otherwise(F.concat(F.lit(" "), F.col("value").cast("string"), F.lit(" ")))
    return _t(spark, d, "events").select("event_id", text.parse_mm(raw).alias("mm"))


@query("json_string_array", "select event_id, case event_id%4 when 0 then concat('a', event_id, '|', event_type) when 1 then '' end as items from events")
def json_string_array(spark, d):
    k, q = F.col("event_id") % 4, F.lit('"')
    raw = (
        F.when(k == 0, F.concat(F.lit('["a'), F.col("event_id").cast("string"), F.lit('", "'), "event_type", F.lit('"]')))
        .when(k == 1, "[]").when(k == 2, F.concat(F.lit("[1, "), q, "event_type", q, F.lit("]"))).otherwise('["", "x"]')
    )
    return _t(spark, d, "events").select("event_id", F.array_join(text.json_string_array(raw), "|").alias("items"))


@query("local_name", "select page_id, lower(url) as name from pages")
def local_name(spark, d):
    return _t(spark, d, "pages").select("page_id", svgtext.local_name(F.concat(F.lit("{http://www.w3.org/2000/svg}"), "url")).alias("name"))


_PATHS = _V + _SUBTEXT


def _paths(spark, d):
    return svg.path_text(views.vertices(spark, d))


@query("path_tokens", _PATHS + """select doc_id, path_index, len(regexp_extract_all(d, '[MLZ]')) as commands, len(regexp_extract_all(d, '[0-9]+[.][0-9]+')) as numbers from ptext""")
def path_tokens(spark, d):
    tokens = svgtext.path_tokens(F.col("d"))
    return _paths(spark, d).select(
        "doc_id", "path_index", F.size(tokens).cast("long").alias("commands"),
        F.aggregate(tokens, F.lit(0).cast("long"), lambda n, t: n + F.size(t["numbers"])).alias("numbers"),
    )


@query("extract_subpaths", _V + """select doc_id, path_index, subpath_index, any_value(closed) as closed, count(*) as n_points, round(sum(x+y),6) as total from vertices group by 1,2,3""")
def extract_subpaths(spark, d):
    rows = _paths(spark, d).select("doc_id", "path_index", F.posexplode(svgtext.extract_subpaths(F.col("d"))).alias("subpath_index", "s"))
    total = F.aggregate("s.points", F.lit(0.0), lambda n, p: n + p["x"] + p["y"])
    return rows.select("doc_id", "path_index", "subpath_index", "s.closed", F.size("s.points").cast("long").alias("n_points"), F.round(total, 6).alias("total"))


@query("is_supported_path", "select doc_id, regexp_matches(text, '[MLZ]') and not regexp_matches(text, '[HVCSQTAmlhvcsqtaz]') as supported from documents"
       " union all select -p_partkey-1, p_partkey%3 = 0 from part")
def is_supported_path(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", F.col("text").alias("d")).unionByName(_t(spark, d, "part").select(
        (-F.col("p_partkey") - 1).alias("doc_id"),
        F.when(F.col("p_partkey") % 3 == 0, "M0,0L1,1Z").when(F.col("p_partkey") % 3 == 1, "M0,0C1,1 2,2 3,3").otherwise("").alias("d"),
    ))
    return rows.select("doc_id", svgtext.is_supported_path(F.col("d")).alias("supported"))


def _transforms(spark, d):
    k, n = F.col("o_orderkey") % 6, F.col("o_custkey").cast("string")
    value = (
        F.when(k == 0, "").when(k == 1, F.concat(F.lit(" translate("), n, F.lit(") "))).when(k == 2, F.concat(F.lit("translate("), n, F.lit(", -2.5)")))
        .when(k == 3, F.concat(F.lit("translate("), n, F.lit(" 1e1)"))).when(k == 4, F.concat(F.lit("rotate(3) translate("), n, F.lit(",4)"))).otherwise("scale(2)")
    )
    return _t(spark, d, "orders").select("o_orderkey", value.alias("t"))


@query("parse_translate", """select o_orderkey, case when o_orderkey%6=0 then 0.0 when o_orderkey%6<4 then cast(o_custkey as double) end as tx,
  case o_orderkey%6 when 0 then 0.0 when 1 then 0.0 when 2 then -2.5 when 3 then 10.0 end::double as ty from orders""")
def parse_translate(spark, d):
    shift = svgtext.parse_translate(F.col("t"))
    return _transforms(spark, d).select("o_orderkey", shift["tx"].alias("tx"), shift["ty"].alias("ty"))


@query("translate_lenient", """select o_orderkey, case when o_orderkey%6 in (2,4) then cast(o_custkey as double) else 0.0 end as tx,
  case o_orderkey%6 when 2 then -2.5 when 4 then 4.0 else 0.0 end::double as ty from orders""")
def translate_lenient(spark, d):
    shift = svgtext.translate_lenient(F.col("t"))
    return _transforms(spark, d).select("o_orderkey", shift["tx"].alias("tx"), shift["ty"].alias("ty"))


@query("canvas_size", """select o_orderkey, case when o_orderkey%3=2 then 0 else cast(round_even(o_custkey/2.0,0) as int) end as width,
  case when o_orderkey%3=2 then 0 else cast(o_orderkey%500 as int) end as height from orders""")
def canvas_size(spark, d):
    unit = F.when(F.col("o_orderkey") % 3 == 2, "mm").otherwise("")
    doc = F.concat(F.lit("<svg height='"), (F.col("o_orderkey") % 500).cast("string"), F.lit("' width=\""), (F.col("o_custkey") / 2.0).cast("string"), unit, F.lit('"><path d=""/></svg>'))
    size = svgtext.canvas_size(doc)
    return _t(spark, d, "orders").select("o_orderkey", size["width"].alias("width"), size["height"].alias("height"))


@query("parse_viewbox", "select o_orderkey, 0.0::double as min_x, -1.5::double as min_y, cast(o_custkey as double) as width, case when o_orderkey%2=0 then 7.0::double end as height from orders")
def parse_viewbox(spark, d):
    box = F.concat(F.lit(" 0  -1.5 "), F.col("o_custkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, " 7").otherwise(" auto"))
    return _t(spark, d, "orders").select("o_orderkey", svgtext.parse_viewbox(box).alias("v")).select("o_orderkey", "v.*")


# Line items as points and segments.
_SEG = """with s as (select l_orderkey, l_linenumber, l_quantity as px, l_tax*500 as py, cast(l_partkey%50 as double) as ax, cast(l_suppkey%40 as double) as ay,
  case when l_linenumber=7 then cast(l_partkey%50 as double) else l_discount*400 end as bx, case when l_linenumber=7 then cast(l_suppkey%40 as double) else cast(l_linenumber*6 as double) end as by_ from lineitem)
"""


def _seg(spark, d):
    last = F.col("l_linenumber") == 7
    ax, ay = (F.col("l_partkey") % 50).cast("double"), (F.col("l_suppkey") % 40).cast("double")
    return _t(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("px"), (F.col("l_tax") * 500).alias("py"), ax.alias("ax"), ay.alias("ay"),
        F.when(last, ax).otherwise(F.col("l_discount") * 400).alias("bx"), F.when(last, ay).otherwise((F.col("l_linenumber") * 6).cast("double")).alias("by"),
    )


_P, _A, _B = (tuple((f"{p}x", f"{p}y")) for p in "pab")


def _c(names):
    return tuple(F.col(n) for n in names)


@query("point_segment_distance", _SEG + """select l_orderkey, l_linenumber, round(case when pow(bx-ax,2)+pow(by_-ay,2) <= 1e-18 then sqrt(pow(px-ax,2)+pow(py-ay,2)) else
  sqrt(pow(px-ax-t*(bx-ax),2)+pow(py-ay-t*(by_-ay),2)) end, 6) as distance from (select *, greatest(0.0, least(1.0, ((px-ax)*(bx-ax)+(py-ay)*(by_-ay))/greatest(pow(bx-ax,2)+pow(by_-ay,2),1e-18))) as t from s)""")
def point_segment_distance(spark, d):
    return _seg(spark, d).select("l_orderkey", "l_linenumber", F.round(geometry.point_segment_distance(_c(_P), _c(_A), _c(_B)), 6).alias("distance"))


@query("perpendicular_distance", _SEG + """select l_orderkey, l_linenumber, round(case when ax=bx and ay=by_ then sqrt(pow(px-ax,2)+pow(py-ay,2)) else
  abs((by_-ay)*px-(bx-ax)*py+bx*ay-by_*ax)/sqrt(pow(bx-ax,2)+pow(by_-ay,2)) end, 6) as distance from s""")
def perpendicular_distance(spark, d):
    return _seg(spark, d).select("l_orderkey", "l_linenumber", F.round(geometry.perpendicular_distance(_c(_P), _c(_A), _c(_B)), 6).alias("distance"))


def _ps(p, a, b):
    px, py, ax, ay, bx, by = f"{p}x", f"{p}y", f"{a}x", f"{a}y", f"{b}x", f"{b}y"
    t = f"(case when pow({bx}-{ax},2)+pow({by}-{ay},2)<=1e-18 then 0.0 else greatest(0.0,least(1.0,(({px}-{ax})*({bx}-{ax})+({py}-{ay})*({by}-{ay}))/greatest(pow({bx}-{ax},2)+pow({by}-{ay},2),1e-18))) end)"
    return f"sqrt(pow({px}-{ax}-{t}*({bx}-{ax}),2)+pow({py}-{ay}-{t}*({by}-{ay}),2))"


def _cross_sql():
    """Do p-q and a-e meet: where the lines cross, that point lies within both; parallel ones meet if an end of one lies on the other."""
    det = "((qx-px)*(ey-ay)-(qy-py)*(ex-ax))"
    along = [f"((ax-px)*({v}y-{u}y)-(ay-py)*({v}x-{u}x))/{det} between -1e-9 and 1+1e-9" for u, v in (("a", "e"), ("p", "q"))]
    ends = ", ".join(_ps(*x) for x in (("p", "a", "e"), ("q", "a", "e"), ("a", "p", "q"), ("e", "p", "q")))
    return f"(case when abs({det}) > 1e-12 then {along[0]} and {along[1]} else least({ends}) <= 1e-9 end)"


_SEG2 = _SEG + ", z as (select l_orderkey, l_linenumber, px, py, px+3 as qx, py+1 as qy, ax, ay, bx as ex, by_ as ey from s)\n"


@query("segments_intersect", _SEG2 + f"select l_orderkey, l_linenumber, {_cross_sql()} as meets from z")
def segments_intersect(spark, d):
    q = (F.col("px") + 3, F.col("py") + 1)
    return _seg(spark, d).select("l_orderkey", "l_linenumber", geometry.segments_intersect(_c(_P), q, _c(_A), _c(_B)).alias("meets"))


@query("segment_distance", _SEG2 + f"""select l_orderkey, l_linenumber, round(case when {_cross_sql()} then 0.0 else least({_ps('p','a','e')}, {_ps('q','a','e')}, {_ps('a','p','q')}, {_ps('e','p','q')}) end, 6) as distance from z""")
def segment_distance(spark, d):
    q = (F.col("px") + 3, F.col("py") + 1)
    return _seg(spark, d).select("l_orderkey", "l_linenumber", F.round(geometry.segment_distance(_c(_P), q, _c(_A), _c(_B)), 6).alias("distance"))


@query("affine_compose", """select o_orderkey, round(2*cos(radians(t)),6) as a, round(2*sin(radians(t)),6) as b, round(-3*sin(radians(t)),6) as c, round(3*cos(radians(t)),6) as d,
  round(o_custkey::double,6) as e, 5.0::double as f from (select *, (o_orderkey%90)::double as t from orders)""")
def affine_compose(spark, d):
    return _matrix(spark, d).select("o_orderkey", *[F.round(F.col("m")[c], 6).alias(c) for c in "abcdef"])


def _matrix(spark, d):
    raw = F.concat(
        F.lit("translate("), F.col("o_custkey").cast("string"), F.lit(",5) blur(9) rotate("), (F.col("o_orderkey") % 90).cast("string"), F.lit(") scale(2 3)")
    )
    return _t(spark, d, "orders").select("o_orderkey", geometry.affine_parse(raw).alias("m"))


@query("affine_decompose", """select o_orderkey, round(o_custkey::double,6) as x, 5.0::double as y, round((o_orderkey%90)::double,6) as rotation, 2.0::double as scale_x, 3.0::double as scale_y, 0.0::double as skew_x from orders""")
def affine_decompose(spark, d):
    parts = _matrix(spark, d).select("o_orderkey", geometry.affine_decompose(F.col("m")).alias("p")).select("o_orderkey", "p.*")
    return parts.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in ("x", "y", "rotation", "scale_x", "scale_y", "skew_x")})


@query("resize_documents", _V + _SUBTEXT + """select doc_id, replace(svg, '<svg xmlns="http://www.w3.org/2000/svg" width="500" height="320">', concat('<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 500 320" width="', doc_id%90+10, '.5mm" height="', doc_id%80+12, 'mm"',
  case when doc_id%2=0 then '' else ' preserveAspectRatio="none"' end, '>')) as svg, cast(null as varchar) as reason from docs""")
def resize_documents(spark, d):
    docs = _docs(spark, d)
    sizes = docs.select(
        "doc_id", (F.col("doc_id") % 90 + 10.5).alias("width_mm"), (F.col("doc_id") % 80 + 12.0).alias("height_mm"), F.lit(500).alias("width_px"),
        F.lit(320).alias("height_px"), (F.col("doc_id") % 2 == 0).alias("locked"),
    )
    return svg.resize_documents(docs, sizes)
