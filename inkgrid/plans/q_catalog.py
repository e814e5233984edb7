"""Catalogue, history and edit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkgrid.operators import catalog, edits, history
from inkgrid.plans import views
from inkgrid.plans.registry import query
from inkgrid.plans.views import ctes
from inkgrid.session import run_dir
from inkgrid.sources import files

NOW = "timestamp '2025-01-01 00:00:00'"


def _now():
    return F.lit("2025-01-01 00:00:00").cast("timestamp")


# ------------------------------------------------------------------ histories

_HISTORY_KEYS = ["project_id", "image_id"]
_ARRIVAL = ["created_at", "artifact_id", "seq"]


def _versioned(spark, d):
    rows = views.vector_history(spark, d)
    return history.numbered(rows, _HISTORY_KEYS, _ARRIVAL, "version")


_VERSIONED = ctes("vector_history") + """, versioned as (select *, row_number() over (
  partition by project_id, image_id order by created_at, artifact_id, seq) as version from vector_history)
"""


@query("latest_version", _VERSIONED + """select project_id, image_id, version, artifact_id, path_count, cache_key
  from (select *, row_number() over (partition by project_id, image_id order by version desc) as n from versioned) where n = 1""")
def latest_version(spark, d):
    last = history.latest_version(_versioned(spark, d), _HISTORY_KEYS)
    return last.select(*_HISTORY_KEYS, "version", "artifact_id", "path_count", "cache_key")


@query("assign_versions", ctes("vector_history") + """
, old as (select * from vector_history where created_at < timestamp '1998-01-01')
, top as (select project_id, image_id, count(*) as top from old group by 1,2)
, fresh as (select *, row_number() over (partition by project_id, image_id order by created_at, artifact_id, seq) as n
  from vector_history where created_at >= timestamp '1998-01-01')
select project_id, image_id, artifact_id, seq, created_at, n + coalesce(top, 0) as version from fresh left join top using (project_id, image_id)""")
def assign_versions(spark, d):
    rows = views.vector_history(spark, d)
    cut = F.lit("1998-01-01").cast("timestamp")
    old = history.numbered(rows.where(F.col("created_at") < cut), _HISTORY_KEYS, _ARRIVAL, "version")
    fresh = rows.where(F.col("created_at") >= cut)
    return history.assign_versions(fresh, old, _HISTORY_KEYS, _ARRIVAL).select(
        *_HISTORY_KEYS, "artifact_id", "seq", "created_at", "version"
    )


@query("cache_hits", ctes("vector_history") + """, firsts as (select *, first_value(artifact_id) over w as used_artifact,
  row_number() over w as n from vector_history
  window w as (partition by project_id, image_id, source_id, cache_key order by created_at, artifact_id, seq))
select project_id, image_id, source_id, artifact_id, seq, cache_key, used_artifact,
  (created_at, artifact_id, seq) <> first_value((created_at, artifact_id, seq)) over (
    partition by project_id, image_id, source_id, cache_key order by created_at, artifact_id, seq) as from_cache from firsts""")
def cache_hits(spark, d):
    found = history.cache_hits(views.vector_history(spark, d), ["project_id", "image_id", "source_id"], _ARRIVAL, "artifact_id")
    return found.select(
        "project_id", "image_id", "source_id", "artifact_id", "seq", "cache_key", "used_artifact", "from_cache"
    )


@query("lineage", """
with masks as (select o_orderkey as id, o_custkey + (o_orderkey%7)//6 * 1000000000 as source_id from orders)
, vectors as (select concat(l_orderkey,'-',l_linenumber,'-',l_partkey) as id, l_orderkey as source_id from lineitem)
, ok_masks as (select masks.* from masks join customer on c_custkey = source_id)
select 'mask' as stage, cast(id as varchar) as id, cast(source_id as varchar) as source_id,
  case when exists (select 1 from customer where c_custkey = masks.source_id) then 'ok' else 'not_found' end as status from masks
union all
select 'vector', id, cast(source_id as varchar),
  case when exists (select 1 from ok_masks m where m.id = vectors.source_id) then 'ok' else 'not_found' end from vectors""")
def lineage(spark, d):
    images = views.table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    masks = views.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_custkey") + F.floor((F.col("o_orderkey") % 7) / 6) * 1000000000).alias("source_id"),
    )
    vectors = views.table(spark, d, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("id"), F.col("l_orderkey").alias("source_id")
    )
    return history.lineage({"image": images, "mask": masks, "vector": vectors})


@query("idempotent_ingest", ctes("edit_log") + """select event_id, ts, layer_id, idempotency_key from edit_log where trim(idempotency_key) = ''
union all select event_id, ts, layer_id, idempotency_key from (select *, row_number() over (partition by idempotency_key order by ts, event_id) as n
  from edit_log where trim(idempotency_key) <> '') where n = 1""")
def idempotent_ingest(spark, d):
    uploads = views.edit_log(spark, d).select("event_id", "ts", "layer_id", "idempotency_key")
    return history.idempotent_ingest(uploads, "idempotency_key", ["ts", "event_id"])


# --------------------------------------------------------------------- layers

@query("fold_edits", ctes("edit_log") + """, defaults as (select c_custkey as layer_id, 'unassigned' as operation, true as visible, c_name as name from customer)
, folded as (select layer_id,
  arg_max(operation, (ts, event_id)) filter (where operation is not null) as operation,
  arg_max(visible, (ts, event_id)) filter (where visible is not null) as visible,
  arg_max(name, (ts, event_id)) filter (where name is not null) as name from edit_log group by layer_id)
select layer_id, coalesce(f.operation, d.operation) as operation, coalesce(f.visible, d.visible) as visible,
  coalesce(f.name, d.name) as name from defaults d left join folded f using (layer_id)""")
def fold_edits(spark, d):
    defaults = views.table(spark, d, "customer").select(
        F.col("c_custkey").alias("layer_id"), F.lit("unassigned").alias("operation"), F.lit(True).alias("visible"),
        F.col("c_name").alias("name"),
    )
    return edits.fold_edits(defaults, views.edit_log(spark, d), "layer_id", ["operation", "visible", "name"], ["ts", "event_id"])


@query("accepted_edits", """with confirms as (select user_id as palette_id, min((ts, event_id)) as at from events where event_type = 'error' group by 1)
select event_id, user_id as palette_id, case when c.at is not null and (e.ts, e.event_id) > c.at then 'palette_confirmed' end as reason
  from events e left join confirms c on c.palette_id = e.user_id where event_type <> 'error'""")
def accepted_edits(spark, d):
    log = views.table(spark, d, "events").select("event_id", "ts", F.col("user_id").alias("palette_id"), "event_type")
    found = edits.accepted_edits(log.where("event_type <> 'error'"), log.where("event_type = 'error'"), "palette_id", ["ts", "event_id"])
    return found.select("event_id", "palette_id", "reason")


@query("confirm_palettes", """select c_custkey as palette_id,
  case when not exists (select 1 from orders where o_custkey = c_custkey) then 'empty_palette' end as reason from customer""")
def confirm_palettes(spark, d):
    requests = views.table(spark, d, "customer").select(F.col("c_custkey").alias("palette_id"))
    groups = views.table(spark, d, "orders").select(F.col("o_custkey").alias("palette_id"))
    return edits.confirm_palettes(requests, groups, "palette_id")


@query("filter_layers_by_operation", ctes("layers") + "select id, group_id, operation from layers where coalesce(operation,'unassigned') = 'unassigned'")
def filter_layers_by_operation(spark, d):
    return edits.filter_layers(views.layers(spark, d), "unassigned").select("id", "group_id", "operation")


@query("visible_layers", ctes("layers") + "select id, group_id from layers where coalesce(visible, true)")
def visible_layers(spark, d):
    return edits.visible_layers(views.layers(spark, d)).select("id", "group_id")


@query("ordered_layers", ctes("layers") + 'select version_id, id, "order", name from layers')
def ordered_layers(spark, d):
    return edits.ordered_layers(views.layers(spark, d)).select("version_id", "id", "order", "name")


@query("operation_summary", ctes("layers") + """select version_id, count(*) filter (where operation='cut') as cut,
  count(*) filter (where operation='engrave') as engrave, count(*) filter (where operation='ignore') as "ignore",
  count(*) filter (where operation is null) as unassigned, count(*) as total from layers group by version_id""")
def operation_summary(spark, d):
    return edits.operation_summary(views.layers(spark, d), "version_id")


@query("exploded_offsets", ctes("layers") + """select id, (row_number() over (partition by version_id order by "order", id) - 1) * cast(20.0 as double) as offset_x,
  (row_number() over (partition by version_id order by "order", id) - 1) * cast(20.0 as double) as offset_y from layers""")
def exploded_offsets(spark, d):
    return edits.exploded_offsets(views.layers(spark, d)).select("id", "offset_x", "offset_y")


_LAYER_SET = """with lset as (select cast(o_orderkey%1000 as bigint) as image_id, o_orderkey as group_id, o_orderkey%5 as idx,
  concat('Layer ', o_orderkey) as name, printf('#%06x', (o_orderkey*7919)%16777216) as color_hex, o_custkey as vector_id from orders)
, lay as (select l_orderkey%1000 as image_id, l_orderkey as group_id, min(l_linenumber) as "order", min(l_tax) < 0.03 as visible,
  max(l_tax) > 0.07 as locked, case when min(l_discount) < 0.01 then concat('N', l_orderkey) end as name from lineitem
  where l_shipdate > timestamp '1996-06-01' group by 1,2)
"""


def _layer_set(spark, d):
    return views.table(spark, d, "orders").select(
        (F.col("o_orderkey") % 1000).alias("image_id"), F.col("o_orderkey").alias("group_id"),
        (F.col("o_orderkey") % 5).cast("int").alias("index"),
        F.concat(F.lit("Layer "), F.col("o_orderkey").cast("string")).alias("name"),
        F.concat(F.lit("#"), F.lower(F.lpad(F.hex((F.col("o_orderkey") * 7919) % 16777216), 6, "0"))).alias("color_hex"),
        F.col("o_custkey").alias("vector_id"),
    )


def _layout(spark, d):
    rows = views.table(spark, d, "lineitem").where(F.col("l_shipdate") > F.lit("1996-06-01").cast("timestamp"))
    return rows.groupBy((F.col("l_orderkey") % 1000).alias("image_id"), F.col("l_orderkey").alias("group_id")).agg(
        F.min("l_linenumber").alias("order"), (F.min("l_tax") < 0.03).alias("visible"), (F.max("l_tax") > 0.07).alias("locked"),
        F.when(F.min("l_discount") < 0.01, F.concat(F.lit("N"), F.col("l_orderkey").cast("string"))).alias("name"),
    )


@query("resolve_layout", _LAYER_SET + """select l.image_id, l.group_id, coalesce(y."order", l.idx) as "order", coalesce(y.visible, true) as visible,
  coalesce(y.locked, false) as locked, y.name from lset l left join lay y using (image_id, group_id)""")
def resolve_layout(spark, d):
    return edits.resolve_layout(_layer_set(spark, d), _layout(spark, d), ["image_id", "group_id"])


@query("consolidated_layers", _LAYER_SET + """
, ops as (select l_orderkey as group_id, case when bool_or(l_returnflag='A') then 'cut' else 'engrave' end as operation
  from lineitem where l_returnflag in ('A','N') group by 1)
, comps as (select user_id as vector_id, count(*) as component_count from events group by 1)
, vecs as (select c_custkey as vector_id, cast(c_nationkey as int) as path_count from customer where c_custkey % 3 > 0)
select l.image_id, l.group_id, coalesce(y.name, l.name) as name, l.color_hex, l.color_hex as fill, l.vector_id,
  coalesce(v.path_count, 0) as path_count, c.component_count, coalesce(o.operation, 'unassigned') as operation,
  coalesce(y.visible, true) as visible, coalesce(y.locked, false) as locked, coalesce(y."order", l.idx) as "order"
from lset l left join lay y using (image_id, group_id) left join ops o on o.group_id = l.group_id
  left join comps c on c.vector_id = l.vector_id left join vecs v on v.vector_id = l.vector_id""")
def consolidated_layers(spark, d):
    operations = views.table(spark, d, "lineitem").where(F.col("l_returnflag").isin("A", "N")).groupBy(
        (F.col("l_orderkey") % 1000).alias("image_id"), F.col("l_orderkey").alias("group_id")
    ).agg(F.when(F.bool_or(F.col("l_returnflag") == "A"), "cut").otherwise("engrave").alias("operation"))
    counts = views.table(spark, d, "events").groupBy(F.col("user_id").alias("vector_id")).agg(F.count("*").alias("component_count"))
    vectors = views.table(spark, d, "customer").where("c_custkey % 3 > 0").select(
        F.col("c_custkey").alias("vector_id"), F.col("c_nationkey").alias("path_count")
    )
    return edits.consolidated_layers(_layer_set(spark, d), _layout(spark, d), operations, counts, vectors)


_REORDER = """, req as (select l_orderkey as image_id, array_agg(l_partkey order by l_linenumber, l_partkey) as ids from lineitem group by 1)
, cur as (select l_orderkey as image_id, array_agg(distinct l_partkey) as ids from lineitem where l_quantity > 2 group by 1)
"""


def _reorder(spark, d):
    items = views.table(spark, d, "lineitem")
    # an order has at most seven lines, so the request arrays are bounded
    requests = items.groupBy(F.col("l_orderkey").alias("image_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda s: s["l_partkey"]).alias("ids")
    )
    current = items.where("l_quantity > 2").select(F.col("l_orderkey").alias("image_id"), F.col("l_partkey").alias("group_id"))
    return edits.validate_reorder(requests, current, "image_id")


_REORDER_SQL = "with x as (select 1)" + _REORDER + """, checked as (select r.image_id, r.ids,
  case when c.ids is not null and len(r.ids) = len(c.ids) and len(list_distinct(r.ids)) = len(r.ids)
    and list_has_all(c.ids, r.ids) then null else 'invalid_parameters' end as reason from req r left join cur c using (image_id))
"""


@query("validate_reorder", _REORDER_SQL + "select image_id, array_to_string(ids, ',') as ids, reason from checked")
def validate_reorder(spark, d):
    return _reorder(spark, d).select(
        "image_id", F.array_join(F.transform("ids", lambda v: v.cast("string")), ",").alias("ids"), "reason"
    )


@query("reordered_layers", _REORDER_SQL + """select image_id, unnest(ids) as group_id,
  cast(generate_subscripts(ids, 1) - 1 as int) as "order" from checked where reason is null""")
def reordered_layers(spark, d):
    return edits.reordered(_reorder(spark, d), "image_id")


@query("move_layer", """with x as (select l_orderkey as image_id, array_agg(l_linenumber*1000+l_partkey order by l_linenumber, l_partkey) as ids,
  min(l_linenumber*1000+l_partkey) as source, max(l_linenumber*1000+l_partkey) - (l_orderkey%3)//2 as target from lineitem group by l_orderkey)
, y as (select *, list_filter(ids, lambda v: v <> source) as rest from x)
, z as (select *, list_position(rest, target) as spot from y)
select image_id, array_to_string(case when spot is not null and spot > 0 and source <> target
  then list_concat(list_concat(rest[1:spot-1], [source]), rest[spot:]) else ids end, ',') as ids from z""")
def move_layer(spark, d):
    code = (F.col("l_linenumber") * 1000 + F.col("l_partkey"))
    orders = views.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("image_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda s: s["l_linenumber"] * 1000 + s["l_partkey"]).alias("ids"),
        F.min(code).alias("source"), (F.max(code) - F.floor((F.col("l_orderkey") % 3) / 2)).alias("target"),
    )
    return edits.move_layer(orders).select("image_id", F.array_join(F.transform("ids", lambda v: v.cast("string")), ",").alias("ids"))


@query("missing_ids", "select distinct o_custkey as id from orders where o_custkey not in (select user_id from events)")
def missing_ids(spark, d):
    wanted = views.table(spark, d, "orders").select(F.col("o_custkey").alias("id"))
    return edits.missing_ids(wanted, views.table(spark, d, "events").select(F.col("user_id").alias("id")), ["id"])


_STALE = """with grp as (select o_orderkey as group_id, o_custkey as vector_id, o_orderkey%3 as analysis_id,
  [concat('component-', o_orderkey%4+1), concat('component-', o_orderkey%4+2)] as ids from orders)
, ana as (select c_custkey as vector_id, c_custkey%3 as analysis_id from customer where c_custkey%10 > 0)
, comp as (select c_custkey as vector_id, concat('component-', n) as component_id from customer
  cross join (select unnest([1,2,3,4]) as n) where c_custkey%10 > 0)
, mem as (select group_id, vector_id, unnest(ids) as component_id, generate_subscripts(ids,1) as pos from grp)
, gone as (select group_id, string_agg(component_id, ',' order by pos) as missing from mem m
  where not exists (select 1 from comp c where c.vector_id=m.vector_id and c.component_id=m.component_id) group by 1)
"""


@query("group_staleness", _STALE + """select g.vector_id, g.group_id, a.analysis_id is null or a.analysis_id <> g.analysis_id or n.missing is not null as is_stale,
  coalesce(n.missing, '') as missing_ids from grp g left join ana a using (vector_id) left join gone n using (group_id)""")
def group_staleness(spark, d):
    key = F.col("o_orderkey")
    name = lambda n: F.concat(F.lit("component-"), (key % 4 + n).cast("string"))
    groups = views.table(spark, d, "orders").select(
        key.alias("group_id"), F.col("o_custkey").alias("vector_id"), (key % 3).alias("analysis_id"),
        F.array(name(1), name(2)).alias("component_ids"),
    )
    vectors = views.table(spark, d, "customer").where("c_custkey % 10 > 0").select(F.col("c_custkey").alias("vector_id"))
    analyses = vectors.withColumn("analysis_id", F.col("vector_id") % 3)
    components = vectors.select(
        "vector_id", F.explode(F.array(*[F.lit(f"component-{n}") for n in (1, 2, 3, 4)])).alias("component_id")
    )
    found = edits.group_staleness(groups, analyses, components)
    return found.withColumn("missing_ids", F.array_join("missing_ids", ","))


@query("group_components", """with ev as (select event_id, ts, user_id as vector_id, user_id*10 + event_id%3 as group_id,
  case when event_type in ('view','click') then 'create' when event_type in ('signup','error') then 'rename' else 'ungroup' end as action,
  case when value > 8 then concat(' G', event_id, ' ') else '' end as name, event_id%4+1 as a, event_id%5+1 as b from events)
, firsts as (select * from (select *, row_number() over (partition by vector_id, group_id order by ts, event_id) as n from ev where action='create') where n = 1)
, valid as (select * from firsts where a <> b and a <= 4 and b <= 4)
, ended as (select v.vector_id, v.group_id, min((u.ts, u.event_id)) as e from valid v join ev u
    on u.vector_id=v.vector_id and u.group_id=v.group_id and u.action='ungroup' and (u.ts,u.event_id) > (v.ts,v.event_id) group by 1,2)
, life as (select v.*, e.e from valid v left join ended e using (vector_id, group_id))
, live as (select l.vector_id, l.group_id, count(*) as n from life l join life o on o.vector_id=l.vector_id
    and (o.ts,o.event_id) <= (l.ts,l.event_id) and (o.e is null or o.e > (l.ts,l.event_id)) group by 1,2)
, ren as (select l.vector_id, l.group_id, arg_max(trim(u.name), (u.ts,u.event_id)) as name from life l join ev u
    on u.vector_id=l.vector_id and u.group_id=l.group_id and u.action='rename' and trim(u.name) <> ''
    and (u.ts,u.event_id) > (l.ts,l.event_id) group by 1,2)
select l.vector_id, l.group_id, coalesce(ren.name, nullif(trim(l.name),''), concat('Grupo ', live.n)) as name,
  concat('component-', a, ',component-', b) as component_ids from life l join live using (vector_id, group_id)
  left join ren using (vector_id, group_id) where l.e is null""")
def group_components(spark, d):
    key, kind = F.col("event_id"), F.col("event_type")
    name = lambda n: F.concat(F.lit("component-"), n.cast("string"))
    log = views.table(spark, d, "events").select(
        "event_id", "ts", F.col("user_id").alias("vector_id"), (F.col("user_id") * 10 + key % 3).alias("group_id"),
        F.when(kind.isin("view", "click"), "create").when(kind.isin("signup", "error"), "rename").otherwise("ungroup").alias("action"),
        F.when(F.col("value") > 8, F.concat(F.lit(" G"), key.cast("string"), F.lit(" "))).otherwise("").alias("name"),
        F.array(name(key % 4 + 1), name(key % 5 + 1)).alias("component_ids"), F.lit(1).alias("analysis_id"),
    )
    # a group id is created once: later creations of the same id are no edits of it
    first = log.where("action = 'create'").groupBy("vector_id", "group_id").agg(F.min(F.struct("ts", "event_id")).alias("_f"))
    log = log.join(first, ["vector_id", "group_id"], "left").where(
        (F.col("action") != "create") | (F.struct("ts", "event_id") == F.col("_f"))
    ).drop("_f")
    vectors = views.table(spark, d, "events").select(F.col("user_id").alias("vector_id")).distinct()
    components = vectors.select("vector_id", F.explode(F.array(*[F.lit(f"component-{n}") for n in (1, 2, 3, 4)])).alias("component_id"))
    return edits.apply_group_edits(log, components, ["ts", "event_id"]).select(
        "vector_id", "group_id", "name", F.array_join("component_ids", ",").alias("component_ids")
    )


# ------------------------------------------------------------------ catalogue

def _catalog(spark, d):
    """Customers are projects with one document, orders its versions, lines the layers."""
    orders = views.table(spark, d, "orders")
    stats = orders.groupBy("o_custkey").agg(
        F.max("o_orderkey").alias("current_version_id"), F.min("o_orderdate").alias("created_at"), F.max("o_orderdate").alias("updated_at")
    )
    projects = views.table(spark, d, "customer").join(stats, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("owner_id"), F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("description"), "current_version_id", "created_at", "updated_at",
        F.when(F.col("c_acctbal") < 0, F.lit("1999-01-01").cast("timestamp")).alias("deleted_at"),
    )
    documents = projects.select(F.col("id"), F.col("id").alias("project_id"))
    versions = orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("document_id"),
        (F.floor(F.col("o_orderkey") / 10) + 1).cast("int").alias("version_number"),
        (F.col("o_orderkey") % 300 + 1).cast("double").alias("width_mm"), (F.col("o_orderkey") % 200 + 1).cast("double").alias("height_mm"),
        F.lit("0 0 100 100").alias("view_box"), F.lit(1).alias("schema_version"),
        F.when(F.col("o_orderstatus") == "F", "VECTORIZE").when(F.col("o_orderstatus") == "P", "PLAN").otherwise("MANUAL_EDIT").alias("origin"),
        F.lit("{}").alias("metadata_json"), F.col("o_orderdate").alias("created_at"),
    )
    layers = views.layers(spark, d).withColumns({"color_id": F.col("id"), "svg_asset_id": F.concat(F.lit("asset-"), F.col("id"))})
    items = views.table(spark, d, "lineitem")
    colors = items.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.col("l_orderkey").alias("version_id"),
        F.concat(F.lit("#"), F.lower(F.lpad(F.hex((F.col("l_partkey") * 7919) % 16777216), 6, "0"))).alias("hex"),
        F.col("l_discount").alias("coverage"), (F.col("l_linenumber") == 1).alias("is_background"), F.col("l_linenumber").alias("order"),
    )
    return {"projects": projects, "documents": documents, "versions": versions, "layers": layers, "colors": colors}


_CAT = ctes("layers") + """
, stats as (select o_custkey, max(o_orderkey) as current_version_id, min(o_orderdate) as created_at, max(o_orderdate) as updated_at from orders group by 1)
, cprojects as (select c_custkey as id, c_nationkey as owner_id, c_name as name, c_mktsegment as description, current_version_id, created_at, updated_at,
  case when c_acctbal < 0 then timestamp '1999-01-01' end as deleted_at from customer left join stats on o_custkey = c_custkey)
, cversions as (select o_orderkey as id, o_custkey as document_id, cast(floor(o_orderkey/10)+1 as int) as version_number,
  cast(o_orderkey%300+1 as double) as width_mm, cast(o_orderkey%200+1 as double) as height_mm, '0 0 100 100' as view_box, 1 as schema_version,
  case o_orderstatus when 'F' then 'VECTORIZE' when 'P' then 'PLAN' else 'MANUAL_EDIT' end as origin, '{}' as metadata_json, o_orderdate as created_at from orders)
, clayers as (select * exclude (color_id), id as color_id, concat('asset-', id) as svg_asset_id from layers)
, ccolors as (select concat(l_orderkey,'-',l_linenumber) as id, l_orderkey as version_id, printf('#%06x', (l_partkey*7919)%16777216) as hex,
  l_discount as coverage, l_linenumber = 1 as is_background, l_linenumber as "order" from lineitem)
"""


@query("load_catalog", _CAT + """select 'users' as name, cast(n_nationkey as varchar) as id, n_name as detail from nation
  union all select 'projects', cast(id as varchar), concat_ws('|', name, description, current_version_id, case when deleted_at is not null then 'deleted' end) from cprojects
  union all select 'assets', cast(p_partkey as varchar), p_type from part
  union all select 'documents', cast(id as varchar), cast(id as varchar) from cprojects
  union all select 'versions', cast(id as varchar), concat_ws('|', document_id, version_number, origin) from cversions
  union all select 'layers', cast(id as varchar), svg_asset_id from clayers
  union all select 'colors', id, hex from ccolors""")
def load_catalog(spark, d):
    """All seven tables written, loaded again and listed, deleted projects included."""
    tables = _catalog(spark, d)
    tables["users"] = views.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    tables["assets"] = views.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("type"))
    folder = run_dir(spark, "catalog")
    for name, table in tables.items():
        table.write.parquet(f"{folder}/{name}")
    gone = F.when(F.col("deleted_at").isNotNull(), "deleted")
    details = {
        "users": F.col("name"), "assets": F.col("type"), "documents": F.col("project_id").cast("string"), "layers": F.col("svg_asset_id"), "colors": F.col("hex"),
        "projects": F.concat_ws("|", "name", "description", F.col("current_version_id").cast("string"), gone),
        "versions": F.concat_ws("|", F.col("document_id").cast("string"), F.col("version_number").cast("string"), "origin"),
    }
    rows = [t.select(F.lit(name).alias("name"), F.col("id").cast("string").alias("id"), details[name].alias("detail")) for name, t in files.load_catalog(spark, folder).items()]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


@query("list_projects", ctes("projects") + """, found as (select * from projects where deleted_at is null and name ilike '%urg%')
select id, owner_id, name, created_at, updated_at, deleted_at, (select count(*) from found) as total_count
  from found order by updated_at desc, id limit 100 offset 100""")
def list_projects(spark, d):
    return catalog.list_projects(views.projects(spark, d), search=" urg ", page=2, size=500)


@query("list_projects_deep", ctes("projects") + """, found as (select * from projects where deleted_at is null)
select id, owner_id, name, created_at, updated_at, deleted_at, (select count(*) from found) as total_count
  from found order by updated_at desc, id limit 100 offset (select cast(floor(count(*) / 200) * 100 as bigint) from found)""")
def list_projects_deep(spark, d):
    """The page in the middle of all live projects, found by numbered ranges."""
    rows = views.projects(spark, d)
    return catalog.list_projects(rows, page=catalog.live_projects(rows).count() // 200 + 1, size=100, deep=0)


@query("list_projects_after", ctes("projects") + """, found as (select * from projects where deleted_at is null)
select id, owner_id, name, created_at, updated_at, deleted_at, (select count(*) from found) as total_count
  from found order by name, id limit 100 offset 100""")
def list_projects_after(spark, d):
    """The second page by name, asked for by the last row of the first."""
    rows = views.projects(spark, d)
    last = catalog.list_projects(rows, sort="name", size=100).collect()[-1]
    return catalog.list_projects(rows, sort="name", size=100, after=(last["name"], last["id"]))


@query("list_versions", _CAT + "select id, document_id, version_number, width_mm, height_mm, origin, created_at from cversions")
def list_versions(spark, d):
    return catalog.list_versions(_catalog(spark, d)["versions"])


@query("create_projects", ctes("projects") + f"""select * from projects union all
  select 10000000 + c_custkey, c_nationkey, trim(c_name), {NOW}, {NOW}, null from customer where trim(c_name) <> ''""")
def create_projects(spark, d):
    requests = views.table(spark, d, "customer").select(
        (F.col("c_custkey") + 10000000).alias("id"), F.col("c_nationkey").alias("owner_id"),
        F.concat(F.lit("  "), "c_name").alias("name"),
    )
    return catalog.create_projects(views.projects(spark, d), requests, _now())[0]


_REQUESTS = """with r as (select c_custkey as id, case c_custkey % 4 when 0 then chr(9) || chr(10) when 1 then repeat('x', 201) else chr(9) || c_name end as name,
  case when c_custkey % 5 = 0 then repeat('d', 2001) else repeat(' ', 2000) end as description from customer)
"""


@query("refused_projects", _REQUESTS + """select id, case when id % 4 in (0, 1) then 'invalid_name' else 'invalid_description' end as reason from r where id % 4 in (0, 1) or id % 5 = 0""")
def refused_projects(spark, d):
    """Requests with a name of white space only, too long a name or description, and why they are refused."""
    key = F.col("c_custkey")
    name = F.when(key % 4 == 0, "\t\n").when(key % 4 == 1, "x" * 201).otherwise(F.concat(F.lit("\t"), "c_name"))
    requests = views.table(spark, d, "customer").select(
        key.alias("id"), F.col("c_nationkey").alias("owner_id"), name.alias("name"),
        F.when(key % 5 == 0, "d" * 2001).otherwise(" " * 2000).alias("description"),
    )
    return catalog.create_projects(views.projects(spark, d), requests, _now())[1]


@query("update_projects", ctes("projects") + f""", patches as (select l_orderkey as id, min(case when l_tax > 0.04 then concat('P', l_partkey) end) as name
  from lineitem where l_returnflag='R' group by 1)
select p.id, p.owner_id, case when deleted_at is null then coalesce(t.name, p.name) else p.name end as name, p.created_at,
  case when t.id is not null and deleted_at is null then {NOW} else p.updated_at end as updated_at, p.deleted_at
  from projects p left join patches t using (id)""")
def update_projects(spark, d):
    patches = views.table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.min(F.when(F.col("l_tax") > 0.04, F.concat(F.lit("P"), F.col("l_partkey").cast("string")))).alias("name")
    )
    return catalog.update_projects(views.projects(spark, d), patches, ["name"], _now())


@query("update_projects_in_order", ctes("projects") + f""", patches as (select l_orderkey as id,
    (max(struct_pack(n := l_linenumber, v := concat('P', l_partkey))) filter (where l_tax > 0.04)).v as name, (max(struct_pack(n := l_linenumber, v := l_suppkey)) filter (where l_discount < 0.03)).v as owner_id from lineitem group by 1)
select p.id, case when deleted_at is null then coalesce(t.owner_id, p.owner_id) else p.owner_id end as owner_id, case when deleted_at is null then coalesce(t.name, p.name) else p.name end as name, p.created_at,
  case when t.id is not null and deleted_at is null then {NOW} else p.updated_at end as updated_at, p.deleted_at from projects p left join patches t using (id)""")
def update_projects_in_order(spark, d):
    """Several patches of a project, line by line: of each field the last one that sets it."""
    patches = views.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("id"), "l_linenumber", F.when(F.col("l_tax") > 0.04, F.concat(F.lit("P"), F.col("l_partkey").cast("string"))).alias("name"),
        F.when(F.col("l_discount") < 0.03, F.col("l_suppkey")).alias("owner_id"))
    return catalog.update_projects(views.projects(spark, d), patches, ["name", "owner_id"], _now(), order=["l_linenumber"])


@query("soft_delete", ctes("projects") + f""", ids as (select distinct l_orderkey as id from lineitem where l_returnflag='A')
select p.id, owner_id, name, created_at, case when ids.id is not null and deleted_at is null then {NOW} else updated_at end as updated_at,
  case when ids.id is not null and deleted_at is null then {NOW} else deleted_at end as deleted_at from projects p left join ids using (id)""")
def soft_delete(spark, d):
    ids = views.table(spark, d, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("id"))
    return catalog.soft_delete(views.projects(spark, d), ids, _now())


@query("delete_assets", """select l_partkey as id, l_orderkey as project_id from lineitem where l_partkey not in (select p_partkey from part where p_size > 25)""")
def delete_assets(spark, d):
    assets = views.table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("project_id"))
    gone = views.table(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("id"))
    return catalog.delete_assets(assets, gone)


_COPY_MAP = """, vmap as (select id as old_version, sha256(concat(id, '|copy')) as new_version, document_id from cversions
  where document_id in (select id from cprojects where deleted_at is null))
"""


@query("duplicate_projects", _CAT + _COPY_MAP + f"""select sha256(concat(p.id,'|copy')) as id, p.owner_id, concat('Copia de ', p.name) as name, p.description,
  cast(null as varchar) as thumbnail_asset_id, m.new_version as current_version_id, {NOW} as created_at, {NOW} as updated_at, cast(null as timestamp) as deleted_at
  from cprojects p left join vmap m on m.old_version = p.current_version_id where p.deleted_at is null""")
def duplicate_projects(spark, d):
    cat = _catalog(spark, d)
    return catalog.duplicate_projects(cat, cat["projects"].select("id"), _now())["projects"]


@query("duplicate_project_layers", _CAT + _COPY_MAP + """select sha256(concat(l.id,'|',m.new_version,'|copy')) as id, l.group_id, m.new_version as version_id,
  sha256(concat(l.color_id,'|',m.new_version,'|copy')) as color_id, l.name, l."order", l.visible, l.locked, l.operation,
  cast(null as varchar) as svg_asset_id, cast(null as int) as path_count from clayers l join vmap m on m.old_version = l.version_id""")
def duplicate_project_layers(spark, d):
    cat = _catalog(spark, d)
    return catalog.duplicate_projects(cat, cat["projects"].select("id"), _now())["layers"]


@query("duplicate_project_versions", _CAT + _COPY_MAP + f"""select sha256(concat(v.id,'|copy')) as id, sha256(concat(v.document_id,'|copy')) as document_id,
  sha256(concat(p.id,'|copy')) as project_id, v.version_number, v.width_mm, v.height_mm, v.view_box, v.schema_version, v.origin, v.metadata_json, {NOW} as created_at
  from cversions v join cprojects p on p.id = v.document_id where p.deleted_at is null""")
def duplicate_project_versions(spark, d):
    """Copied versions with the copied document and project they hang on; copies of deleted projects are not made."""
    cat = _catalog(spark, d)
    made = catalog.duplicate_projects(cat, cat["projects"].select("id"), _now())
    docs = made["documents"].withColumnRenamed("id", "document_id")
    return made["versions"].join(docs, "document_id").select(
        "id", "document_id", "project_id", "version_number", "width_mm", "height_mm", "view_box", "schema_version", "origin", "metadata_json", "created_at")


@query("duplicate_project_colors", _CAT + _COPY_MAP + """select sha256(concat(c.id,'|',m.new_version,'|copy')) as id, m.new_version as version_id, c.hex, c.coverage, c.is_background, c."order"
  from ccolors c join vmap m on m.old_version = c.version_id""")
def duplicate_project_colors(spark, d):
    cat = _catalog(spark, d)
    return catalog.duplicate_projects(cat, cat["projects"].select("id"), _now())["colors"].select("id", "version_id", "hex", "coverage", "is_background", "order")


_RESTORE = """, nexts as (select document_id, max(version_number)+1 as next_number from cversions group by 1)
, req as (select o_custkey as project_id, min(cast(floor(o_orderkey/10)+1 as int)) as version_number from orders group by 1)
, src as (select v.*, n.next_number, sha256(concat(v.id,'|',n.next_number,'|restore')) as new_id from cversions v join nexts n using (document_id)
  join req r on r.project_id = v.document_id and r.version_number = v.version_number
  where v.document_id in (select id from cprojects where deleted_at is null))
"""


def _restore(spark, d):
    cat = _catalog(spark, d)
    requests = cat["versions"].groupBy(F.col("document_id").alias("project_id")).agg(F.min("version_number").alias("version_number"))
    return catalog.restore_version(cat, requests, _now())


@query("restore_version", _CAT + _RESTORE + f"""select new_id as id, document_id, next_number as version_number, width_mm, height_mm, view_box, schema_version,
  'RESTORE' as origin, concat('{{"restoredFromVersion":', version_number, '}}') as metadata_json, {NOW} as created_at from src""")
def restore_version(spark, d):
    return _restore(spark, d)["versions"]


@query("restore_version_layers", _CAT + _RESTORE + """select sha256(concat(l.id,'|',s.new_id,'|restore')) as id, l.group_id, s.new_id as version_id,
  sha256(concat(l.color_id,'|',s.new_id,'|restore')) as color_id, l.name, l."order", l.visible, l.locked, l.operation, l.svg_asset_id, l.path_count
  from clayers l join src s on s.id = l.version_id""")
def restore_version_layers(spark, d):
    return _restore(spark, d)["layers"]


@query("metadata_json", _CAT + _RESTORE + "select new_id as id, cast(version_number as int) as restored_from from src")
def metadata_json(spark, d):
    return _restore(spark, d)["versions"].select(
        "id", F.get_json_object("metadata_json", "$.restoredFromVersion").cast("int").alias("restored_from")
    )


_SAVE = """, nexts as (select document_id, max(version_number)+1 as next_number from cversions group by 1)
, snap as (select c_custkey as document_id, case when c_nationkey % 2 = 0 then cast(c_nationkey + 10.5 as double) end as width_mm,
  case when c_nationkey % 2 = 0 then cast(c_nationkey + 20.5 as double) end as height_mm, 640 as width_px, 480 as height_px,
  coalesce(next_number, 1) as version_number from customer left join nexts on document_id = c_custkey)
, snew as (select *, sha256(concat(document_id,'|',version_number,'|save')) as id from snap)
, rows_ as (select o_custkey as document_id, o_orderkey as group_id, concat('L', o_orderkey) as name, cast(o_orderkey%9 as int) as "order",
  o_orderstatus <> 'P' as visible, false as locked, case o_orderstatus when 'F' then 'cut' end as operation, cast(null as varchar) as svg_asset_id,
  cast(o_orderkey%50 as int) as path_count, '#102030' as color_hex, cast(1.5 as double) as area_percent, o_orderstatus = 'F' as is_excluded from orders)
"""


def _save(spark, d):
    even = F.col("c_nationkey") % 2 == 0
    snapshots = views.table(spark, d, "customer").select(
        F.col("c_custkey").alias("project_id"), F.col("c_custkey").alias("document_id"),
        F.when(even, F.col("c_nationkey") + 10.5).alias("width_mm"), F.when(even, F.col("c_nationkey") + 20.5).alias("height_mm"),
        F.lit(640).alias("width_px"), F.lit(480).alias("height_px"),
    )
    key = F.col("o_orderkey")
    rows = views.table(spark, d, "orders").select(
        F.col("o_custkey").alias("document_id"), key.alias("group_id"), F.concat(F.lit("L"), key.cast("string")).alias("name"),
        (key % 9).cast("int").alias("order"), (F.col("o_orderstatus") != "P").alias("visible"), F.lit(False).alias("locked"),
        F.when(F.col("o_orderstatus") == "F", "cut").alias("operation"), F.lit(None).cast("string").alias("svg_asset_id"),
        (key % 50).cast("int").alias("path_count"), F.lit("#102030").alias("color_hex"), F.lit(1.5).alias("area_percent"),
        (F.col("o_orderstatus") == "F").alias("is_excluded"),
    )
    return catalog.save_checkpoint(_catalog(spark, d), snapshots, rows, _now())


@query("save_checkpoint", _CAT + _SAVE + f"""select id, document_id, version_number, coalesce(width_mm, width_px) as width_mm,
  coalesce(height_mm, height_px) as height_mm, '0 0 640 480' as view_box, 1 as schema_version, 'MANUAL_EDIT' as origin, '{{}}' as metadata_json,
  {NOW} as created_at from snew""")
def save_checkpoint(spark, d):
    return _save(spark, d)["versions"]


@query("save_checkpoint_layers", _CAT + _SAVE + """select sha256(concat(s.id,'|',r.group_id,'|layer')) as id, r.group_id, s.id as version_id,
  sha256(concat(s.id,'|',r.group_id,'|color')) as color_id, r.name, r."order", r.visible, r.locked, r.operation, r.svg_asset_id, r.path_count
  from rows_ r join snew s using (document_id)""")
def save_checkpoint_layers(spark, d):
    return _save(spark, d)["layers"]


@query("save_checkpoint_colors", _CAT + _SAVE + """select sha256(concat(s.id,'|',r.group_id,'|color')) as id, s.id as version_id, r.color_hex as hex,
  r.area_percent as coverage, r.is_excluded as is_background,
  cast(row_number() over (partition by s.id order by r."order", r.group_id) - 1 as int) as "order" from rows_ r join snew s using (document_id)""")
def save_checkpoint_colors(spark, d):
    return _save(spark, d)["colors"]


@query("current_document", _CAT + """select v.id, p.id as project_id, v.version_number, v.origin from cversions v
  join cprojects p on p.current_version_id = v.id where p.deleted_at is null""")
def current_document(spark, d):
    return catalog.current_document(_catalog(spark, d)).select("id", "project_id", "version_number", "origin")


@query("patch_layers", _CAT + """, patches as (select p_partkey as group_id, c_custkey as project_id, case when p_size < 20 then p_name end as name,
  p_size % 2 = 0 as visible, p_size % 3 = 0 as touch, case when p_size % 6 = 0 then 'engrave' end as operation
  from part join customer on c_custkey = p_partkey)
, target as (select t.*, p.current_version_id as version_id from patches t join cprojects p on p.id = t.project_id where p.deleted_at is null)
select l.id, l.group_id, l.version_id, coalesce(t.name, l.name) as name, l."order", coalesce(t.visible, l.visible) as visible, l.locked,
  case when t.touch then t.operation else l.operation end as operation from clayers l left join target t using (version_id, group_id)""")
def patch_layers(spark, d):
    size = F.col("p_size")
    patches = views.table(spark, d, "part").join(views.table(spark, d, "customer"), F.col("c_custkey") == F.col("p_partkey")).select(
        F.col("c_custkey").alias("project_id"), F.col("p_partkey").alias("group_id"), F.when(size < 20, F.col("p_name")).alias("name"),
        F.lit(None).cast("int").alias("order"), (size % 2 == 0).alias("visible"), F.lit(None).cast("boolean").alias("locked"),
        (size % 3 == 0).alias("touch_operation"), F.when(size % 6 == 0, "engrave").alias("operation"),
    )
    return catalog.patch_layers(_catalog(spark, d), patches).select(
        "id", "group_id", "version_id", "name", "order", "visible", "locked", "operation"
    )


@query("patch_layers_in_order", _CAT + """, steps as (select p_partkey as group_id, c_custkey as project_id, l_orderkey*8+l_linenumber as step, case when l_tax > 0.04 then concat('N', l_orderkey) end as name,
  case when l_discount < 0.05 then l_quantity > 25 end as visible, l_linestatus = 'F' as touch, case when l_returnflag = 'R' then 'engrave' when l_returnflag = 'A' then 'cut' end as operation
  from part join customer on c_custkey = p_partkey join lineitem on l_partkey = p_partkey)
, patches as (select project_id, group_id, (max(struct_pack(n := step, v := name)) filter (where name is not null)).v as name, (max(struct_pack(n := step, v := visible)) filter (where visible is not null)).v as visible,
  bool_or(touch) as touch, max(struct_pack(s := step, o := operation)) filter (where touch) as op from steps group by 1,2)
, target as (select t.*, p.current_version_id as version_id from patches t join cprojects p on p.id = t.project_id where p.deleted_at is null)
select l.id, l.group_id, l.version_id, coalesce(t.name, l.name) as name, coalesce(t.visible, l.visible) as visible, case when t.touch then t.op.o else l.operation end as operation
  from clayers l left join target t using (version_id, group_id)""")
def patch_layers_in_order(spark, d):
    """Several patches of a layer: one renames, another hides, a third clears the operation; all take effect, the later of two values wins."""
    lines = views.table(spark, d, "lineitem")
    steps = views.table(spark, d, "part").join(views.table(spark, d, "customer"), F.col("c_custkey") == F.col("p_partkey")).join(lines, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("c_custkey").alias("project_id"), F.col("p_partkey").alias("group_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("step"),
        F.when(F.col("l_tax") > 0.04, F.concat(F.lit("N"), F.col("l_orderkey").cast("string"))).alias("name"), F.lit(None).cast("int").alias("order"),
        F.when(F.col("l_discount") < 0.05, F.col("l_quantity") > 25).alias("visible"), F.lit(None).cast("boolean").alias("locked"), (F.col("l_linestatus") == "F").alias("touch_operation"),
        F.when(F.col("l_returnflag") == "R", "engrave").when(F.col("l_returnflag") == "A", "cut").alias("operation"))
    return catalog.patch_layers(_catalog(spark, d), steps, order=["step"]).select("id", "group_id", "version_id", "name", "visible", "operation")


@query("document_graph", _CAT + """select v.id, v.document_id, v.version_number, count(l.id) as layer_count,
  coalesce(string_agg(case when l.id is not null then concat_ws(':', l."order", l.group_id, coalesce(l.operation,'-'), c.hex) end, ';' order by l."order", l.id, l.group_id, l.visible nulls first, l.locked, l.operation nulls first, c.hex), '') as layers
  from cversions v left join (clayers l join ccolors c on c.id = l.color_id) on l.version_id = v.id group by 1,2,3""")
def document_graph(spark, d):
    cat = _catalog(spark, d)
    graph = catalog.document_graph(cat["versions"], cat["layers"], cat["colors"])
    text = F.transform("layers", lambda s: F.concat_ws(
        ":", s["order"].cast("string"), s["group_id"].cast("string"), F.coalesce(s["operation"], F.lit("-")), s["hex"]
    ))
    return graph.select(
        "id", "document_id", "version_number", F.size("layers").cast("long").alias("layer_count"), F.array_join(text, ";").alias("layers")
    )


@query("integrity_check", _CAT + """
select 'layer_key' as rule, concat(version_id,'|',group_id) as key, count(*) as n from clayers group by version_id, group_id having count(*) > 1
union all select 'version_key', concat(document_id,'|',version_number), count(*) from cversions group by document_id, version_number having count(*) > 1
union all select 'version_document', cast(document_id as varchar), count(*) from cversions where document_id not in (select id from cprojects) group by document_id
union all select 'layer_version', cast(version_id as varchar), count(*) from clayers where version_id not in (select id from cversions) group by version_id
union all select 'layer_color', color_id, count(*) from clayers where color_id not in (select id from ccolors) group by color_id
union all select 'color_version', cast(version_id as varchar), count(*) from ccolors where version_id not in (select id from cversions) group by version_id
union all select 'project_owner', cast(owner_id as varchar), count(*) from cprojects where owner_id >= 20 group by owner_id
union all select 'project_version', cast(current_version_id as varchar), count(*) from cprojects where current_version_id not in (select id from cversions) group by current_version_id
union all select 'asset_project', cast(p_partkey as varchar), 1 from part where p_partkey not in (select id from cprojects)
union all select 'document_project', cast(id as varchar), 1 from cprojects where false
union all select 'version_asset', concat('asset-', id), 1 from cversions where id not in (select p_partkey from part)
union all select 'layer_asset', svg_asset_id, count(*) from clayers where svg_asset_id not in (select concat('asset-', p_partkey) from part) group by svg_asset_id
union all select 'version_origin', origin, count(*) from cversions where origin not in ('VECTORIZE','MANUAL_EDIT','AUTOSAVE','RESTORE','AI_EDIT') group by origin""")
def integrity_check(spark, d):
    tables = _catalog(spark, d)
    tables["users"] = views.table(spark, d, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("id"))
    part = views.table(spark, d, "part")
    tables["assets"] = part.select(F.concat(F.lit("asset-"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_partkey").alias("project_id"))
    tables["versions"] = tables["versions"].withColumn("svg_asset_id", F.concat(F.lit("asset-"), F.col("id").cast("string")))
    return catalog.integrity_check(tables)


@query("touch_updated_at", ctes("projects") + f"select id, {NOW} as updated_at from projects where deleted_at is null")
def touch_updated_at(spark, d):
    rows = catalog.live_projects(views.projects(spark, d))
    return catalog.update_projects(rows, rows.select("id"), [], _now()).select("id", "updated_at")
