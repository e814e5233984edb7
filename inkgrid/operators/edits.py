"""Layer state: edit logs, layouts, orders, operations, logical groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgrid.functions import text
from inkgrid.operators.history import running_total


def fold_edits(defaults: DataFrame, edits: DataFrame, key: str, fields: list[str], order: list[str]) -> DataFrame:
    """Defaults overlaid with the last non-null value of each field."""
    stamp = F.struct(*order)
    last = edits.groupBy(key).agg(*[
        F.max(F.when(F.col(f).isNotNull(), F.struct(stamp.alias("at"), F.col(f).alias("value")))).alias(f"_{f}")
        for f in fields
    ])
    kept = [F.coalesce(F.col(f"_{f}.value"), F.col(f)).alias(f) if f in fields else F.col(f) for f in defaults.columns]
    return defaults.join(last, key, "left").select(*kept)


def accepted_edits(edits: DataFrame, confirms: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Edits with ``reason`` palette_confirmed when they arrive after the first confirmation."""
    first = confirms.groupBy(key).agg(F.min(F.struct(*order)).alias("_confirmed"))
    late = F.col("_confirmed").isNotNull() & (F.struct(*order) > F.col("_confirmed"))
    return edits.join(first, key, "left").select(*edits.columns, F.when(late, "palette_confirmed").alias("reason"))


def confirm_palettes(requests: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Confirmation requests; palettes without any group cannot be confirmed."""
    filled = groups.select(key, F.lit(True).alias("_filled")).distinct()
    return requests.join(filled, key, "left").select(
        *requests.columns, F.when(F.col("_filled").isNull(), "empty_palette").alias("reason")
    )


def filter_layers(layers: DataFrame, operation: str) -> DataFrame:
    if operation == "all":
        return layers
    return layers.where(F.coalesce("operation", F.lit("unassigned")) == operation)


def visible_layers(layers: DataFrame, isolate: Column | None = None) -> DataFrame:
    """Visible layers (unknown counts as visible), or only the isolated group."""
    return layers.where(isolate if isolate is not None else F.coalesce("visible", F.lit(True)))


def ordered_layers(layers: DataFrame) -> DataFrame:
    return layers.orderBy("version_id", "order", "id")


def operation_summary(layers: DataFrame, key: str) -> DataFrame:
    op = F.coalesce("operation", F.lit("unassigned"))
    return layers.groupBy(key).agg(
        *[F.count_if(op == name).alias(name) for name in ("cut", "engrave", "ignore", "unassigned")],
        F.count("*").alias("total"),
    )


def resolve_layout(layers: DataFrame, layout: DataFrame, key: list[str]) -> DataFrame:
    """One entry per current layer: its saved one, or index order, visible, unlocked, unnamed."""
    saved = layout.select(*key, *[F.col(c).alias(f"_{c}") for c in ("order", "visible", "locked", "name")])
    return layers.join(saved, key, "left").select(
        *key, F.coalesce("_order", "index").alias("order"), F.coalesce("_visible", F.lit(True)).alias("visible"),
        F.coalesce("_locked", F.lit(False)).alias("locked"), F.col("_name").alias("name"),
    )


def consolidated_layers(
    layers: DataFrame, layout: DataFrame, operations: DataFrame, component_counts: DataFrame, vectors: DataFrame
) -> DataFrame:
    """Layers with layout, operation, component count and path count; all sides optional."""
    key = ["image_id", "group_id"]
    entries = resolve_layout(layers, layout, key).withColumnRenamed("name", "layout_name")
    return (
        layers.join(entries, key)
        .join(operations.select(*key, "operation"), key, "left")
        .join(component_counts.select("vector_id", "component_count"), "vector_id", "left")
        .join(vectors.select("vector_id", "path_count"), "vector_id", "left")
        .select(
            *key, F.coalesce("layout_name", "name").alias("name"), "color_hex", F.col("color_hex").alias("fill"),
            "vector_id", F.coalesce("path_count", F.lit(0)).alias("path_count"), "component_count",
            F.coalesce("operation", F.lit("unassigned")).alias("operation"), "visible", "locked", "order",
        )
    )


def validate_reorder(requests: DataFrame, layers: DataFrame, key: str) -> DataFrame:
    """Requested orders (``ids`` array) must be an exact permutation of the current layer ids."""
    current = layers.groupBy(key).agg(F.collect_set("group_id").alias("_current"))
    size = F.size("ids")
    exact = (
        (size == F.size("_current")) & (F.size(F.array_distinct("ids")) == size)
        & (F.size(F.array_except("ids", "_current")) == 0)
    )
    return requests.join(current, key, "left").select(
        *requests.columns, F.when(F.coalesce(exact, F.lit(False)), F.lit(None)).otherwise("invalid_parameters").alias("reason")
    )


def reordered(requests: DataFrame, key: str) -> DataFrame:
    return requests.where("reason is null").select(key, F.posexplode("ids").alias("order", "group_id"))


def move_layer(orders: DataFrame) -> DataFrame:
    """Drag ``source`` in front of ``target`` in ``ids``; unknown targets change nothing."""
    rest = F.filter("ids", lambda v: v != F.col("source"))
    at = F.array_position(rest, F.col("target")).cast("int")
    moved = F.array_insert(rest, F.greatest(at, F.lit(1)), F.col("source"))
    return orders.withColumn(
        "ids", F.when((at > 0) & (F.col("source") != F.col("target")), moved).otherwise(F.col("ids"))
    )


def missing_ids(requests: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    return requests.select(*keys).distinct().join(current.select(*keys), keys, "left_anti")


def exploded_offsets(layers: DataFrame, percent: float = 20.0) -> DataFrame:
    """Shift of each layer in an exploded view: position times the separation."""
    order = Window.partitionBy("version_id").orderBy("order", "id")
    shift = (F.row_number().over(order) - 1) * F.lit(float(percent))
    return layers.withColumns({"offset_x": shift, "offset_y": shift})


def group_staleness(groups: DataFrame, analyses: DataFrame, components: DataFrame) -> DataFrame:
    """Groups whose analysis is gone or replaced, or that name a component which no longer exists.

    ``groups``: vector_id, group_id, analysis_id, component_ids (array).
    """
    current = analyses.select("vector_id", F.col("analysis_id").alias("_analysis"))
    members = groups.select("vector_id", "group_id", F.posexplode("component_ids").alias("_pos", "component_id"))
    gone = members.join(components.select("vector_id", "component_id"), ["vector_id", "component_id"], "left_anti")
    listed = gone.groupBy("vector_id", "group_id").agg(
        F.array_sort(F.collect_list(F.struct("_pos", "component_id"))).alias("_gone")
    )
    missing = F.coalesce(F.col("_gone.component_id"), F.array().cast("array<string>"))
    stale = F.col("_analysis").isNull() | (F.col("_analysis") != F.col("analysis_id")) | (F.size(missing) > 0)
    return groups.join(current, "vector_id", "left").join(listed, ["vector_id", "group_id"], "left").select(
        "vector_id", "group_id", stale.alias("is_stale"), missing.alias("missing_ids")
    )


def apply_group_edits(edits: DataFrame, components: DataFrame, order: list[str]) -> DataFrame:
    """Current logical groups after create / rename / ungroup edits.

    ``edits``: vector_id, group_id, action, name, component_ids, analysis_id and
    the order columns.  A group needs at least two distinct existing components;
    a blank name becomes ``Grupo n`` with n = live groups at that moment + 1.
    """
    created = edits.where("action = 'create'").withColumn("component_ids", F.array_distinct("component_ids"))
    wanted = created.select("vector_id", "group_id", F.explode("component_ids").alias("component_id"))
    bad = wanted.join(components.select("vector_id", "component_id"), ["vector_id", "component_id"], "left_anti").select(
        "vector_id", "group_id"
    ).distinct()
    valid = created.where(F.size("component_ids") >= 2).join(bad, ["vector_id", "group_id"], "left_anti")
    stamp = F.struct(*order)
    starts = valid.select("vector_id", "group_id", stamp.alias("_start"), "name", "component_ids", "analysis_id")
    ends = edits.where("action = 'ungroup'").select("vector_id", "group_id", stamp.alias("_at"))
    ends = ends.join(starts.select("vector_id", "group_id", "_start"), ["vector_id", "group_id"]).where("_at > _start")
    ended = ends.groupBy("vector_id", "group_id").agg(F.min("_at").alias("_end"))
    life = starts.join(ended, ["vector_id", "group_id"], "left")
    ticks = starts.select("vector_id", F.col("_start").alias("_at"), F.lit(1).alias("_d")).unionByName(
        ended.select("vector_id", F.col("_end").alias("_at"), F.lit(-1).alias("_d"))
    )
    live = running_total(ticks, ["vector_id"], ["_at"], "_d", "_live").where("_d = 1").select("vector_id", F.col("_at").alias("_start"), "_live")
    renames = edits.where((F.col("action") == "rename") & ~text.blank(F.col("name"))).select(
        "vector_id", "group_id", stamp.alias("_at"), text.trimmed(F.col("name")).alias("_new")
    )
    last = renames.join(life.select("vector_id", "group_id", "_start", "_end"), ["vector_id", "group_id"]).where(
        "_at > _start and (_end is null or _at < _end)"
    ).groupBy("vector_id", "group_id").agg(F.max(F.struct("_at", "_new"))["_new"].alias("_renamed"))
    default = F.concat(F.lit("Grupo "), F.col("_live").cast("string"))
    given = F.nullif(text.trimmed(F.col("name")), F.lit(""))
    return life.where("_end is null").join(live, ["vector_id", "_start"]).join(last, ["vector_id", "group_id"], "left").select(
        "vector_id", "group_id", F.coalesce("_renamed", given, default).alias("name"), "component_ids", "analysis_id"
    )
