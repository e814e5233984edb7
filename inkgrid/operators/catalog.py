"""Project catalogue: listing, changes, snapshots, copies, integrity.

A catalogue is a dict of DataFrames: projects, documents, versions, layers,
colors (and assets).  Every change takes tables and returns tables; new ids are
hashes of the old id and a salt, so a job that is run again gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgrid.functions.text import blank, trimmed
from inkgrid.operators.history import numbered

Catalog = dict[str, DataFrame]

# The origins a document version may have.
ORIGINS = ["VECTORIZE", "MANUAL_EDIT", "AUTOSAVE", "RESTORE", "AI_EDIT"]

PAGE_SIZE, MAX_PAGE_SIZE = 20, 100
#: Pages that begin farther behind are found by numbered ranges instead of one sorted head.
DEEP_ROWS = 10_000


def live_projects(projects: DataFrame) -> DataFrame:
    return projects.where(F.col("deleted_at").isNull())


def _matching(projects: DataFrame, owner: int | str | None, search: str | None) -> DataFrame:
    found = live_projects(projects)
    if owner is not None:
        found = found.where(F.col("owner_id") == owner)
    if search and search.strip():
        found = found.where(F.col("name").ilike(f"%{search.strip()}%"))
    return found


def _behind(column: str, descending: bool, value: object, ident: int | str) -> Column:
    """Rows that come after (``value``, ``ident``) in the order of the listing; nulls are the smallest values."""
    col, later = F.col(column), F.col("id") > F.lit(ident)
    if value is None:
        return (col.isNull() & later) if descending else ((col.isNull() & later) | col.isNotNull())
    tie = (col == F.lit(value)) & later
    return (col < F.lit(value)) | tie | col.isNull() if descending else (col > F.lit(value)) | tie


def list_projects(
    projects: DataFrame, owner: int | str | None = None, search: str | None = None, sort: str | None = None,
    page: int | None = None, size: int | None = None, after: tuple[object, int | str] | None = None, deep: int = DEEP_ROWS,
) -> DataFrame:
    """One page of an owner's live projects with ``total_count``; ties go by id.

    ``after`` is the sort value and id of the last row seen: the page that follows it
    costs as much as the first, wherever it lies, and ``page`` is passed over.  A page
    by number keeps the rows before it in one task only up to ``deep`` of them;
    farther pages are found by numbers given to ranges of the sorted rows.
    """
    orders = {"lastmodified": ("updated_at", True), "name": ("name", False), "created": ("created_at", True)}
    chosen = (sort or "").strip().lower() or "lastmodified"
    if chosen not in orders:
        raise ValueError("invalid_sort")
    column, descending = orders[chosen]
    order = [F.col(column).desc() if descending else F.col(column).asc(), F.col("id").asc()]
    page = page if page and page > 0 else 1
    size = min(size, MAX_PAGE_SIZE) if size and size > 0 else PAGE_SIZE
    found = _matching(projects, owner, search)
    first = (page - 1) * size
    if after is not None:
        rows = found.where(_behind(column, descending, *after)).orderBy(*order).limit(size)
    elif first <= deep:
        rows = found.orderBy(*order).offset(first).limit(size)
    else:
        placed = numbered(found, [], order, "_position")
        rows = placed.where(F.col("_position").between(first + 1, first + size)).orderBy("_position").drop("_position")
    total = found.agg(F.count("*").alias("total_count"))
    return rows.withColumn("total_count", total.scalar())


def list_versions(versions: DataFrame) -> DataFrame:
    """Version metadata, newest first."""
    return versions.select(
        "id", "document_id", "version_number", "width_mm", "height_mm", "origin", "created_at"
    ).orderBy("document_id", F.col("version_number").desc())


def clean_name(text: Column, longest: int = 200) -> tuple[Column, Column]:
    """Trimmed name and the reason it is refused (null when fine)."""
    name = trimmed(text)
    reason = F.when(blank(text), "invalid_name").when(F.length(name) > longest, "invalid_name")
    return name, reason


def description_reason(description: Column, longest: int = 2000) -> Column:
    """Why a description is refused: only for its length.  It is kept as written, blanks and all."""
    return F.when(F.length(description) > longest, "invalid_description")


def derived_id(*parts: Column | str) -> Column:
    """Repeatable id: hash of the natural key."""
    return F.sha2(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]), 256)


def create_projects(projects: DataFrame, requests: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Valid requests (``id, owner_id, name``, maybe ``description``) become new rows, created and updated now.

    Gives the projects with the new ones, and the refused requests as ``id, reason``.
    """
    name, reason = clean_name(F.col("name"))
    told = ["description"] if "description" in requests.columns else []
    if told:
        reason = F.coalesce(reason, description_reason(F.col("description")))
    checked = requests.withColumn("_reason", reason)
    fresh = checked.where("_reason is null").select(
        "id", "owner_id", name.alias("name"), *told, now.alias("created_at"), now.alias("updated_at"),
        F.lit(None).cast("timestamp").alias("deleted_at"),
    )
    return projects.unionByName(fresh, allowMissingColumns=True), checked.where("_reason is not null").select("id", F.col("_reason").alias("reason"))


def merged_patches(patches: DataFrame, keys: list[str], fields: list[str], order: list[str], touched: dict[str, str] | None = None) -> DataFrame:
    """One patch per key: of every field the last value that was given, by ``order``.

    A null says nothing about a field, except for the fields of ``touched``: there
    the named flag tells that the value counts, even a null, and the merged flag
    whether any patch set it.  Of patches at the same time the larger value wins.
    Each field is a maximum of its own, so patches of one key are combined before
    they are shuffled.
    """
    touched = touched or {}
    at = [F.col(c) for c in order]
    last = {}
    for f in fields:
        said = F.col(touched[f]) if f in touched else F.col(f).isNotNull()
        last[f] = F.max(F.when(said, F.struct(*at, F.col(f).alias("_value"))))["_value"].alias(f)
    flags = [F.coalesce(F.bool_or(flag), F.lit(False)).alias(flag) for flag in dict.fromkeys(touched.values())]
    return patches.groupBy(*keys).agg(*last.values(), *flags)


def update_projects(projects: DataFrame, patches: DataFrame, fields: list[str], now: Column, order: list[str] | None = None) -> DataFrame:
    """Null patch fields keep the old value; patched live projects are updated now.

    Several patches of one project take effect one after the other, by the columns
    of ``order``; without them all count as made at once.
    """
    merged = merged_patches(patches, ["id"], fields, order or []) if fields else patches.select("id").distinct()
    p = merged.select("id", F.lit(True).alias("_hit"), *[F.col(f).alias(f"_{f}") for f in fields])
    hit = F.col("_hit") & F.col("deleted_at").isNull()
    columns = []
    for c in projects.columns:
        if c in fields:
            columns.append(F.when(hit, F.coalesce(f"_{c}", c)).otherwise(F.col(c)).alias(c))
        elif c == "updated_at":
            columns.append(F.when(hit, now).otherwise(F.col(c)).alias(c))
        else:
            columns.append(F.col(c))
    return projects.join(p, "id", "left").select(*columns)


def soft_delete(projects: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Marks live projects as deleted; nothing else changes."""
    hit = F.col("_hit").isNotNull() & F.col("deleted_at").isNull()
    columns = [F.when(hit, now).otherwise(F.col(c)).alias(c) if c in ("deleted_at", "updated_at") else F.col(c) for c in projects.columns]
    return projects.join(ids.select("id", F.lit(True).alias("_hit")).distinct(), "id", "left").select(*columns)


def delete_assets(assets: DataFrame, ids: DataFrame) -> DataFrame:
    return assets.join(ids.select("id"), "id", "left_anti")


def document_graph(versions: DataFrame, layers: DataFrame, colors: DataFrame) -> DataFrame:
    """Each version with its layers, each layer with its colour, in layer order.

    A version is a small document that is shown whole; it is nested by design.
    """
    paint = colors.select(F.col("id").alias("color_id"), "hex", "coverage", "is_background")
    rows = layers.join(paint, "color_id").groupBy("version_id").agg(
        F.array_sort(F.collect_list(F.struct(
            "order", "id", "group_id", "name", "visible", "locked", "operation", "hex", "coverage", "is_background"
        ))).alias("layers")
    )
    return versions.join(rows, versions["id"] == rows["version_id"], "left").select(
        versions["*"], F.coalesce("layers", F.array().cast(rows.schema["layers"].dataType)).alias("layers")
    )


def current_document(catalog: Catalog) -> DataFrame:
    """The version each live project points to."""
    pointer = live_projects(catalog["projects"]).select(F.col("id").alias("project_id"), F.col("current_version_id").alias("id"))
    return catalog["versions"].join(pointer, "id")


def _copy_children(catalog: Catalog, version_map: DataFrame, salt: str, keep_asset: bool) -> tuple[DataFrame, DataFrame]:
    """Layers and colours below ``old_version -> new_version`` with fresh ids."""
    m = version_map.select(F.col("old_version").alias("version_id"), "new_version")
    color_id = derived_id(F.col("id"), F.col("new_version"), salt)
    colors = catalog["colors"].join(m, "version_id").select(
        color_id.alias("id"), F.col("new_version").alias("version_id"), "hex", "coverage", "is_background", "order"
    )
    kept = lambda c: F.col(c) if keep_asset else F.lit(None).cast(catalog["layers"].schema[c].dataType)
    layers = catalog["layers"].join(m, "version_id").select(
        derived_id(F.col("id"), F.col("new_version"), salt).alias("id"), "group_id",
        F.col("new_version").alias("version_id"),
        derived_id(F.col("color_id"), F.col("new_version"), salt).alias("color_id"),
        "name", "order", "visible", "locked", "operation",
        kept("svg_asset_id").alias("svg_asset_id"), kept("path_count").alias("path_count"),
    )
    return layers, colors


def duplicate_projects(catalog: Catalog, ids: DataFrame, now: Column) -> Catalog:
    """Deep copies (only the new rows) named ``Copia de ...`` with fresh ids.

    Group ids, order, flags, operations and version numbers are kept; the
    thumbnail, layer assets and path counts are not.
    """
    source = live_projects(catalog["projects"]).join(ids.select("id"), "id", "left_semi")
    docs = catalog["documents"].join(source.select(F.col("id").alias("project_id")), "project_id", "left_semi")
    new_doc = derived_id(F.col("document_id"), "copy")
    versions = catalog["versions"].join(docs.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    version_map = versions.select(F.col("id").alias("old_version"), derived_id(F.col("id"), "copy").alias("new_version"))
    layers, colors = _copy_children(catalog, version_map, "copy", keep_asset=False)
    projects = source.join(version_map, F.col("current_version_id") == F.col("old_version"), "left").select(
        derived_id(F.col("id"), "copy").alias("id"), "owner_id",
        F.concat(F.lit("Copia de "), "name").alias("name"), "description",
        F.lit(None).cast("string").alias("thumbnail_asset_id"), F.col("new_version").alias("current_version_id"),
        now.alias("created_at"), now.alias("updated_at"), F.lit(None).cast("timestamp").alias("deleted_at"),
    )
    return {
        "projects": projects,
        "documents": docs.select(derived_id(F.col("id"), "copy").alias("id"), derived_id(F.col("project_id"), "copy").alias("project_id")),
        "versions": versions.select(
            derived_id(F.col("id"), "copy").alias("id"), new_doc.alias("document_id"), "version_number", "width_mm",
            "height_mm", "view_box", "schema_version", "origin", "metadata_json", now.alias("created_at"),
        ),
        "layers": layers,
        "colors": colors,
    }


def _next_numbers(catalog: Catalog) -> DataFrame:
    return catalog["versions"].groupBy("document_id").agg((F.max("version_number") + 1).alias("next_number"))


def restore_version(catalog: Catalog, requests: DataFrame, now: Column) -> Catalog:
    """Copies a version (``project_id, version_number``) as the newest of its document."""
    docs = catalog["documents"].select(F.col("id").alias("document_id"), "project_id")
    live = live_projects(catalog["projects"]).select(F.col("id").alias("project_id"))
    source = (
        catalog["versions"].join(docs, "document_id").join(live, "project_id", "left_semi")
        .join(requests.select("project_id", "version_number"), ["project_id", "version_number"], "left_semi")
        .join(_next_numbers(catalog), "document_id")
    )
    new_id = derived_id(F.col("id"), F.col("next_number"), "restore")
    layers, colors = _copy_children(
        catalog, source.select(F.col("id").alias("old_version"), new_id.alias("new_version")), "restore", keep_asset=True
    )
    metadata = F.to_json(F.struct(F.col("version_number").alias("restoredFromVersion")))
    versions = source.select(
        new_id.alias("id"), "document_id", F.col("next_number").alias("version_number"), "width_mm", "height_mm",
        "view_box", "schema_version", F.lit("RESTORE").alias("origin"), metadata.alias("metadata_json"), now.alias("created_at"),
    )
    pointers = source.select("project_id", new_id.alias("current_version_id"), now.alias("updated_at"))
    return {"versions": versions, "layers": layers, "colors": colors, "pointers": pointers}


def save_checkpoint(
    catalog: Catalog, snapshots: DataFrame, layer_rows: DataFrame, now: Column, origin: str = "MANUAL_EDIT"
) -> Catalog:
    """New version per document from the current layers.

    ``snapshots``: project_id, document_id, width_mm, height_mm (null = pixels),
    width_px, height_px.  ``layer_rows``: document_id, group_id, name, order,
    visible, locked, operation, svg_asset_id, path_count, color_hex,
    area_percent, is_excluded.  Every layer brings its own colour row.
    """
    numbered = snapshots.join(_next_numbers(catalog), "document_id", "left").select(
        *snapshots.columns, F.coalesce("next_number", F.lit(1)).alias("version_number")
    )
    new_id = derived_id(F.col("document_id"), F.col("version_number"), "save")
    versions = numbered.select(
        new_id.alias("id"), "document_id", "version_number",
        F.coalesce("width_mm", F.col("width_px").cast("double")).alias("width_mm"),
        F.coalesce("height_mm", F.col("height_px").cast("double")).alias("height_mm"),
        F.concat_ws(" ", F.lit("0 0"), F.col("width_px").cast("string"), F.col("height_px").cast("string")).alias("view_box"),
        F.lit(1).alias("schema_version"), F.lit(origin).alias("origin"), F.lit("{}").alias("metadata_json"), now.alias("created_at"),
    )
    position = F.row_number().over(Window.partitionBy("version_id").orderBy("order", "group_id")) - 1
    rows = layer_rows.join(versions.select("document_id", F.col("id").alias("version_id")), "document_id").withColumn("_pos", position)
    color_id = derived_id(F.col("version_id"), F.col("group_id"), "color")
    return {
        "versions": versions,
        "layers": rows.select(
            derived_id(F.col("version_id"), F.col("group_id"), "layer").alias("id"), "group_id", "version_id",
            color_id.alias("color_id"), "name", "order", "visible", "locked", "operation", "svg_asset_id", "path_count",
        ),
        "colors": rows.select(
            color_id.alias("id"), "version_id", F.col("color_hex").alias("hex"), F.col("area_percent").alias("coverage"),
            F.coalesce("is_excluded", F.lit(False)).alias("is_background"), F.col("_pos").alias("order"),
        ),
        "pointers": numbered.select("project_id", new_id.alias("current_version_id"), now.alias("updated_at")),
    }


def patch_layers(catalog: Catalog, patches: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Layers of the current versions after patches (``project_id, group_id, ...``).

    Null keeps a value; the operation is replaced, even by null, when touched.
    Several patches of one layer take effect one after the other, by the columns of
    ``order``; without them all count as made at once.
    """
    pointer = live_projects(catalog["projects"]).select(F.col("id").alias("project_id"), F.col("current_version_id").alias("version_id"))
    fields = ["name", "order", "visible", "locked", "operation"]
    merged = merged_patches(patches, ["project_id", "group_id"], fields, order or [], {"operation": "touch_operation"})
    p = merged.join(pointer, "project_id").select("version_id", "group_id", F.col("touch_operation").alias("_touch"), *[F.col(c).alias(f"_{c}") for c in fields])
    columns = []
    for c in catalog["layers"].columns:
        if c == "operation":
            columns.append(F.when(F.col("_touch"), F.col("_operation")).otherwise(F.col(c)).alias(c))
        elif c in fields:
            columns.append(F.coalesce(f"_{c}", c).alias(c))
        else:
            columns.append(F.col(c))
    return catalog["layers"].join(p, ["version_id", "group_id"], "left").select(*columns)


# The references of the catalogue.
REFERENCES = [
    ("projects", "owner_id", "users", "project_owner"), ("projects", "thumbnail_asset_id", "assets", "project_thumbnail"),
    ("projects", "current_version_id", "versions", "project_version"), ("assets", "project_id", "projects", "asset_project"),
    ("documents", "project_id", "projects", "document_project"), ("versions", "document_id", "documents", "version_document"),
    ("versions", "svg_asset_id", "assets", "version_asset"), ("layers", "version_id", "versions", "layer_version"),
    ("layers", "color_id", "colors", "layer_color"), ("layers", "svg_asset_id", "assets", "layer_asset"),
    ("colors", "version_id", "versions", "color_version"),
]


def integrity_check(catalog: Catalog) -> DataFrame:
    """Broken rules as ``rule, key, n``: double keys, dangling references, unknown origins.

    References are checked where the catalogue holds both tables and the column.
    """
    def doubles(df: DataFrame, keys: list[str], rule: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(
            F.lit(rule).alias("rule"), F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key"), "n"
        )

    def dangling(df: DataFrame, column: str, target: DataFrame, rule: str) -> DataFrame:
        wanted = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_ref")).agg(F.count("*").alias("n"))
        return wanted.join(target.select(F.col("id").alias("_ref")), "_ref", "left_anti").select(
            F.lit(rule).alias("rule"), F.col("_ref").cast("string").alias("key"), "n"
        )

    unknown = catalog["versions"].where(~F.col("origin").isin(ORIGINS)).groupBy("origin").agg(F.count("*").alias("n")).select(
        F.lit("version_origin").alias("rule"), F.col("origin").alias("key"), "n"
    )
    parts = [
        doubles(catalog["layers"], ["version_id", "group_id"], "layer_key"),
        doubles(catalog["versions"], ["document_id", "version_number"], "version_key"),
        *[
            dangling(catalog[table], column, catalog[target], rule) for table, column, target, rule in REFERENCES
            if table in catalog and target in catalog and column in catalog[table].columns
        ],
        unknown,
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
