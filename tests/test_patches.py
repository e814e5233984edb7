"""Several patches of one row, in time."""

from pyspark.sql import functions as F

from inkgrid.operators import catalog

PATCH = "project_id long, group_id string, at int, name string, `order` int, visible boolean, locked boolean, touch_operation boolean, operation string"


def layers_after(spark, patches):
    cat = {
        "projects": spark.createDataFrame([(1, 10, None), (2, 20, "2023-01-01")], "id long, current_version_id long, deleted_at string"),
        "layers": spark.createDataFrame([(10, "a", "old", 1, True, False, "cut"), (10, "b", "B", 2, True, False, None), (20, "a", "gone", 1, True, False, None), (11, "a", "earlier", 1, True, False, None)],
                                        "version_id long, group_id string, name string, `order` int, visible boolean, locked boolean, operation string"),
    }
    rows = catalog.patch_layers(cat, spark.createDataFrame(patches, PATCH).repartition(3), order=["at"]).collect()
    return {(r.version_id, r.group_id): (r.name, r.order, r.visible, r.locked, r.operation) for r in rows}


def test_each_field_takes_its_last_value(spark):
    got = layers_after(spark, [
        (1, "a", 3, "new", None, None, None, False, None), (1, "a", 2, "middle", None, False, None, True, "engrave"), (1, "a", 1, "zz first", 9, True, None, False, "ignored"),
        (2, "a", 1, "not", None, None, None, False, None), (1, "none", 1, "nowhere", None, None, None, False, None),
    ])
    assert got == {(10, "a"): ("new", 9, False, False, "engrave"), (10, "b"): ("B", 2, True, False, None), (20, "a"): ("gone", 1, True, False, None), (11, "a"): ("earlier", 1, True, False, None)}


def test_a_touched_null_clears_and_an_untouched_one_does_not(spark):
    assert layers_after(spark, [(1, "a", 1, None, None, None, None, True, "engrave"), (1, "a", 2, None, None, None, None, True, None)])[10, "a"][4] is None
    assert layers_after(spark, [(1, "a", 1, None, None, None, None, True, "engrave"), (1, "a", 2, None, None, None, None, False, None)])[10, "a"][4] == "engrave"
    assert layers_after(spark, [(1, "a", 1, None, None, None, None, None, "engrave")])[10, "a"][4] == "cut"


def test_projects_in_time(spark):
    projects = spark.createDataFrame([(1, "n", "d", None, None), (2, "n", "d", None, "2023-01-01")], "id long, name string, description string, updated_at timestamp_ntz, deleted_at string")
    patches = spark.createDataFrame([(1, 5, "z", None), (1, 7, "a", None), (1, 6, None, "text"), (2, 1, "x", "x")], "id long, at int, name string, description string")
    rows = {r.id: (r.name, r.description, r.updated_at is not None) for r in catalog.update_projects(projects, patches, ["name", "description"], F.lit("2024-01-01").cast("timestamp"), order=["at"]).collect()}
    assert rows == {1: ("a", "text", True), 2: ("n", "d", False)}
