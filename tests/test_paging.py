"""Pages of the project listing: by number, by the last row seen, with ties and nulls."""

import pytest

from inkgrid.operators import catalog

SCHEMA = "id long, owner_id long, name string, created_at timestamp_ntz, updated_at timestamp_ntz, deleted_at timestamp_ntz"


@pytest.fixture(scope="module")
def rows(spark):
    day = "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, cast(id % 7 as decimal(18,6)))"
    return spark.range(60).selectExpr(
        "id", "id % 2 as owner_id", "if(id % 9 = 0, null, concat('n', id % 4)) as name", f"if(id % 11 = 0, null, {day}) as created_at",
        f"if(id % 13 = 0, null, {day}) as updated_at", "cast(null as timestamp_ntz) as deleted_at")


@pytest.mark.parametrize("sort, column", [("name", "name"), ("created", "created_at"), ("lastmodified", "updated_at")])
def test_all_ways_give_the_same_pages(rows, sort, column):
    whole = [r.id for r in catalog.list_projects(rows, sort=sort, size=100).collect()]
    assert len(whole) == 60
    deep = [r.id for p in (1, 2, 3, 4) for r in catalog.list_projects(rows, sort=sort, size=17, page=p, deep=0).collect()]
    assert deep == whole
    seen, after = [], None
    while True:
        page = catalog.list_projects(rows, sort=sort, size=17, after=after).collect()
        if not page:
            break
        assert {r.total_count for r in page} == {60}
        seen += [r.id for r in page]
        after = (page[-1][column], page[-1].id)
    assert seen == whole


def test_pages_behind_the_end_and_of_nothing(rows):
    assert catalog.list_projects(rows, page=50, size=10, deep=0).count() == 0
    assert catalog.list_projects(rows.where("false"), page=5, deep=0).count() == 0
