"""Tables with a row per outline are joined by shuffles, however small their files look."""

import pytest

from helpers import outline, square, vertices
from inkgrid import session
from inkgrid.operators import components, outlines, pairs
from inkgrid.session import cut_lineage


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def drawing(spark, tmp_path):
    folder = str(tmp_path / "vertices")
    vertices(spark, *[outline(1, k, square(3 * (k % 5), 0, 2)) for k in range(20)]).write.parquet(folder)
    return spark.read.parquet(folder)


def test_outlines_are_never_broadcast(drawing):
    shaped = pairs.shapes(drawing)
    found = pairs.duplicate_pairs(drawing, outlines.document_bounds(drawing))
    for df in (shaped, pairs.shape_members(drawing, shaped), found):
        assert "SortMergeJoin" in plan(df)
    assert "Broadcast" not in plan(shaped) and "Broadcast" not in plan(pairs.shape_members(drawing, shaped))
    assert found.count() == 15


def test_rows_decide_whether_a_written_table_is_broadcast(spark, monkeypatch):
    small = cut_lineage(spark.range(20))
    assert "BroadcastHashJoin" in plan(small.join(cut_lineage(spark.range(20)), "id"))
    monkeypatch.setattr(session, "BROADCAST_ROWS", 19)
    for side in (spark.range(20), spark.range(0)):
        joined = cut_lineage(spark.range(20)).where("id < 5").join(cut_lineage(side), "id")
        assert "Broadcast" not in plan(joined)
        assert joined.count() == (5 if side.count() else 0)


def test_groups_without_broadcast_are_the_same(drawing, monkeypatch):
    before = {tuple(r) for df in components.duplicate_groups(drawing, outlines.document_bounds(drawing)) for r in df.collect()}
    monkeypatch.setattr(session, "BROADCAST_ROWS", 0)
    after = {tuple(r) for df in components.duplicate_groups(drawing, outlines.document_bounds(drawing)) for r in df.collect()}
    assert before == after and len(before) == 25
