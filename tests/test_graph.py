"""Components and cycles of small scopes in a task against the rounds of joins, and what they write."""

import random

import pytest

from inkgrid.operators import graph, raster
from helpers import MASK


def random_graph(spark, text=False):
    rng = random.Random(7)
    name = (lambda k: f"n{k}") if text else (lambda k: k)
    ends = [(doc, name(rng.randint(1, 60)), name(rng.randint(1, 60))) for doc in range(1, 9) for _ in range(5 * doc)]
    odd = [(None, name(1), name(2)), (3, None, name(1)), (3, name(1), None), (9, name(5), name(5))]
    kind = "string" if text else "long"
    edges = spark.createDataFrame(ends + odd, f"doc_id long, src {kind}, dst {kind}")
    lone = [(1, name(900)), (1, name(900)), (10, name(1)), (None, name(2)), (4, None), (9, name(5))]
    nodes = spark.createDataFrame([(d, a) for d, a, _ in ends[::2] if a is not None] + lone, f"doc_id long, id {kind}")
    return nodes, edges


@pytest.mark.parametrize("text", [False, True])
def test_components_are_those_of_the_rounds(spark, text):
    nodes, edges = random_graph(spark, text)
    want = sorted(map(repr, graph.connected_components(nodes, edges, small=0).collect()))
    for small in (40, graph.SMALL):
        assert sorted(map(repr, graph.connected_components(nodes, edges, small=small).collect())) == want
    assert len(want) > 80


def test_scopes_longer_than_a_batch(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        links = spark.range(60).selectExpr("id div 20 as doc_id", "id as src", "id + 1 as dst").where("src % 20 <> 19")
        got = graph.connected_components(links.selectExpr("doc_id", "explode(array(src, dst)) as id"), links).collect()
        assert sorted((r.doc_id, r.id, r.root) for r in got) == [(k // 20, k, k // 20 * 20) for k in range(60)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def writes(monkeypatch, work):
    """How many tables ``work`` writes."""
    seen, plain = [], graph.cut_lineage
    with monkeypatch.context() as m:
        m.setattr(graph, "cut_lineage", lambda df: seen.append(df) or plain(df))
        work()
    return len(seen)


def test_long_paths_and_rings_write_no_more_tables(spark, monkeypatch):
    def path(n):
        links = spark.range(n).selectExpr("1L as doc_id", "id as src", "id + 1 as dst")
        return lambda: graph.connected_components(links.selectExpr("doc_id", "src as id"), links).collect()

    def ring(n):
        return lambda: graph.cycle_positions(spark.range(n).selectExpr("1L as doc_id", "id", f"(id + 1) % {n} as next"), ["doc_id"]).collect()

    for work in (path, ring):
        assert writes(monkeypatch, work(2000)) == writes(monkeypatch, work(2))


def test_rings_of_masks_are_those_of_the_rounds(spark):
    rng = random.Random(3)
    pixels = [(i, m, y, x) for i in (1, 2) for m in (0, 1) for y in range(9) for x in range(9) if rng.random() < 0.6]
    links = raster.outline_links(spark.createDataFrame(pixels + [(None, 1, 0, 0), (1, None, 0, 0)], MASK))
    places = [{tuple(r) for r in graph.cycle_positions(links, raster.MASK, small=s).collect()} for s in (0, 60, graph.SMALL)]
    assert places[0] == places[1] == places[2] and len(places[0]) > 100
    assert {r.image_id for r in graph.cycle_positions(links, raster.MASK).collect()} == {1, 2}
