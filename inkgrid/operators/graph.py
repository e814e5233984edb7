"""Connected components and position along cycles.

Scopes of few rows are solved in the task that holds them, all of a batch at once;
larger ones by rounds of joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrid.session import cut_lineage

#: A scope with more rows than this is solved by rounds of joins.
SMALL = 50_000

Columns = dict[str, np.ndarray]


def _over_scopes(rows: DataFrame, scope: list[str], order: list[str], solve: Callable[[Columns], Columns], schema: str) -> DataFrame:
    """``solve`` over stretches of whole scopes, sorted by ``scope, order``; a task holds one batch and one scope at most, which the caller bounds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Columns | None = None

        def solved(columns: Columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({c: pa.array(v) for c, v in solve(columns).items()})

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
            held = columns if held is None else {c: np.concatenate([held[c], v]) for c, v in columns.items()}
            last = int(np.flatnonzero(_begins(held, scope))[-1])
            if last:
                yield solved({c: v[:last] for c, v in held.items()})
                held = {c: v[last:] for c, v in held.items()}
        if held is not None:
            yield solved(held)

    return rows.repartition(*scope).sortWithinPartitions(*scope, *order).mapInArrow(run, schema)


def _begins(columns: Columns, scope: list[str]) -> np.ndarray:
    """Where a scope begins in sorted rows."""
    first = np.zeros(len(columns[scope[0]]), dtype=bool)
    first[0] = True
    for c in scope:
        first[1:] |= columns[c][1:] != columns[c][:-1]
    return first


def _by_size(rows: DataFrame, scope: list[str], small: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of the scopes with at most ``small`` rows, and the others (None if there are none)."""
    large = cut_lineage(rows.groupBy(*scope).agg(F.count("*").alias("_rows")).where(F.col("_rows") > small).select(*scope))
    if large.isEmpty():
        return rows, None
    return rows.join(large, scope, "left_anti"), rows.join(large, scope, "left_semi")


def _typed(rows: DataFrame, **names: str) -> str:
    """A schema text with columns that have the types of others."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return ", ".join(f"`{name}` {kinds[like]}" for name, like in names.items())


def _compressed(parent: DataFrame, scope: str) -> DataFrame:
    """Follow ``id -> up`` until every row points at a root; every pass looks four steps ahead and is written once."""
    while True:
        for _ in range(2):
            above = parent.select(scope, F.col("id").alias("up"), F.col("up").alias("_next"))
            parent = parent.join(above, [scope, "up"], "left").select(scope, "id", F.coalesce("_next", "up").alias("up"))
        parent = cut_lineage(parent)
        above = parent.select(scope, F.col("id").alias("up"), F.col("up").alias("_next"))
        if parent.join(above, [scope, "up"]).where("_next <> up").isEmpty():
            return parent


def connected_components(nodes: DataFrame, edges: DataFrame, scope: str = "doc_id", small: int = SMALL) -> DataFrame:
    """``scope, id, root`` with root the smallest id of the component.

    Nodes and edges of a scope with at most ``small`` of them meet in one task (0: of none).
    """
    if not small:
        return _by_rounds(nodes, edges, scope)
    own = nodes.select(scope, F.col("id").alias("src"), F.col("id").alias("dst"))
    rows = cut_lineage(own.unionByName(edges.where("src <> dst").select(scope, "src", "dst")))
    named = F.col(scope).isNotNull() & F.col("src").isNotNull()
    few, many = _by_size(rows.where(named), [scope], small)

    def solve(c: Columns) -> Columns:
        """Roots of all scopes at once: every root hooks to the smallest root it has an edge to, until no edge has two."""
        begins = _begins(c, [scope])
        group, n = np.cumsum(begins) - 1, len(begins)
        ids, code = np.unique(np.concatenate([c["src"], c["dst"]]), return_inverse=True)
        keys, at = np.unique(np.concatenate([group, group]) * len(ids) + code, return_inverse=True)
        a, b, root = at[:n], at[n:], np.arange(len(keys))
        while (apart := root[a] != root[b]).any():
            ra, rb = root[a[apart]], root[b[apart]]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while not np.array_equal(up := root[root], root):
                root = up
        given = np.zeros(len(keys), dtype=bool)
        given[a[a == b]] = True
        return {scope: c[scope][begins][keys[given] // len(ids)], "id": ids[keys[given] % len(ids)], "root": ids[keys[root[given]] % len(ids)]}

    found = _over_scopes(few, [scope], [], solve, _typed(rows, **{scope: scope, "id": "src", "root": "src"}))
    alone = rows.where(~named & F.col("src").eqNullSafe(F.col("dst"))).select(scope, F.col("src").alias("id"), F.col("src").alias("root")).distinct()
    found = found.unionByName(alone)
    if many is None:
        return found
    return found.unionByName(_by_rounds(many.where("src = dst").select(scope, F.col("src").alias("id")), many.where("src <> dst"), scope))


def _by_rounds(nodes: DataFrame, edges: DataFrame, scope: str) -> DataFrame:
    """Every round hooks each vertex to its smallest neighbour, follows the hooks
    to their roots, and contracts the edges; edges inside a root disappear, so
    the graph shrinks and the loop ends when no edge is left.
    """
    label = nodes.select(scope, "id", F.col("id").alias("root")).distinct()
    one_way = edges.where("src <> dst").select(scope, "src", "dst")
    live = cut_lineage(one_way.unionByName(one_way.select(scope, F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    rounds = 0
    while not live.isEmpty():
        rounds += 1
        hooks = live.groupBy(scope, "src").agg(F.min("dst").alias("least")).select(
            scope, F.col("src").alias("id"), F.least("src", "least").alias("up")
        )
        parent = _compressed(cut_lineage(hooks), scope)
        step = parent.select(scope, F.col("id").alias("root"), "up")
        label = label.join(step, [scope, "root"], "left").select(scope, "id", F.coalesce("up", "root").alias("root"))
        if rounds % 3 == 0:
            label = cut_lineage(label)
        ends = [parent.select(scope, F.col("id").alias(e), F.col("up").alias(f"{e}_up")) for e in ("src", "dst")]
        live = cut_lineage(
            live.join(ends[0], [scope, "src"]).join(ends[1], [scope, "dst"])
            .select(scope, F.col("src_up").alias("src"), F.col("dst_up").alias("dst")).where("src <> dst").distinct()
        )
    return label


def cycle_positions(links: DataFrame, scope: list[str], small: int = SMALL) -> DataFrame:
    """Position of every element of a set of cycles (``id -> next``), by pointer doubling; other columns are passed on.

    Gives ``ring`` (smallest id of the cycle), ``pos`` (steps from it) and ``ring_size``.
    After k rounds a row knows the smallest id among its next 2^k elements, so
    a ring of n elements needs about log2(n) rounds.  A round is a join over the scopes
    of more than ``small`` elements, and a lookup in the task for the others.
    """
    links = cut_lineage(links.dropna(subset=[*scope, "id", "next"]))
    few, many = _by_size(links, scope, small)
    more = [c for c in links.columns if c not in [*scope, "id", "next"]]

    def solve(c: Columns) -> Columns:
        group = np.cumsum(_begins(c, scope))
        ids, code = np.unique(c["id"], return_inverse=True)
        far = np.searchsorted(group * len(ids) + code, group * len(ids) + np.searchsorted(ids, c["next"]))
        ring, off, reach = np.arange(len(far)), np.zeros(len(far), dtype=np.int64), 1
        while (better := ring[far] < ring).any():
            off, ring, far, reach = np.where(better, off[far] + reach, off), np.minimum(ring, ring[far]), far[far], reach * 2
        size = np.bincount(ring)[ring]
        return {**{k: c[k] for k in [*scope, "id", *more]}, "ring": c["id"][ring], "ring_size": size, "pos": (size - off) % size}

    kept = [*scope, "id", *more]
    found = _over_scopes(few, scope, ["id"], solve, _typed(links, **{k: k for k in kept}, ring="id") + ", ring_size long, pos long")
    if many is None:
        return found
    return found.unionByName(_positions_by_rounds(many, scope).join(many.drop("next"), [*scope, "id"]).select(*found.columns))


def _positions_by_rounds(links: DataFrame, scope: list[str]) -> DataFrame:
    state = cut_lineage(links.select(*scope, "id", F.col("next").alias("far"), F.col("id").alias("ring"), F.lit(0).cast("long").alias("off")))
    reach = 1
    while True:
        ahead = state.select(*scope, F.col("id").alias("far"), F.col("far").alias("_far"), F.col("ring").alias("_ring"), F.col("off").alias("_off"))
        better = F.col("_ring") < F.col("ring")
        state = cut_lineage(state.join(ahead, [*scope, "far"]).select(
            *scope, "id", F.col("_far").alias("far"), F.least("ring", "_ring").alias("ring"),
            F.when(better, F.col("_off") + reach).otherwise(F.col("off")).alias("off"), better.alias("_moved"),
        ))
        done = state.where("_moved").isEmpty()
        state = state.drop("_moved")
        if done:
            break
        reach *= 2
    sizes = state.groupBy(*scope, "ring").agg(F.count("*").alias("ring_size"))
    return state.join(sizes, [*scope, "ring"]).select(
        *scope, "id", "ring", "ring_size", F.pmod(F.col("ring_size") - F.col("off"), F.col("ring_size")).alias("pos")
    )
