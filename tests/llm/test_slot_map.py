"""The slot map itself against the rule in plain loops."""

import random

import pytest

from inkgrid.llm import slots


def rebalanced_by_hand(current, size, shards):
    share = -(-sum(size.values()) // shards)
    loads, out, loose = [0] * shards, {}, []
    for s in sorted(current, key=lambda s: (-size[s], s, current[s])):
        if current[s] < shards and loads[current[s]] + size[s] <= share:
            loads[current[s]] += size[s]
            out[s] = current[s]
        else:
            loose.append(s)
    for s in loose:
        to = loads.index(min(loads))
        loads[to] += size[s]
        out[s] = to
    return out


def grown_by_hand(current, size, shards):
    out = dict(current)
    for shard in set(current.values()):
        mine = sorted(s for s in current if current[s] == shard)
        total, before = sum(size[s] for s in mine), 0
        for s in mine:
            if before * (shards + 1) >= total * shards and size[s] > 0:
                out[s] = shards
            before += size[s]
    return out


@pytest.mark.parametrize("shards", [3, 7])
def test_versions_of_the_map(spark, shards):
    rnd = random.Random(shards)
    size = {s: rnd.choice([0, 0, 16, 16, 20, rnd.randint(16, 400), 5000 if s == 11 else 30]) for s in range(128)}
    sums = spark.createDataFrame([(s, b, 1) for s, b in size.items()], "slot int, bytes long, rows long").repartition(3)
    first = slots.first_map(spark, 128, shards)
    start = {r["slot"]: r["shard"] for r in first.collect()}
    assert start == {s: s % shards for s in range(128)}
    second = slots.rebalanced(first, sums, shards)
    rows = second.collect()
    got = {r["slot"]: r["shard"] for r in rows}
    assert got == rebalanced_by_hand(start, size, shards) and {r["version"] for r in rows} == {1}
    loads = [sum(b for s, b in size.items() if got[s] == k) for k in range(shards)]
    assert max(loads) - min(loads) <= max(size.values())
    grown = {r["slot"]: r["shard"] for r in slots.with_shard(second, sums, shards).collect()}
    assert grown == grown_by_hand(got, size, shards) and all(grown[s] in (got[s], shards) for s in got)
    fewer = {r["slot"]: r["shard"] for r in slots.rebalanced(second, sums, shards - 1).collect()}  # a shard less: its slots are placed anew
    assert fewer == rebalanced_by_hand(got, size, shards - 1) and max(fewer.values()) == shards - 2
