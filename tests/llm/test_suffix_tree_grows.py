"""The suffix tree keeps contexts by count, however large the corpus around them is."""

import math
import random
import zlib
from collections import Counter

import pytest

from inkgrid.llm import pst


def scores_by_hand(rows, depth):
    """Score of every id, and the states, in plain loops."""
    counts = {}
    padded = {i: b"\n" * depth + " ".join(t.lower().split()).encode() + b"\n" for i, t, _ in rows}
    for i, data in padded.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            for p in range(depth, len(data)):
                for d in range(depth + 1):
                    counts.setdefault(data[p - d:p], Counter())[data[p]] += 1
    totals = {c: sum(x.values()) for c, x in counts.items()}
    keep = {b""}
    for c, x in counts.items():
        if c and totals[c] >= pst.LEAST and sum(n * math.log(n / totals[c] * totals[c[1:]] / counts[c[1:]][s]) for s, n in x.items()) >= pst.GAIN:
            keep.add(c)

    def score(data):
        out = 0.0
        for p in range(depth, len(data)):
            c = next(data[p - d:p] for d in range(depth, -1, -1) if data[p - d:p] in keep)
            out += math.log10((counts[c][data[p]] + pst.SMOOTH) / (totals[c] + 256 * pst.SMOOTH))
        return out

    return {i: score(x) for i, x in padded.items()}, keep


@pytest.mark.parametrize("depth", [pst.DEPTH, 7])
def test_small_source_keeps_its_contexts_and_both_ways_agree(make_docs, monkeypatch, depth):
    rnd = random.Random(9)
    large = [(i, " ".join(rnd.choice(["north", "south", "east", "west", "river"]) for _ in range(500)), "a") for i in range(140)]
    small = [(1000 + i, f"zyx wvq{i % 2} kjzq", "b") for i in range(12)]  # each context at most 12 times in some 300 000 positions
    rows = large + small
    want, keep = scores_by_hand(rows, depth)
    assert b"j" in keep
    got = {r["doc_id"]: r["score"] for r in pst.score(make_docs(rows), depth).collect()}
    assert all(abs(got[i] - want[i]) < 1e-6 * max(1, abs(want[i])) for i in want)
    monkeypatch.setattr(pst, "COMMON_GRAMS", 1.0)  # every context goes through the join
    joined = {r["doc_id"]: r["score"] for r in pst.score(make_docs(rows), depth).collect()}
    assert all(abs(joined[i] - want[i]) < 1e-6 * max(1, abs(want[i])) for i in want)
