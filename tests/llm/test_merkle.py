"""The Merkle manifest against a tree built in plain loops."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from inkgrid.llm import merkle
from inkgrid.llm.common import numbered
from llm_helpers import EDGE, lower


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][k:k + fanout])) for k in range(0, len(out[-1]), fanout)])
    return out


def by_hand(rows, fanout):
    sources = defaultdict(list)
    for i, text, source in rows:
        values = [i, source, "en", None if text is None else len(text), text]
        leaf = sha("".join(map(encoded, values)))
        start = leaf
        if i is not None and zlib.crc32(str(i).encode()) % 5 == 0:
            start = sha("".join(map(encoded, [*values[:4], None if text is None else lower(text)])))
        sources[source].append((i is not None, i or 0, leaf, i, start))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(sources[s])], fanout) for s in names}
    top = levels([trees[s][-1][0] for s in names], fanout)
    out = []
    for rank, s in enumerate(names):
        for place, (_, _, leaf, i, at) in enumerate(sorted(sources[s])):
            siblings = ""
            for tree, k in ((trees[s], place), (top, rank)):
                for level in tree[:-1]:
                    first = k // fanout * fanout
                    run = level[first:first + fanout]
                    siblings += "".join(run[:k - first] + run[k - first + 1:])
                    at = sha("".join([*run[:k - first], at, *run[k - first + 1:]]))
                    k //= fanout
            out.append((i, leaf, trees[s][-1][0], top[-1][0], sha(siblings), at))
    return Counter(out)


def by_spark(docs, fanout):
    rows = merkle.manifest(docs, fanout).select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")), merkle.folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return Counter(map(tuple, rows.collect()))


@pytest.mark.parametrize("fanout", [2, 16])
def test_against_a_tree_in_loops(make_docs, fanout):
    rows = [(i * 7, f"Text {i} É", "big") for i in range(300)] + [(5000 + i, f"T{i}", "ü" if i % 2 else "z") for i in range(17)] + [(9, "Alone", "A"), (None, "No id", "A"), (None, "No id", "A"), (3, None, None), (4, "", None)]
    got = by_spark(make_docs(rows), fanout)
    assert got == by_hand(rows, fanout)
    assert sum(n for (*_, root, _, folded), n in got.items() if root != folded) > 20  # tampering shows


def test_many_sources_make_a_tree_of_their_own(make_docs):
    rows = [(i, "Words", f"s{i % 40}") for i in range(90)]
    assert by_spark(make_docs(rows), 3) == by_hand(rows, 3)


def test_edge(make_docs, edge_docs, no_docs):
    assert by_spark(edge_docs, 16) == by_hand(EDGE, 16)
    assert merkle.manifest(no_docs).count() == 0
    one = [(7, "only", None)]
    assert by_spark(make_docs(one), 16) == by_hand(one, 16)
    copies = [(1, "same", "a")] * 40  # equal rows are the same leaf again and again
    assert by_spark(make_docs(copies), 4) == by_hand(copies, 4)


def test_fields_encode_apart(spark):
    rows = spark.createDataFrame([(None, ""), ("-", "0:"), ("", "-"), ("ä", "1")], "a string, b string").select(F.concat(merkle.field(F.col("a")), merkle.field(F.col("b")))).collect()
    assert [r[0] for r in rows] == ["-0:", "1:-2:0:", "0:1:-", "2:ä1:1"]


def test_numbering_by_ranges(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "x").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("key"), (F.col("id") * 7919 % 5000).alias("v"))
    got = defaultdict(list)
    for r in numbered(rows, ["key"], [F.col("v").desc()], "test-numbers").collect():
        got[r["key"]].append((r["pos"], r["v"], r["n"]))
    for found in got.values():
        found.sort()
        assert [p for p, _, _ in found] == list(range(len(found))) and {n for _, _, n in found} == {len(found)}
        assert [v for _, v, _ in found] == sorted((v for _, v, _ in found), reverse=True)
