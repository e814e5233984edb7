"""Importance resampling against plain loops, and the bracket of the cutoff."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkgrid.llm import resample
from llm_helpers import EDGE, lower, plain


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
    return len(words), [zlib.crc32(x.encode()) % 10_000 for x in [*words, *map(" ".join, zip(words, words[1:]))]]


def by_hand(rows, targets, percent, min_words):
    found = [features(t) for _, t, _ in rows]
    s, t = Counter(b for _, f in found for b in f), Counter(b for x in targets for b in features(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    out = []
    for (i, _, _), (n, hit) in zip(rows, found, strict=True):
        gains = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000)))) for b in hit]
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gains) // len(gains) if gains else 0
        out.append([i, len(hit), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, row in enumerate(able[:percent * len(able) // 100], 1):
        row[4] = rank
    return Counter(tuple(r[:5]) for r in out)


def test_against_plain_loops(spark, make_docs):
    rnd = random.Random(8)
    vocabulary = [f"W{k}é" if k % 3 else f"w{k}" for k in range(400)]
    rows = [(i, "-".join(rnd.choice(vocabulary[:20 + i]) for _ in range(rnd.randint(0, 60))), "a") for i in range(300)] + EDGE
    targets = [" ".join(rnd.choice(vocabulary[:60]) for _ in range(40)) for _ in range(5)] + ["", None]
    got = resample.resample(make_docs(rows), spark.createDataFrame([(t, 1) for t in targets], "text string, score int"), error=0.01).collect()
    assert plain(got, "doc_id", "n_features", "weight", "score", "rank") == by_hand(rows, targets, 25, 20)


def test_ties_and_repeated_rows(spark, make_docs):
    rows = [(i % 50, "one two three", "a") for i in range(400)] + [(None, "one two three", "a")] * 20
    target = spark.createDataFrame([("two",)], "text string")
    got = resample.resample(make_docs(rows), target, percent=37, min_words=3).collect()
    assert plain(got, "doc_id", "n_features", "weight", "score", "rank") == by_hand(rows, ["two"], 37, 3)


@pytest.mark.parametrize("error", [0.5, 0.01, 1e-7])
def test_every_bracket_gives_the_same_cutoff(spark, error):
    rows = spark.range(4000).select(F.col("id").alias("uid"), (F.col("id") * 37 % 4000).alias("doc_id"), (F.col("id") * F.col("id") % 311).alias("score"))
    want = sorted(((-r["score"], r["doc_id"]) for r in rows.collect()))
    for percent in (1, 50, 99, 100):
        got = sorted((-r["score"], r["doc_id"]) for r in rows.where(resample.draw_rule(rows, percent, error)).collect())
        assert got == want[:percent * 40]


def test_a_bracket_that_misses_is_widened(spark):
    rows = spark.range(10_000).select(F.col("id").alias("score"))
    sketched = []

    class Rows:  # the first sketch is wrong by a long way
        def agg(self, *columns):
            out = rows.agg(*columns)
            if "percentile_approx" in out.columns[0] and not sketched:
                sketched.append(1)
                return spark.createDataFrame([([1, 2],)], "x array<long>")
            return out

    low, high, above = resample.bracket(Rows(), 10_000, 2500, 0.001)
    assert sketched and low <= 7500 <= high and above == 9999 - high < 2500


def test_edge(spark, edge_docs, no_docs):
    nothing = spark.createDataFrame([], "text string")
    assert resample.resample(no_docs, nothing).count() == 0
    got = resample.resample(edge_docs, nothing).collect()
    assert plain(got, "doc_id", "n_features", "weight", "score", "rank") == by_hand(EDGE, [], 25, 20)
    assert resample.resample(edge_docs, nothing, percent=0).where("rank is not null").count() == 0
    assert resample.resample(edge_docs, nothing, percent=100, min_words=0).where("rank is not null").count() == len(EDGE)
    assert np.array_equal(resample.histogram(no_docs), np.zeros(10_000, np.int64))
