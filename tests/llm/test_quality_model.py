"""The log ratios and the threshold of the quality rules, recomputed in plain loops."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkgrid.llm import quality
from inkgrid.llm.common import word_hashes
from test_text_operators import quality_rows


def buckets(text):
    return Counter(quality.gram_buckets(word_hashes(text.encode().split())).tolist())


def test_ratios_scores_and_threshold(spark, make_docs):
    rows, labels = quality_rows(300)
    rows = [(i, t + (" g1 g2" * (i % 3)), s) for i, t, s in rows] + [(900, "g1 g2", "a"), (901, "", "a"), (902, None, "a")]
    docs, known = make_docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rules = quality.fit(docs, known)
    order = {q: [r[0] for r in known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id").collect()] for q in (0, 1)}
    counted = set(order[1][::2])
    text = {i: t or "" for i, t, _ in rows}
    corpus, trusted = Counter(), Counter()
    for i, t in text.items():
        corpus.update(buckets(t))
        if i in counted:
            trusted.update(buckets(t))
    n, m, k = sum(corpus.values()), sum(trusted.values()), quality.BUCKETS
    weight = 0.1 * m + 1.0

    def ratio(b):
        prior = (corpus[b] + 0.5) / (n + 0.5 * k)
        return math.log((trusted[b] + weight * prior) / (m + weight)) - math.log(prior)

    for b in list(corpus)[::7] + [b for b in range(k) if b not in corpus][:50]:
        assert rules.ratio[b] == pytest.approx(ratio(b), abs=1e-12)
    score = {i: sum(ratio(b) * c for b, c in buckets(t).items()) / max(1, sum(buckets(t).values())) for i, t in text.items()}
    got = {r["doc_id"]: r for r in quality.apply_rules(docs, rules).collect()}
    assert all(got[i]["score"] == pytest.approx(s, abs=1e-9) for i, s in score.items())

    good = [score[i] for i in order[1][1::2] if not got[i]["base_failed"]]
    bad = [score[i] for i in order[0] if not got[i]["base_failed"]]

    def right(cut):
        return sum(x >= cut for x in good) / len(good) + sum(x < cut for x in bad) / len(bad)

    marks = sorted({*good, *bad})
    best = max(right(c) for c in [marks[0] - 1, *[(a + b) / 2 for a, b in zip(marks, marks[1:])], marks[-1] + 1])
    assert right(rules.cut) == pytest.approx(best)
    assert all(r["kept"] == (not r["base_failed"] and r["score"] >= rules.cut) for r in got.values())
