"""Language codes: the code itself, held-out accuracy, und, and edge cases."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkgrid.llm import langcodes
from inkgrid.llm.queries import QUERIES
from llm_helpers import EDGE, LONG

SYLLABLES = {"aa": "ka to mi ru shi na", "bb": "sch ung ver ein heit keit", "cc": "tion ment eau oux ille", "dd": "ão ção lho nha dade", "ee": "ый ого ение ать", "ff": "wska czy rze ość", "gg": "的 是 了 中 国"}


def corpus(langs, n, seed=1):
    rnd = random.Random(seed)
    parts = {k: v.split() for k, v in SYLLABLES.items()}
    word = lambda k: "".join(rnd.choice(parts[k]) for _ in range(rnd.randint(1, 3)))
    return [(i, " ".join(word(langs[i % len(langs)]) for _ in range(rnd.randint(3, 40))).title(), langs[i % len(langs)]) for i in range(n)]


def test_codewords_are_apart():
    for n, least in ((2, 1), (3, 2), (4, 4), (5, 8), (9, 5), (40, 8)):
        code = langcodes.codewords(n)
        assert code.shape[0] == n and set(np.unique(code)) == {-1, 1}
        assert min((code[a] != code[b]).sum() for a in range(n) for b in range(a)) >= least
        assert len({tuple(c) for c in code.T} | {tuple(-c) for c in code.T}) == 2 * code.shape[1]  # no column twice, none the other way round
        assert np.array_equal(code, langcodes.codewords(n))


@pytest.mark.parametrize("langs", [["aa", "bb"], ["aa", "bb", "cc", "dd"], list(SYLLABLES)])
def test_held_out_accuracy(spark, langs):
    rows = corpus(langs, 1400)
    docs = spark.createDataFrame([(i, t, k, "x", 0.5) for i, t, k in rows], "doc_id long, text string, lang string, lang_pred string, score double").repartition(4)
    held = langcodes.held_out(F.col("doc_id"))
    got = langcodes.predict(docs, langcodes.fit(docs.where(~held))).collect()
    want = {i: k for i, _, k in rows}
    out = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(got) == 1400 and len(out) > 200
    assert sum(r["lang_pred"] == want[r["doc_id"]] for r in out) >= 0.97 * len(out)
    assert all(0 <= r["score"] <= 1 and r["ambiguous"] == (r["score"] < langcodes.SURE) for r in got)


def test_counts_against_plain_loops(spark):
    rows = corpus(["aa", "dd"], 40)
    got = langcodes.gram_counts(spark.createDataFrame([(t, k) for _, t, k in rows], "text string, lang string").repartition(3), ["aa", "dd"])
    joined = {k: b"".join(langcodes.normal(t) for _, t, x in rows if x == k) for k in ("aa", "dd")}
    for row, k in zip(got, ("aa", "dd"), strict=True):  # texts end in a blank, so what reaches into the next one is a blank too
        inside = Counter(int(b) for _, t, x in rows if x == k for hit in langcodes.gram_buckets(langcodes.normal(t)) for b in hit)
        assert all(row[b] >= n for b, n in inside.items()) and row.sum() <= 3 * len(joined[k])


def test_margins_of_one_text_do_not_depend_on_its_neighbours(spark):
    rows = corpus(["aa", "bb", "cc"], 300)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langcodes.fit(docs)
    texts = [langcodes.normal(t) for _, t, _ in rows] + [langcodes.normal("a"), langcodes.normal(LONG)]
    alone = np.concatenate([model.margins([t]) for t in texts])
    assert np.allclose(alone, model.margins(texts), atol=1e-3)
    longer = [texts[0] * 60_000]  # counted in slices of 1 MB
    assert np.allclose(model._long(longer[0]) / np.sqrt(60_000), model.margins([texts[0]]), rtol=0.1)


def test_ambiguous_between_two(spark):
    rows = corpus(["aa", "bb", "cc", "dd"], 800)
    model = langcodes.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    mixed = spark.createDataFrame([(1, "x"), (2, "ka schung to ver")], "doc_id long, text string")
    clear = spark.createDataFrame([(3, rows[0][1])], "doc_id long, text string")
    assert langcodes.predict(mixed, model).where("ambiguous").count() >= 1 and langcodes.predict(clear, model).where("ambiguous").count() == 0


def test_edge(spark, edge_docs, no_docs):
    none = langcodes.fit(no_docs)
    assert none.langs == [] and langcodes.predict(no_docs, none).count() == 0
    got = langcodes.predict(edge_docs, none).collect()
    assert len(got) == len(EDGE) and {(r["lang_pred"], r["score"]) for r in got} == {("und", 0.0)}
    one = langcodes.predict(edge_docs, langcodes.fit(edge_docs)).collect()  # all rows are "en"
    letterless = {None, "", "   \n\t "}
    assert Counter(r["lang_pred"] for r in one) == Counter("und" if t in letterless else "en" for _, t, _ in EDGE)
    rows = [(1, "12 - 3", "aa"), (2, "word", None), (3, None, "bb"), (4, "½ ² 7", "bb"), (5, "٣", "aa")]
    assert langcodes.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string")).langs == []


def test_query_holds_out_and_is_right(spark, sf_dir):
    want = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = QUERIES["op13_langid"](spark, sf_dir).collect()
    assert {r["doc_id"]: r["held_out"] for r in got} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in want}
    held = [r for r in got if r["held_out"] and want[r["doc_id"]]]
    assert sum(r["lang_pred"] == want[r["doc_id"]] for r in held) >= 0.95 * len(held)
