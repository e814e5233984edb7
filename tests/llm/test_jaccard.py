import random
from collections import Counter

import numpy as np

from inkgrid.llm import jaccard
from llm_helpers import EDGE, LONG, lower


def shingle_set(text):
    words = lower(text or "").split()
    return {tuple(words[k:k + 3]) for k in range(len(words) - 2)} if len(words) > 2 else ({tuple(words)} if words else set())


def brute_force(rows, percent=90):
    sets = [shingle_set(t) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    groups = {}
    for k, (i, _, _) in enumerate(rows):
        groups.setdefault(find(k), []).append(i)
    least = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return Counter((rows[k][0], len(sets[k]), least[find(k)]) for k in range(len(rows)))


def result(docs):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.link_components(docs).collect())


def family(rnd, start, size, words, edits, first_id):
    """Near copies of one text with a few words changed each."""
    base = [f"w{start}x{k}" for k in range(words)]
    rows = []
    for i in range(size):
        text = list(base)
        for _ in range(rnd.randint(0, edits)):
            text[rnd.randrange(words)] = f"n{rnd.randrange(10_000)}"
        rows.append((first_id + i, " ".join(text), "a"))
    return rows


def test_against_brute_force(make_docs):
    rnd = random.Random(1)
    rows = [*EDGE[:6], *EDGE[7:]]
    for f in range(8):
        rows += family(rnd, f, 12, rnd.choice([4, 12, 40, 90, 300]), 5, 100 * (f + 1))
    shared = " ".join(f"line{k}" for k in range(12))
    rows += [(2000 + i, shared + " " + " ".join(f"own{i}x{k}" for k in range(rnd.randint(0, 20))), "b") for i in range(60)]
    rows += [(3000 + i, rows[20][1].upper(), "b") for i in range(5)]
    assert result(make_docs(rows)) == brute_force(rows)


def test_long_lists_and_cut_families(make_docs, monkeypatch):
    monkeypatch.setattr(jaccard, "SHORT_LIST", 4)
    monkeypatch.setattr(jaccard, "GROUP_GRAMS", 400)
    rnd = random.Random(7)
    rows = family(rnd, 1, 60, 60, 6, 1) + family(rnd, 2, 40, 30, 3, 500) + [(900 + i, "all of these have the same few words here " + "and then one more " * (i % 4), "a") for i in range(30)]
    assert result(make_docs(rows)) == brute_force(rows)


def test_edge(edge_docs, no_docs):
    assert sum(result(edge_docs).values()) == len(EDGE) and result(no_docs) == Counter()
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in jaccard.link_components(edge_docs).collect()}
    assert got[(6, 1)] == 6 and got[(None, 0)] is None and got[(1, 0)] == 1 and got[(5, len(shingle_set(LONG)))] == 5


def test_keep_first(make_docs):
    text = " ".join(f"w{k}" for k in range(50))
    rows = [(5, text, "a"), (3, text, "a"), (3, text, "a"), (None, text + " x", "b"), (9, None, "a"), (9, None, "a"), (4, "else", "c"), (None, "null only", "c"), (None, "null only", "c")]
    docs = make_docs(rows)
    kept = jaccard.keep_first(docs)
    assert kept.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([(3, text), (9, None), (9, None), (4, "else"), (None, "null only")])


def test_t_occurrence_counts():
    rnd = np.random.default_rng(0)
    for _ in range(50):
        query = np.unique(rnd.integers(0, 60, 30)).astype(np.uint64)
        partners = [np.unique(rnd.integers(0, 60, rnd.integers(1, 40))).astype(np.uint64) for _ in range(20)]
        for least in (1, 5, 12, len(query)):
            want = {k: len(np.intersect1d(query, p)) for k, p in enumerate(partners)}
            assert dict(jaccard.Index(partners).search(query, least)) == {k: v for k, v in want.items() if v >= least}
