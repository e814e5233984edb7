import gzip
import math
import random
import re
import zlib
from collections import Counter

import pytest

from inkgrid.llm import decontam, html_blocks, licenses, pst, quality, warc
from llm_helpers import EDGE, LONG, lower, plain

PAGES = "page_id long, url string, html string, payload string, block string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "x") for r in rows], PAGES).repartition(3)


def round_trip(spark, tmp_path, rows, **kw):
    folder = str(tmp_path / "warc")
    warc.write_deduplicated(pages(spark, rows), folder, **kw)
    return warc.join_revisits(warc.read_archives(spark, folder)).collect(), folder


def test_warc_round_trip(spark, tmp_path):
    tricky = "body\r\n\r\nWARC/1.1\r\nContent-Length: 0\r\n\r\n end é"
    rows = [(5, "http://a", "same"), (3, "http://b\r\nX: y", "same"), (9, None, "same"), (1, "u", tricky), (2, "u", None), (4, "u", ""), (None, "n", "same"), (None, "n", "alone"), (3, "again", "same"), (8, "l", LONG)]
    got, folder = round_trip(spark, tmp_path, rows, file_bytes=2000)
    want = [(5, 4, "revisit", 3), (3, 4, "response", None), (9, 4, "revisit", 3), (1, len(tricky.encode()), "response", None), (2, 0, "response", None), (4, 0, "revisit", 2), (None, 4, "revisit", 3),
            (None, 5, "response", None), (3, 4, "response", None), (8, len(LONG), "response", None)]
    assert plain(got, "page_id", "payload_bytes", "record_type", "refers_to") == Counter(want)
    import base64
    import hashlib
    assert {r["payload_digest"] for r in got if r["page_id"] == 1} == {base64.b32encode(hashlib.sha1(tricky.encode()).digest()).decode()}
    blocks = {r["page_id"]: bytes(r["block"]) for r in warc.read_archives(spark, folder).where("record_type = 'response'").collect()}
    assert blocks[1] == tricky.encode() and blocks[8] == LONG.encode()


def test_warc_small_payloads_stay(spark, tmp_path):
    got, _ = round_trip(spark, tmp_path, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], min_bytes=3)
    assert plain(got, "page_id", "record_type") == Counter([(1, "response"), (2, "response"), (3, "response"), (4, "revisit")])


def test_warc_empty_table_and_damage(spark, tmp_path):
    assert round_trip(spark, tmp_path, [])[0] == []
    with pytest.raises(ValueError):
        list(warc.parse_archive(b"WARC/1.1\r\nContent-Length: 99\r\n\r\nshort"))
    assert gzip.decompress(gzip.compress(b"x")) == b"x"


LEAK = "The quick brown fox jumps over the lazy dog while the slow green turtle watches from the river bank and counts the clouds above."


def edit_distance_inside(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination_against_edit_distance(spark, make_docs):
    rnd = random.Random(3)
    words = [("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7)))) for _ in range(300)]
    rows, items = [], [(0, LEAK), (1, " ".join(rnd.choice(words) for _ in range(25)))]
    for i in range(40):
        leak = list(items[i % 2][1])
        for _ in range(i // 4):
            at = rnd.randrange(len(leak))
            leak[at:at + 1] = rnd.choice(["", "z", leak[at] + "y"])
        rows.append((i, " ".join(rnd.choice(words) for _ in range(60)) + ("" if i % 5 == 0 else " " + "".join(leak)) + " " + " ".join(rnd.choice(words) for _ in range(60)), "a"))
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontam.find(make_docs(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for i, text, _ in rows:
        for k, item in items:
            a, b = decontam.normal(item.encode()), decontam.normal(text.encode())
            least, allowed = edit_distance_inside(a, b), decontam.budget(len(a), decontam.EDITS, decontam.Q)
            assert ((i, k) in got) == (least <= allowed), (i, k, least, allowed)
            if (i, k) in got:
                assert got[i, k] == least


def test_decontamination_edge(spark, make_docs, edge_docs, no_docs):
    items = spark.createDataFrame([(0, LEAK), (1, None), (2, ""), (3, "short")], "item_id long, text string")
    assert decontam.find(edge_docs, items).count() == 0 and decontam.find(no_docs, items).count() == 0
    assert decontam.find(edge_docs, items.limit(0)).count() == 0
    rows = [(1, f"x {LEAK.upper()} y", "a"), (1, f"x {LEAK.upper()} y", "a"), (None, LEAK.replace(" ", "\n"), "a"), (3, LONG + " " + LEAK + " " + LEAK, "b"), (4, "clean", "b")]
    got = decontam.find(make_docs(rows), items, block_chars=10)
    assert plain(got.collect(), "doc_id", "item_id", "edits") == Counter({(1, 0, 0): 2, (None, 0, 0): 1, (3, 0, 0): 2})
    left = decontam.without_matches(make_docs(rows), items, block_chars=10)
    assert [r["doc_id"] for r in left.collect()] == [4]


def test_page_text(spark):
    para = "The river is wide and the boat that we have is small but it is good for the trip to the sea and back again."
    html = (f"<html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=/a>Home of the brave</a></ul></nav><!-- {para} --><div class=\"ad\">{para}</div>"
            f"<article><h1>Head &amp; line</h1><p>{para}<br>x<p><b>{para}</b><p>Short.</p><div class='comments'><p>{para}</p></div></article><aside>{para}</aside><footer>&copy; {para}</footer></body></html>")
    rows = [(1, "u", html), (2, None, None), (None, "v", ""), (4, "w", "<p>cut off &am"), (5, "x", html[:html.index("Short")]), (1, "u", html), (6, "y", f"<div>{para * 2000}</div>"), (7, "z", "<p class=\"open <b>no end")]
    got = html_blocks.extract(pages(spark, rows)).collect()
    text = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows) and text[1] == f"Head & line\n{para} x\n{para}\nShort."
    assert text[2] == "" and text[None] == "" and text[4] == "cut off &am" and text[5] == f"Head & line\n{para} x\n{para}" and text[6] == para * 2000
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_blocks.extract(pages(spark, [])).count() == 0


def license_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
    return len(words), [(k, label) for phrase, label in licenses.PHRASES for k in range(len(words)) if words[k:k + len(phrase.split())] == phrase.split()]


def test_licenses_against_brute_force(spark, make_docs, no_docs):
    rnd = random.Random(5)
    parts = ["under the MIT license", "Apache License, Version 2.0", "CC BY-NC 4", "the", "mit", "license", "under", "é1", "apache"]
    rows = [*EDGE, *[(100 + i, " ".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))), "a") for i in range(150)], (300, LONG + " under the mit LICENSE", "a")]
    got = licenses.scan(make_docs(rows)).collect()
    want = []
    for i, text, _ in rows:
        n, base = license_base(text)
        want.append((i, n, len(base), min((k for k, _ in base), default=None), max((k for k, _ in base), default=None), ",".join(sorted({x for _, x in base}))))
    assert plain(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == Counter(want)
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)
    assert licenses.scan(no_docs).count() == 0


def test_license_notice_with_edits(make_docs):
    notice = licenses.NOTICES[2][0].split()
    edited = notice[:6] + ["also"] + notice[6:14] + notice[15:]
    rows = [(1, "intro " + " ".join(edited) + " end", "a"), (2, " ".join(notice[:7]), "a"), (3, "Licensed under the GNU General Public License, version 3", "a")]
    got = {r["doc_id"]: (r["labels"], r["n_base"]) for r in licenses.scan(make_docs(rows)).collect()}
    assert got == {1: ("bsd", 0), 2: ("", 0), 3: ("gpl-3", 0)}


def quality_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[k:k + 3]) for k in range(len(words) - 2))
    covered = {k + s for k in range(len(words) - 2) for s in range(3) if windows[tuple(words[k:k + 3])] > 1}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def quality_rows(n=400):
    rnd = random.Random(9)
    good, bad = [f"g{k}" for k in range(200)], [f"b{k}##" for k in range(200)]
    rows = [(i, " ".join(rnd.choice(bad if i % 4 == 0 else good) for _ in range(80)) + "\nrepeat\nrepeat", "a") for i in range(n)]
    return rows, [(i, 0 if i % 4 == 0 else 1, 0) for i in range(n // 2)]


def test_quality_against_brute_force(spark, make_docs, edge_docs, no_docs):
    rows, labels = quality_rows()
    rows = [*rows, *[(1000 + k if i else None, t, s) for k, (i, t, s) in enumerate(EDGE)]]
    docs, labels = make_docs(rows), spark.createDataFrame([*labels, (None, 1, 0)], "doc_id long, quality int, toxic int")
    rules = quality.fit(docs, labels)
    got = quality.apply_rules(docs, rules).collect()
    assert plain(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == Counter((i, *quality_base(t)) for i, t, _ in rows)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["base_failed"] and r["kept"])
        if r["doc_id"] is not None and r["doc_id"] < 400:  # half of them held out
            assert r["kept"] == (r["doc_id"] % 4 != 0)
    kept = quality.kept_rows(docs, rules)
    assert kept.columns == docs.columns and plain(kept.collect(), "doc_id") == plain([r for r in got if r["kept"]], "doc_id")
    nothing = quality.fit(no_docs, labels.limit(0))
    assert nothing.cut == -math.inf and quality.apply_rules(no_docs, nothing).count() == 0 and quality.apply_rules(edge_docs, nothing).count() == len(EDGE)


def tree_by_hand(texts):
    """Counts, states and smoothed distributions in plain loops."""
    depth, counts = pst.DEPTH, {}
    for text in texts:
        data = b"\n" * depth + text + b"\n"
        for p in range(depth, len(data)):
            for d in range(depth + 1):
                counts.setdefault(data[p - d:p], Counter())[data[p]] += 1
    total = sum(counts[b""].values())
    keep = {b""}
    for context, nexts in counts.items():
        n, parent = sum(nexts.values()), counts[context[1:]] if context else None
        if context and n >= pst.P_MIN * total:
            gain = sum(c * math.log(c / n / (parent[s] / sum(parent.values()))) for s, c in nexts.items())
            if gain >= pst.GAIN:
                keep.add(context)
    return counts, keep


def test_suffix_tree_against_brute_force(make_docs, no_docs):
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choice(["The", "cat", "sat", "on", "a", "mat", "é%d" % (i % 7)]) for _ in range(rnd.randint(0, 40))), "a") for i in range(120)] + [(None, "null id", "a"), (5000, None, "a"), (7, "dog", "a"), (7, "dog", "a")]
    split = {k: [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))] for k, (_, t, _) in enumerate(rows)}
    held = {k: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1 for k, (i, _, _) in enumerate(rows)}
    unigrams = Counter(w for k in split if not held[k] for w in [*split[k], None])
    total, distinct = sum(unigrams.values()), len(unigrams)
    counts, keep = tree_by_hand([b" ".join(split[k]) for k in split if not held[k]])
    want = []
    for k, (i, _, _) in enumerate(rows):
        tokens = [*split[k], None]
        base = sum(math.log10((unigrams[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in tokens)
        data, score = b"\n" * pst.DEPTH + b" ".join(split[k]) + b"\n", 0.0
        for p in range(pst.DEPTH, len(data)):
            context = next(data[p - d:p] for d in range(pst.DEPTH, -1, -1) if data[p - d:p] in keep)
            score += math.log10((counts[context][data[p]] + pst.SMOOTH) / (sum(counts[context].values()) + 256 * pst.SMOOTH))
        want.append((i, held[k], len(tokens), sum(unigrams[w] > 0 for w in tokens), total, round(base, 6), round(score, 2)))
    got = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 2)) for r in pst.score(make_docs(rows)).collect()]
    assert Counter(x[:5] for x in got) == Counter(x[:5] for x in want)
    order = lambda x: (x[0] is None, x[0] or 0, x[2], x[5])
    for a, b in zip(sorted(got, key=order), sorted(want, key=order), strict=True):
        assert abs(a[5] - b[5]) < 1e-5 and abs(a[6] - b[6]) < 0.05
    assert pst.score(no_docs).count() == 0


def test_suffix_tree_rare_words_and_held_out_gain(edge_docs, make_docs, monkeypatch):
    assert pst.score(edge_docs).count() == len(EDGE)
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice(["alpha", "beta", "gamma"]) for _ in range(30)), "a") for i in range(200)]
    plain_scores = {r["doc_id"]: (r["base_score"], r["n_known"]) for r in pst.score(make_docs(rows)).collect()}
    monkeypatch.setattr(pst, "COMMON", 1.0)  # every word goes through the join
    joined = pst.score(make_docs(rows)).collect()
    assert all(abs(r["base_score"] - plain_scores[r["doc_id"]][0]) < 1e-6 and r["n_known"] == plain_scores[r["doc_id"]][1] for r in joined)
    uniform = -math.log10(256)
    held = [r for r in joined if r["held_out"]]
    assert sum(r["score"] for r in held) / sum(r["n_tokens"] * 6 for r in held) > 0.2 * uniform
