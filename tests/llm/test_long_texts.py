"""Long texts of many short pieces and passages that many items or documents share."""

import random
import time

from inkgrid.llm import decontam, lines


def test_texts_of_80_000_shared_lines(spark):
    shared = [f"line {k} of them" for k in range(80_000)]
    docs = spark.createDataFrame([(i, "\n".join([*shared[:40_000], f"own {i}", *shared[40_000:], "", f"end {i}"])) for i in range(12)], "doc_id long, text string").repartition(4)
    start = time.perf_counter()
    got = lines.dedup_lines(docs, 10).collect()
    assert sorted((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got) == [(i, f"own {i}\n\nend {i}", 80_003, 80_000) for i in range(12)]
    assert time.perf_counter() - start < 90


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 8))) for _ in range(n))


def test_items_with_a_common_prompt():
    rnd = random.Random(1)
    prompt = "answer the following question about the text that you read:"
    items = [(i, f"{prompt} {words(rnd, 8)}".encode()) for i in range(1000)]
    index = decontam.Items(items, decontam.Q, decontam.EDITS)
    plain = " ".join(f"{prompt} {words(rnd, 40)}" for _ in range(20)).encode()
    leaked = items[3][1][:-5] + b"?" + items[3][1][-4:]
    start = time.perf_counter()
    assert index.matches(plain) == []
    [(item, begin, stop, edits, _)] = index.matches(plain + b" " + leaked + b" end")
    assert (item, begin, stop, edits) == (3, len(plain) + 1, len(plain) + 1 + len(leaked), 1)
    assert time.perf_counter() - start < 8


def test_alignment_against_the_whole_table():
    rnd = random.Random(6)
    for _ in range(150):
        item = "".join(rnd.choice("ab c") for _ in range(rnd.randint(1, 90)))
        text = "".join(rnd.choice("ab c") for _ in range(rnd.randint(0, 60))) + item[:rnd.randint(0, 90)] + "".join(rnd.choice("abx") for _ in range(rnd.randint(0, 9))) + item[rnd.randint(0, 20):]
        row, rows = [0] * (len(text) + 1), []
        for i, a in enumerate(item, 1):
            new = [i]
            for j, b in enumerate(text, 1):
                new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
            row = new
        masks = decontam.places(item.encode())
        assert list(decontam.distances(masks, len(item), text.encode(), True)) == row[1:]
        got = decontam.aligned(masks, decontam.places(item.encode()[::-1]), len(item), text.encode(), -len(item), len(text), len(item) - 1)
        least = min(row[1:], default=len(item))
        if least >= len(item):
            assert got is None
            continue
        begin, stop, edits = got
        assert edits == least == row[stop]
        rows = list(range(len(item) + 1))
        for b in text[begin:stop]:
            new = [rows[0] + 1]
            for i, a in enumerate(item, 1):
                new.append(min(rows[i - 1] + (a != b), rows[i] + 1, new[-1] + 1))
            rows = new
        assert rows[-1] == least  # the stretch given really is so far from the item


def test_blocks_give_what_one_block_gives(spark):
    rnd = random.Random(3)
    items = [(i, words(rnd, 12)) for i in range(30)]
    docs = spark.createDataFrame([(i, f"{words(rnd, 30)} {items[i % 40][1].upper() if i % 40 < 30 else ''} {words(rnd, 5)}") for i in range(80)], "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    whole, split = (sorted(map(tuple, decontam.find(docs, benchmark, block_chars=n).drop("uid").collect())) for n in (1 << 22, 300))
    assert whole == split and len({r[0] for r in whole}) == 60
    assert sum(1 for _ in decontam.item_blocks(benchmark, 300)) > 5
    left = decontam.without_matches(docs, benchmark, block_chars=300)
    assert sorted(r["doc_id"] for r in left.collect()) == [i for i in range(80) if i % 40 >= 30]
