"""What the search for near copies writes and shuffles."""

import glob
import random

import pyarrow as pa
import pyarrow.parquet as pq

from inkgrid.llm import jaccard
from inkgrid.session import shared_dir


def test_grams_of_one_text_only_are_not_written(spark, make_docs):
    rnd = random.Random(4)
    rows = [(k, " ".join(f"w{rnd.randrange(10**9)}" for _ in range(200)), "a") for k in range(400)]
    rows += [(1000, rows[7][1], "a"), (1001, rows[8][1] + " more", "a")]
    docs, before = make_docs(rows), set(glob.glob(f"{shared_dir(spark)}/*"))
    kept = {r.doc_id for r in jaccard.keep_first(docs, 5, 80).select("doc_id").collect()}
    assert kept == set(range(400))
    new = [f for f in set(glob.glob(f"{shared_dir(spark)}/*")) - before if "jac-signed" not in f]
    written = {f: sum(pq.ParquetFile(p).metadata.num_rows for p in glob.glob(f"{f}/*.parquet")) for f in new}
    assert written and max(written.values()) < 5 * len(rows), written  # the index of all prefixes has 42 rows a text


def test_lists_of_sorted_rows():
    """Lists against a plain dictionary, over batches of any size; salted ones and long ones come member by member."""
    rnd = random.Random(3)
    for _ in range(100):
        rows = sorted((rnd.randrange(8), -1, rnd.randrange(3), rnd.randrange(6)) for _ in range(rnd.randrange(60)))
        rows += sorted((100 + rnd.randrange(2), 2, rnd.randrange(3), rnd.randrange(3)) for _ in range(rnd.randrange(10)))
        step = rnd.randrange(1, 9)
        kinds = {"token": pa.int64(), "salt": pa.int8(), "n": pa.int32(), "mark": pa.int64()}
        batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[i:i + step]], t) for k, t in enumerate(kinds.values())], names=list(kinds)) for i in range(0, len(rows), step)]
        loose, short, want = {}, {}, {}
        for r in (r for b in jaccard._listed(iter(batches), 4) for r in b.to_pylist()):
            if r["members"] is None:
                loose.setdefault(r["token"], []).append((r["n"], r["mark"]))
            else:
                assert r["token"] not in short
                short[r["token"]] = [(x["n"], x["sig"]) for x in r["members"]]
        for token, salt, n, mark in set(rows):
            want.setdefault((token, salt), []).append((n, mark))
        assert short == {t: sorted(v) for (t, salt), v in want.items() if salt < 0 and 2 <= len(v) <= 4}
        assert {t: sorted(v) for t, v in loose.items()} == {t: sorted(v) for (t, salt), v in want.items() if salt >= 0 or len(v) > 4}
