"""Streams whose state is kept by bucket over many batches."""

import json
import os
import random

from inkgrid.streaming import ingest

SCHEMA = "key string, ts int, event int, name string"


def feed(folder, number, rows):
    with open(os.path.join(folder, f"{number:03}.json"), "w") as out:
        out.write("\n".join(json.dumps(r) for r in rows))


def folders(out):
    return sorted(os.path.join(b, k) for b in os.listdir(f"{out}/rows") if b.startswith("batch") for k in os.listdir(f"{out}/rows/{b}") if k.startswith("bucket"))


def test_earliest_upload_over_ten_batches(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    os.mkdir(source)
    rng, seen, event = random.Random(7), [], 0
    for batch in range(10):
        rows = []
        for _ in range(12):
            event += 1
            rows.append({"key": rng.choice([f"k{rng.randint(0, 15)}", "", " ", None]) if batch % 3 else f"k{rng.randint(0, 15)}", "ts": rng.randint(0, 60), "event": event, "name": f"n{event}"})
        seen += rows
        feed(source, batch, rows)
        ingest.stream_earliest(spark, source, schema, "key", ["ts", "event"], out, state, buckets=4).awaitTermination()
        first = {}
        for r in seen:
            if (r["key"] or "").strip():
                first[r["key"]] = min(first.get(r["key"], r), r, key=lambda x: (x["ts"], x["event"]))
        blank = [r["event"] for r in seen if not (r["key"] or "").strip()]
        got = sorted(r.event for r in ingest.latest_snapshot(spark, schema, out).collect())
        assert got == sorted([r["event"] for r in first.values()] + blank), batch
        # nothing older than what this batch or the one before refers to
        assert len(folders(out)) <= 2 * 4 and len([x for x in os.listdir(f"{out}/places") if x.startswith("batch")]) <= 2


def test_latest_version_reads_its_own_buckets_only(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    os.mkdir(source)
    feed(source, 0, [{"key": f"k{k}", "ts": 1, "event": k, "name": "a"} for k in range(20)])
    ingest.stream_latest(spark, source, schema, ["key"], "ts", out, state, buckets=8).awaitTermination()
    untouched = {f: os.path.getmtime(os.path.join(f"{out}/rows", f)) for f in folders(out)}
    feed(source, 1, [{"key": "k3", "ts": 2, "event": 100, "name": "b"}, {"key": "k3", "ts": 0, "event": 101, "name": "c"}, {"key": "k4", "ts": None, "event": 102, "name": "d"}])
    ingest.stream_latest(spark, source, schema, ["key"], "ts", out, state, buckets=8).awaitTermination()
    assert len([f for f in folders(out) if "batch=1" in f]) == 1 and all(os.path.getmtime(os.path.join(f"{out}/rows", f)) == t for f, t in untouched.items())
    got = {r.key: r.event for r in ingest.latest_snapshot(spark, schema, out).collect()}
    assert got == {f"k{k}": k for k in range(20)} | {"k3": 100}
