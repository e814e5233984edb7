import hashlib
import math
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from inkgrid.llm import lines, mixing, slots
from llm_helpers import EDGE, plain


def test_lines_against_brute_force(spark, make_docs):
    rows = [(i, "Shared LINE \nown %d\n\n tail" % i if i % 2 else "shared line\nown\nown", "a") for i in range(12)] + [(None, " SHARED line", "b"), (None, "shared line", "b"), (3, "Shared LINE \nown 3\n\n tail", "a")]
    docs, key = make_docs(rows), lambda x: x.strip(" \t\n\x0b\f\r").translate({c: c + 32 for c in range(65, 91)})
    seen = defaultdict(set)
    for i, t, _ in rows:
        for x in (t or "").split("\n"):
            seen[key(x)].add(i)
    want = []
    for i, t, _ in rows:
        split = (t or "").split("\n")
        kept = [x for x in split if not (len(key(x)) >= 1 and len(seen[key(x)]) >= 6)]
        want.append((i, "\n".join(kept), len(split), len(split) - len(kept)))
    assert Counter(map(tuple, lines.dedup_lines(docs, 6).collect())) == Counter(want)


def test_lines_edge(edge_docs, no_docs):
    got = lines.dedup_lines(edge_docs, 2).collect()
    assert len(got) == len(EDGE) and all(r["n_lines"] >= 1 for r in got)
    assert [r["text"] for r in got if r["doc_id"] in (1, 2)] == ["", ""]
    assert lines.dedup_lines(no_docs).count() == 0


def test_slots_balance_and_places(spark, edge_docs, no_docs, make_docs):
    docs = make_docs([(i, "x" * (i * 37 % 900), "a") for i in range(3000)])
    out = slots.number_rows(slots.shard_records(docs, 7, slots=256)).collect()
    load, places = Counter(), defaultdict(list)
    for r in out:
        assert r["_size"] == len(r["text"]) + 16 and r["_crc"] == zlib.crc32(r["text"].encode())
        load[r["_shard"]] += r["_size"]
        places[r["_shard"]].append(r["_place"])
    assert len(load) == 7 and max(load.values()) - min(load.values()) <= 0.02 * max(load.values())
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    edge = slots.number_rows(slots.shard_records(edge_docs, 4, slots=64)).collect()
    assert len(edge) == len(EDGE) and sorted(r["_size"] for r in edge)[0] == 16
    assert slots.shard_records(no_docs, 4, slots=64).count() == 0


def test_slot_map_versions(spark, tmp_path, make_docs):
    docs = make_docs([(i, "x" * (i % 50), "a") for i in range(2000)])
    folder = str(tmp_path / "map")
    records = slots.shard_records(docs, 5, slots=128, folder=folder)
    first, second = ({r["slot"]: r["shard"] for r in slots.load_map(spark, folder, v).collect()} for v in (0, 1))
    assert {r["_map_version"] for r in records.select("_map_version").distinct().collect()} == {1}
    moved = [s for s in first if first[s] != second[s]]
    assert len(first) == len(second) == 128 and len(moved) < 64  # edited, not dealt anew
    sums = slots.slot_bytes(records.selectExpr("_slot as slot", "_size as size"), 128)
    grown = {r["slot"]: r["shard"] for r in slots.with_shard(slots.load_map(spark, folder), sums, 5).collect()}
    assert all(grown[s] == second[s] or grown[s] == 5 for s in second) and 5 in grown.values()


def test_mixing_targets_and_budget(spark, make_docs):
    rows = [(i, "word " * (1 + i % 9), s) for s, n in (("a", 300), ("b", 900), ("c", 60), (None, 200)) for i in range(n)]
    out = mixing.mix_sources(make_docs(rows)).collect()
    again = mixing.mix_sources(make_docs(rows)).collect()
    sizes, taken, target = Counter(), Counter(), {}
    for r in out:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] <= 3 * r["size"] and r["taken"] in (r["size"] * r["epochs"], r["size"] * (r["epochs"] + 1))
    assert plain(out, "doc_id", "source", "taken") == plain(again, "doc_id", "source", "taken")
    total, weight, capped = sum(sizes.values()), {"a": 1, "b": 2, "c": 3, None: 1}, set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        level = left / sum(w for s, w in weight.items() if s not in capped)
        new = {s for s in weight if s not in capped and level * weight[s] > 3 * sizes[s]}
        if not new:
            break
        capped |= new
    for s in weight:
        want = 3 * sizes[s] if s in capped else level * weight[s]
        assert abs(target[s] - want) < 1e-6 and abs(taken[s] - want) <= 9
    assert capped == {"c"}


def test_mixing_prefers_quality(make_docs):
    rows = [(i, "plain words in a row" if i % 2 else "@@ ## %% $$ &&", "a") for i in range(1000)] + [(i, "more and more words of it", "b") for i in range(1000, 1300)]
    picked = Counter(r["doc_id"] % 2 for r in mixing.mix_sources(make_docs(rows)).where("source = 'a' and picked").collect())
    assert picked[1] > 1.5 * picked[0]


def test_mixing_picks_by_given_weights(spark):
    """Which documents the fractional epoch takes, recomputed from the keys in a plain loop."""
    rows = [(i, "word " * (1 + i % 7), "ab"[i // 11 % 2], [None, 0.0, 0.4, 0.9, 7.0][i % 5]) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, quality double").repartition(3)
    out = mixing.mix_sources(docs, ranges=8, weight=F.col("quality")).collect()
    crc = {i: zlib.crc32(t.encode()) for i, t, _, _ in rows}
    ids = spark.createDataFrame([(i, c) for i, c in crc.items()], "doc_id long, c long")
    u = {r["doc_id"]: (r["h"] % (1 << 52) + 0.5) / (1 << 52) for r in ids.select("doc_id", F.xxhash64(F.lit(17), "doc_id", "c").alias("h")).collect()}
    key = {i: -math.log(u[i]) / min(1.0, max(0.25, 0.25 if q is None else q)) for i, _, _, q in rows}
    for source in "ab":
        found = sorted((r for r in out if r["source"] == source), key=lambda r: key[r["doc_id"]])
        budget = found[0]["target"] - found[0]["epochs"] * found[0]["source_size"]
        ahead, want = 0, []
        for r in found:
            want.append(ahead + r["size"] / 2 <= budget and ahead < budget)
            ahead += r["size"]
        assert [r["picked"] for r in found] == want and 0 < sum(want)
    heavy = Counter(rows[r["doc_id"]][3] for r in out if r["picked"] and r["source"] == "b")
    assert heavy[7.0] + heavy[0.9] > heavy[0.0] + heavy[None]


def test_repeated_by_a_weight_column(spark):
    docs = spark.createDataFrame([(i, "one two three", "a" if i < 400 else "b", float(i % 2)) for i in range(600)], "doc_id long, text string, source string, q double")
    out = mixing.repeated(docs, weight="q")
    assert out.columns == docs.columns
    times = Counter(r["doc_id"] for r in out.where("source = 'a'").collect())
    assert sum(n for i, n in times.items() if i % 2) > 1.5 * sum(n for i, n in times.items() if i % 2 == 0)


def test_no_range_is_crowded_by_light_documents(spark):
    keyed = spark.range(50_000).select(((F.pmod(F.xxhash64("id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)).alias("u")).select((-F.log("u") / mixing.LEAST).alias("k"))
    most = keyed.groupBy(F.floor((1 - F.exp(-F.col("k") * mixing.LEAST)) * 1024)).count().agg(F.max("count")).first()[0]
    assert most < 50_000 * 3 / 1024


def test_mixing_edge(edge_docs, no_docs):
    assert mixing.mix_sources(edge_docs).count() == len(EDGE) and mixing.mix_sources(no_docs).count() == 0
    assert {r["taken"] for r in mixing.mix_sources(edge_docs).where("size = 0").collect()} == {0}
    out = mixing.repeated(edge_docs)
    assert out.columns == edge_docs.columns and out.count() == sum((r["taken"] // r["size"]) for r in mixing.mix_sources(edge_docs).where("size > 0").collect())


def test_kept_digest_matches_hashlib(spark, make_docs):
    row = lines.dedup_lines(make_docs([(1, "ä\nb", "a")]), 10).selectExpr("sha2(encode(text, 'UTF-8'), 256) as h").first()
    assert row["h"] == hashlib.sha256("ä\nb".encode()).hexdigest()
