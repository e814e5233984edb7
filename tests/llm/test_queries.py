"""The registered queries on the smallest data: contract columns, SQL, and the pipeline stage by stage."""

import re
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from inkgrid.llm import decontam, mixing, quality
from inkgrid.llm.common import written
from inkgrid.llm.queries import ORACLES, QUERIES
from llm_helpers import kept_by_hand, lower

CONTRACT = {
    "op1_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op2_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op3_decontamination": {"doc_id": "bigint", "item_id": "bigint"},
    "op4_html": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op5_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op6_lines": {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "kept_sha256": "string"},
    "op7_licenses": {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"},
    "op8_quality": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op9_scoring": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op10_jaccard": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op11_merkle": {"doc_id": "bigint", "leaf": "string", "subroot": "string", "root": "string", "proof_sha256": "string", "folded_root": "string", "verified": "boolean"},
    "op12_resampling": {"doc_id": "bigint", "n_features": "bigint", "weight": "bigint", "score": "bigint", "rank": "bigint"},
    "op13_langid": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
}


@pytest.mark.parametrize("name", list(QUERIES))
def test_contract_and_rows(spark, sf_dir, name):
    out = QUERIES[name](spark, sf_dir)
    kinds = dict(out.dtypes)
    assert {c: kinds[c] for c in CONTRACT[name]} == CONTRACT[name]
    rows = out.collect()
    whole = spark.read.parquet(f"{sf_dir}/{'pages' if 'page_id' in kinds else 'documents'}.parquet").count()
    assert 0 < len(rows) < whole if name == "op3_decontamination" else len(rows) == whole
    if name in ORACLES:
        con = duckdb.connect()
        for table in ("documents", "pages", "benchmark"):
            con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
        result = con.execute(ORACLES[name])
        names = [c[0] for c in result.description]
        assert Counter(result.fetchall()) == Counter(tuple(r[c] for c in names) for r in rows) and set(names) == set(kinds)


def test_pipeline_stage_by_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    before = docs.collect()
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_copies", "decontamination", "mixing", "sharding"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf_dir), f"test-{name}")
        kept[name] = docs.collect()
        assert docs.columns[:5] == corpus_pipeline.COLUMNS

    rules = quality.fit(spark.createDataFrame(before, spark.read.parquet(f"{sf_dir}/documents.parquet").schema), labels)
    want = set()
    for r in before:
        n, *_, repeated, mean = quality.figures(r["text"].encode(), rules.ratio)
        if n >= 50 and 100 * repeated <= 50 * n and mean >= rules.cut:
            want.add(r["doc_id"])
    assert {r["doc_id"] for r in kept["quality"]} == want

    assert sorted(r["doc_id"] for r in kept["near_copies"]) == kept_by_hand([(r["doc_id"], r["text"], r["source"]) for r in kept["quality"]])

    items = [decontam.normal(r["text"].encode()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    leaked = {r["doc_id"] for r in kept["near_copies"] if any(x in decontam.normal(r["text"].encode()) for x in items)}
    assert {r["doc_id"] for r in kept["decontamination"]} == {r["doc_id"] for r in kept["near_copies"]} - leaked

    times = Counter(r["doc_id"] for r in kept["mixing"])
    sizes = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", lower(r["text"]))) for r in kept["decontamination"]}
    mixed = mixing.mix_sources(spark.createDataFrame(kept["decontamination"])).collect()
    assert {r["doc_id"]: r["taken"] for r in mixed} == {i: n * times[i] for i, n in sizes.items()} and max(times.values()) <= 3

    assert Counter((r["doc_id"], r["text"]) for r in kept["sharding"]) == Counter((r["doc_id"], r["text"]) for r in kept["mixing"])
    load = Counter()
    for r in kept["sharding"]:
        load[r["shard"]] += r["size"]
    assert max(load.values()) - sum(load.values()) / 40 <= max(r["size"] for r in kept["sharding"])
