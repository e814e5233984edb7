"""The registered queries of the corpus operators, each over its whole table, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgrid.llm import decontam, html_blocks, jaccard, langcodes, licenses, lines, merkle, mixing, pst, quality, resample, slots, warc
from inkgrid.llm.common import written
from inkgrid.session import run_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as deduplicated WARC archives and read back, revisits joined to their originals."""
    folder = run_dir(spark, "warc")
    warc.write_deduplicated(_table(spark, sf_dir, "pages"), folder, min_bytes=0)
    records = written(warc.read_archives(spark, folder).drop("block"), "warc-records")
    return warc.join_revisits(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 40 shards of near equal bytes by way of virtual slots; ``slot`` is the place within the shard."""
    sharded = slots.number_rows(slots.shard_records(_table(spark, sf_dir, "documents").select("doc_id", "text"), 40))
    return sharded.select("doc_id", F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("_shard").alias("shard"), F.col("_place").cast("long").alias("slot"),
                          F.lit(None).cast("int").alias("grown_shard"), F.col("_slot").alias("virtual_slot"), F.col("_map_version").alias("map_version"))


@_query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every region of a document that matches a benchmark item within the edit budget."""
    return decontam.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("uid")


@_query
def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_blocks.extract(_table(spark, sf_dir, "pages"))


@_query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document enter the mix."""
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@_query
def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them share, as digests."""
    kept = lines.dedup_lines(_table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


@_query
def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in every document."""
    return licenses.scan(_table(spark, sf_dir, "documents"))


@_query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and verdict of every document."""
    docs = _table(spark, sf_dir, "documents")
    return quality.apply_rules(docs, quality.fit(docs, _table(spark, sf_dir, "labels"))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


@_query
def op9_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and suffix-tree log probabilities of every document."""
    return pst.score(_table(spark, sf_dir, "documents")).drop("uid")


@_query
def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets agree to 90 percent."""
    return jaccard.link_components(_table(spark, sf_dir, "documents"))


@_query
def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests, proofs and their check against tampered texts for every document."""
    path = F.col("path")
    rows = merkle.manifest(_table(spark, sf_dir, "documents")).select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest(path).alias("proof_sha256"), merkle.folded(F.coalesce("tampered", "leaf"), path).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


@_query
def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents drawn towards the distribution of the benchmark."""
    rows = resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


@_query
def op13_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from four fifths of them."""
    docs = _table(spark, sf_dir, "documents")
    held = langcodes.held_out(F.col("doc_id"))
    model = langcodes.fit(docs.where(~held))
    return langcodes.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "runner_up", "ambiguous")


_DIGITS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
ORACLES["op1_warc"] = f"""
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, cast(octet_length(encode(h)) as bigint) as payload_bytes, sha1(h) as x from p),
b as (select page_id, payload_bytes, (select string_agg(substr({_DIGITS}, 1 + cast((cast(('0x' || substr(x, 1 + 10 * (i // 8), 10)) as bigint) >> (35 - 5 * (i % 8))) & 31 as int), 1), '' order by i)
      from (select unnest(range(32)) as i)) as payload_digest from d),
f as (select *, min(page_id) over (partition by payload_digest) as first_id from b)
select page_id, payload_bytes, payload_digest, case when page_id = first_id then 'response' else 'revisit' end as record_type,
       case when page_id <> first_id then first_id end as refers_to from f
"""
ORACLES["op6_lines"] = """
with base as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents),
e as (select r, doc_id, unnest(l) as line, generate_subscripts(l, 1) as i from base),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from e),
s as (select key from (select distinct key, doc_id from k) where length(key) >= 1 group by key having count(*) >= 10)
select any_value(doc_id) as doc_id, count(*) as n_lines, count(s.key) as n_dropped,
       sha256(coalesce(string_agg(case when s.key is null then line end, chr(10) order by i), '')) as kept_sha256
from k left join s using (key) group by r
"""

#: CRC-32 of a string's UTF-8 bytes; ``crc_table.t`` holds the remainders of single bytes.
_CRC_TABLE = """crc_table as (select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t)"""


def _crc_sql(value: str) -> str:
    octets = f"list_transform(range(octet_length(encode({value}))), lambda i: cast('0x' || substr(hex(encode({value})), 1 + 2 * i, 2) as bigint))"
    return f"xor(4294967295, list_reduce(list_concat([4294967295], {octets}), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])))"


def _merkle_sql(levels: int = 7, fanout: int = 16) -> str:
    """Trees of up to ``fanout ** levels`` leaves, level by level, first per source, then over the sources."""

    def row(text: str) -> str:
        return "sha256(" + " || ".join(f"coalesce(octet_length(encode(cast({c} as varchar))) || ':' || cast({c} as varchar), '-')" for c in ["doc_id", "source", "lang", "n_chars", text]) + ")"

    def grow(name: str) -> str:
        return ",\n".join(
            f"{name}{k} as (select tree, pos // {fanout} as pos, sha256(string_agg(digest, '' order by pos)) as digest, ceil(any_value(n) / {fanout}) as n from {name}{k - 1} where n > 1 group by tree, pos // {fanout})"
            for k in range(1, levels + 1))

    def fold(name: str, first: str) -> str:
        out, before = [], first
        for k in range(levels):
            out.append(
                f"{name}_f{k} as (select f.r, any_value(f.tree) as tree, any_value(f.pos) // {fanout} as pos, case when any_value(o.n) > 1 then any_value(f.proof) || coalesce(string_agg(o.digest, '' order by o.pos) filter (where o.pos <> f.pos), '') else any_value(f.proof) end as proof,"
                f" case when any_value(o.n) > 1 then sha256(string_agg(case when o.pos = f.pos then f.acc else o.digest end, '' order by o.pos)) else any_value(f.acc) end as acc"
                f" from {before} f left join {name}{k} o on o.tree = f.tree and o.pos // {fanout} = f.pos // {fanout} group by f.r)")
            before = f"{name}_f{k}"
        return ",\n".join(out)

    tops = " union all ".join(f"select tree, digest from low{k} where n = 1" for k in range(levels + 1))
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
with {_CRC_TABLE},
base as (select row_number() over () as r, doc_id, source, {row("text")} as leaf, case when {_crc_sql("cast(doc_id as varchar)")} % 5 = 0 then {row(lower)} end as tampered from documents, crc_table),
low0 as (select r, doc_id, tampered, leaf as digest, coalesce('s' || source, '') as tree, row_number() over (partition by source order by doc_id nulls first, leaf, r) - 1 as pos, count(*) over (partition by source) as n from base),
{grow("low")},
tops as ({tops}),
high0 as (select tree as name, '' as tree, digest, row_number() over (order by tree) - 1 as pos, count(*) over () as n from tops),
{grow("high")},
root as ({" union all ".join(f"select digest as root from high{k} where n = 1" for k in range(levels + 1))}),
start as (select r, tree, pos, '' as proof, coalesce(tampered, digest) as acc from low0),
{fold("low", "start")},
mid as (select f.r, '' as tree, h.pos, f.proof, f.acc from low_f{levels - 1} f join high0 h on h.name = f.tree),
{fold("high", "mid")}
select l.doc_id, l.digest as leaf, t.digest as subroot, root, sha256(proof) as proof_sha256, acc as folded_root, acc = root as verified
from high_f{levels - 1} f join low0 l using (r) join tops t on t.tree = l.tree, root
"""


ORACLES["op11_merkle"] = _merkle_sql()
_WORDS_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES["op12_resampling"] = f"""
with {_CRC_TABLE},
w as (select row_number() over () as r, doc_id, coalesce({_WORDS_SQL}, []) as w, true as own from documents union all select 0, null, {_WORDS_SQL}, false from benchmark where text is not null),
f as (select r, own, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as feature from w),
c as (select feature, {_crc_sql("feature")} % 10000 as bucket from (select distinct feature from f), crc_table),
b as (select r, own, bucket from f join c using (feature)),
h as (select bucket, count(*) filter (where own) as s, count(*) filter (where not own) as t from b group by bucket),
a as (select (select count(*) from b where own) as s_all, (select count(*) from b where not own) as t_all),
g as (select bucket, cast(floor(1000 * ln((cast(t + 1 as double) * cast(s_all + 10000 as double)) / (cast(s + 1 as double) * cast(t_all + 10000 as double)))) as bigint) as gain from h, a),
m as (select r, count(*) as n_features, cast(floor(sum(gain) / count(*)) as bigint) as weight from b join g using (bucket) where own group by r),
d as (select r, doc_id, len(w) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
      coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('7:' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) + 0.5::double) / 4294967296::double))) as bigint) as score from w left join m using (r) where own),
e as (select r, row_number() over (order by score desc, doc_id nulls last, r) as place, count(*) over () as n_all from d where n_words >= 20)
select doc_id, n_features, weight, score, case when place <= 25 * n_all // 100 then place end as rank from d left join e using (r)
"""
