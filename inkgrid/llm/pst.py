"""Scoring by a probabilistic suffix tree over bytes.

Counts of the contexts of up to ``DEPTH`` bytes and their next bytes are gathered
from all training documents.  A context becomes a state if it occurs more than once
and its next-byte distribution diverges from that of its suffix; distributions are
smoothed; every byte is scored in the state of its longest suffix.  States and the
probabilities of all contexts with their next bytes are tables that grow with the
corpus; the documents are joined to them.
A smoothed unigram model of words is scored beside it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrid.llm.common import payloads, word_hashes, written

#: Longest context in bytes; with the next byte it fills a 64-bit key, so at most 7.
DEPTH = 5
#: Least count of a state's context.  The number of states follows the corpus.
LEAST = 2
#: Least share of a state's context of all positions; any share above 0 caps the number of states.
P_MIN = 0.0
#: Least gain of a state over its suffix: count times divergence, in nats.
GAIN = 10.0
SMOOTH = 0.01
#: Words with at least this share of all tokens are looked up in the task (at most 1 / COMMON of them), the others by a join.
COMMON = 1e-6
#: Likewise for contexts with their next byte and their share of all positions.
COMMON_GRAMS = 2.5e-7
_GROUP = 1 << 20
_END = b"\n"  # cannot be part of a normalised text
_COUNT = pa.schema([("kind", pa.int8()), ("key", pa.int64()), ("n", pa.int64())])
SCORES = "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<bigint>, rare_grams array<bigint>"


def held_out(doc_id: int | None) -> bool:
    """Ids with remainder 1 are kept out of training; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


def normal(words: list[bytes]) -> bytes:
    return b" ".join(words)


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(n, first) if len(k) else n


class _Sums:
    """Counts of int64 keys, merged now and then."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def add(self, values: np.ndarray) -> None:
        k, n = np.unique(values, return_counts=True)
        self.keys.append(k), self.counts.append(n)
        if len(self.keys) >= 16:
            k, n = _merged(self.keys, self.counts)
            self.keys, self.counts = [k], [n]

    def rows(self, kind: int) -> Iterator[pa.RecordBatch]:
        k, n = _merged(self.keys, self.counts)
        for at in range(0, len(k), 200_000):
            part = slice(at, at + 200_000)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k[part]), kind, np.int8)), pa.array(k[part]), pa.array(n[part])], schema=_COUNT)


def _grams(buffer: np.ndarray, depth: int) -> np.ndarray:
    """For every position from ``depth`` on: the ``depth`` bytes before it and the byte itself, as one number."""
    total = np.zeros(len(buffer) - depth, np.int64)
    for back in range(depth, -1, -1):
        total = (total << 8) | buffer[depth - back:len(buffer) - back]
    return total


def count(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``kind, key, n``: word hashes (0) and contexts with their next byte (1) of the training documents, the latter also of the others (2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, grams = _Sums(), {False: _Sums(), True: _Sums()}
        held: dict[bool, list[bytes]] = {False: [], True: []}
        size = {False: 0, True: 0}

        def flush(out: bool) -> None:
            if held[out]:
                split = [text.split() for text in held[out]]
                if not out:
                    words.add(word_hashes([w for text in split for w in [*text, _END]]).view(np.int64))
                pad = _END * depth
                grams[out].add(np.concatenate([_grams(np.frombuffer(pad + normal(text) + _END, np.uint8).astype(np.int64), depth) for text in split]))
                held[out], size[out] = [], 0

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), payloads(batch, "text"), strict=True):
                out = held_out(doc)
                held[out].append(text.lower())
                size[out] += len(text)
                if size[out] >= _GROUP:
                    flush(out)
        flush(False), flush(True)
        yield from words.rows(0)
        yield from grams[False].rows(1)
        yield from grams[True].rows(2)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "kind byte, key long, n long")
    return rows.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def levels(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``depth, context, symbol, n, uses`` of all contexts of up to ``depth`` bytes: how often in training, and in all documents.

    Contexts hold the latest byte lowest, so a suffix is a mask.
    """
    rows = counts.where("kind > 0").select(F.shiftrightunsigned("key", 8).alias("full"), F.col("key").bitwiseAND(F.lit(255)).alias("symbol"), F.when(F.col("kind") == 1, F.col("n")).otherwise(0).alias("n"), F.col("n").alias("uses"))
    rows = rows.withColumn("depth", F.explode(F.array(*[F.lit(d) for d in range(depth + 1)])))
    return rows.groupBy("depth", F.col("full").bitwiseAND(F.expr("(1L << (8 * depth)) - 1L")).alias("context"), "symbol").agg(F.sum("n").alias("n"), F.sum("uses").alias("uses"))


def states(level: DataFrame, total: int, least: int = LEAST, p_min: float = P_MIN, gain: float = GAIN) -> DataFrame:
    """``depth, context, total`` of the retained states; the root is always one."""
    totals = level.groupBy("depth", "context").agg(F.sum("n").alias("total"))
    trained = level.where("n > 0").join(totals, ["depth", "context"])
    parent = trained.select((F.col("depth") + 1).alias("depth"), F.col("context").alias("suffix"), "symbol", (F.col("n") / F.col("total")).alias("q"))
    own = trained.where((F.col("depth") > 0) & (F.col("total") >= max(least, p_min * total))).withColumn("suffix", F.col("context").bitwiseAND(F.expr("(1L << (8 * (depth - 1))) - 1L")))
    gains = own.join(parent, ["depth", "suffix", "symbol"]).groupBy("depth", "context", "total").agg(F.sum(F.col("n") * F.log(F.col("n") / F.col("total") / F.col("q"))).alias("gain"))
    return gains.where(F.col("gain") >= gain).select("depth", "context", "total").unionByName(totals.where("depth = 0"))


def probabilities(level: DataFrame, kept: DataFrame, depth: int = DEPTH, smooth: float = SMOOTH) -> DataFrame:
    """``key, uses, log10`` of every context of ``depth`` bytes with its next byte, by its longest suffix among the states ``kept``.

    From level to level a context that is no state takes over what its suffix has, so that no join meets more than 256 rows of a key.
    """
    found = None
    for d in range(depth + 1):
        rows = level.where(F.col("depth") == d).select("context", "symbol", "n", "uses").join(kept.where(F.col("depth") == d).select("context", "total"), "context", "left")
        own = F.log10((F.col("n") + smooth) / (F.col("total") + 256 * smooth))
        if found is None:
            found = rows.select("context", "symbol", "uses", own.alias("log10"))
            continue
        above = found.select(F.col("context").alias("suffix"), "symbol", F.col("log10").alias("above"))
        rows = rows.withColumn("suffix", F.col("context").bitwiseAND(F.lit((1 << 8 * (d - 1)) - 1))).join(above, ["suffix", "symbol"])
        found = rows.select("context", "symbol", "uses", F.coalesce(own, "above").alias("log10"))
    return found.select(F.shiftleft("context", 8).bitwiseOR(F.col("symbol")).alias("key"), "uses", "log10")


def _sorted(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    return keys[order], values[order]


def _look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``wanted`` are among the sorted ``keys``, and the values of these."""
    if not len(keys):
        return np.zeros(len(wanted), bool), values
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = keys[place] == wanted
    return hit, values[place[hit]]


def score(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``uid, doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    Training takes the documents whose crc32 of the id leaves no remainder 1 by 5.
    A null or empty text is just its end.  Repeated rows count and come out as often
    as they occur.  Without any training document every token has probability one
    in the base score's terms (no vocabulary) and the tree is its smoothed root.
    Words and contexts that are common are looked up in the task, in tables of bounded
    size; all others are joined, with the same result.
    """
    if not 0 < depth < 8:
        raise ValueError("contexts have 1 to 7 bytes")
    spark = docs.sparkSession
    counts = written(count(docs, depth), "pst-counts")
    vocabulary = counts.where("kind = 0").select("key", F.col("n").alias("c"))
    sizes = {r["kind"]: (r["n"], r["v"]) for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    tokens, distinct = sizes.get(0, (0, 0))
    symbols = sizes.get(1, (0, 0))[0]
    scale = tokens + 0.5 * (distinct + 1)
    level = written(levels(counts, depth), "pst-levels")
    kept = written(states(level, symbols), "pst-states")
    grams = written(probabilities(level, kept, depth), "pst-grams")
    least, often = max(1, COMMON * tokens), max(1, COMMON_GRAMS * (symbols + sizes.get(2, (0, 0))[0]))
    words = vocabulary.where(F.col("c") >= least).toArrow()  # at most 1 / COMMON words
    frequent = grams.where(F.col("uses") >= often).select("key", "log10").toArrow()  # at most 1 / COMMON_GRAMS
    common = spark.sparkContext.broadcast((
        _sorted(words["key"].to_numpy(), np.log10((words["c"].to_numpy().astype(float) + 0.5) / scale)), _sorted(frequent["key"].to_numpy(), frequent["log10"].to_numpy())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids, ids, texts = batch.column("uid").to_pylist(), batch.column("doc_id").to_pylist(), payloads(batch, "text")
            at = 0
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and (stop == at or size < _GROUP):
                    size += len(texts[stop])
                    stop += 1
                yield _scored(uids[at:stop], ids[at:stop], texts[at:stop], *common.value, depth)
                at = stop

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCORES)
    rows = written(rows, "pst-scores")
    missed = [rows.where(F.size(c) > 0).select("uid", F.lit(kind).alias("kind"), F.explode(c).alias("key")) for kind, c in ((0, "rare"), (1, "rare_grams"))]
    values = vocabulary.where(F.col("c") < least).select(F.lit(0).alias("kind"), "key", F.log10((F.col("c") + 0.5) / F.lit(float(scale))).alias("log10"))
    values = values.unionByName(grams.where(F.col("uses") < often).select(F.lit(1).alias("kind"), "key", "log10"))
    unknown = F.log10(F.lit(0.5) / F.lit(float(scale)))
    rare = missed[0].unionByName(missed[1]).join(values, ["kind", "key"], "left").groupBy("uid").agg(
        F.count(F.when(F.col("kind") == 0, F.col("log10"))).alias("_known"), F.sum(F.when(F.col("kind") == 0, F.coalesce("log10", unknown))).alias("_base"), F.sum(F.when(F.col("kind") == 1, F.col("log10"))).alias("_score"))
    return rows.join(rare, "uid", "left").select(
        "uid", "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("_base", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("_score", F.lit(0.0))).alias("score"))


def _lists(of: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32()), pa.array(values, pa.int64()))


def _scored(uids: list, ids: list, texts: list[bytes], words: tuple[np.ndarray, np.ndarray], frequent: tuple[np.ndarray, np.ndarray], depth: int) -> pa.RecordBatch:
    n = len(texts)
    split = [t.lower().split() for t in texts]
    hashes = word_hashes([w for each in split for w in [*each, _END]]).view(np.int64)
    lengths = np.array([len(w) + 1 for w in split])
    owner = np.repeat(np.arange(n), lengths)
    hit, values = _look_up(*words, hashes)
    known, base = np.bincount(owner[hit], minlength=n), np.bincount(owner[hit], weights=values, minlength=n)
    rare = _lists(owner[~hit], hashes[~hit], n)

    score, missed, of = np.zeros(n), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k, each in enumerate(split):
        data = np.frombuffer(_END * depth + normal(each) + _END, np.uint8)
        for at in range(0, len(data) - depth, _GROUP):
            grams, times = np.unique(_grams(data[at:at + _GROUP + depth].astype(np.int64), depth), return_counts=True)
            hit, values = _look_up(*frequent, grams)
            score[k] += values @ times[hit]
            rest = np.repeat(grams[~hit], times[~hit])
            missed.append(rest), of.append(np.full(len(rest), k))
    return pa.RecordBatch.from_arrays([
        pa.array(uids, pa.int64()), pa.array(ids, pa.int64()), pa.array([held_out(i) for i in ids]), pa.array(lengths, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()),
        pa.array(score, pa.float64()), rare, _lists(np.concatenate(of), np.concatenate(missed), n),
    ], names=[x.split()[0] for x in SCORES.split(", ")])
