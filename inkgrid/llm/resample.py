"""Resampling a corpus towards a target distribution by the importance of its hashed n-grams.

Two histograms of fixed size, of the corpus and of the target, give every bucket a
gain; a document weighs the mean gain of its n-grams, looked up in one array.
Adding Gumbel noise and taking the highest scores draws without replacement.  The
cutoff among the scores is found by a quantile sketch: it gives a bracket, exact
counts outside prove the bracket right or widen it, and only the rows inside are
sorted.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgrid.llm.common import numbered, payloads, written

BUCKETS = 10_000
SEED, MIN_WORDS, PERCENT = 7, 20, 25
#: Numbers that are counted before they are added up in the histogram.
_CHUNK = 1 << 18
#: Rank error of the sketch as a share of all rows, and how much wider each further bracket is.
ERROR, WIDER = 0.002, 8
SCORES = "uid long, doc_id long, n_features long, n_words long, weight long, score long"
_BLANKED = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and all bytes beyond ASCII, A-Z lower-cased."""
    return text.translate(_BLANKED).split()


def feature_buckets(words: list[bytes], buckets: int) -> np.ndarray:
    """CRC-32 modulo ``buckets`` of all words and of all pairs of neighbours joined by a blank."""
    n = len(words)
    out = np.empty(max(0, 2 * n - 1), np.uint32)
    first = list(map(crc32, words))
    out[:n] = first
    out[n:] = list(map(crc32, [b" " + w for w in words[1:]], first))  # carried on from the first word's sum
    return out % np.uint32(buckets)


def histogram(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all rows of ``texts``: tasks count their own, one row per bucket comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for text in payloads(batch, "text"):
                held.append(feature_buckets(words_of(text), buckets))
                size += len(held[-1])
                if size >= _CHUNK:
                    total += np.bincount(np.concatenate(held), minlength=buckets)
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], names=["bucket", "n"])

    sums = texts.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in sums.collect():
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of both smoothed distributions, rounded down."""
    k, all_c, all_t = len(corpus), int(corpus.sum()), int(target.sum())
    ratios = [float((int(t) + 1) * (all_c + k)) / float((int(s) + 1) * (all_t + k)) for s, t in zip(corpus, target, strict=True)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise in thousandths from the id alone; a null id counts as an empty one."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gains: np.ndarray, seed: int = SEED) -> DataFrame:
    """``uid, doc_id, n_features, n_words, weight, score`` of every row."""
    table = docs.sparkSession.sparkContext.broadcast(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = table.value
        for batch in batches:
            ids, words, features, weights = batch.column("doc_id").to_pylist(), [], [], []
            for text in payloads(batch, "text"):
                hit = feature_buckets(found := words_of(text), len(gain))
                words.append(len(found))
                features.append(len(hit))
                weights.append(int(gain[hit].sum()) // len(hit) if len(hit) else 0)
            scores = [w + noise(i, seed) for i, w in zip(ids, weights, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in (features, words, weights, scores)]],
                                             names=[x.split()[0] for x in SCORES.split(", ")])

    return docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCORES)


def _order() -> list[Column]:
    return [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("uid").asc()]


def bracket(rows: DataFrame, total: int, wanted: int, error: float = ERROR) -> tuple[int, int, int]:
    """``low, high, above``: the ``wanted``-th highest score lies within, and ``above`` rows have a score over ``high``.

    A sketch of all scores proposes both ends.  The rows outside are counted exactly;
    if the wanted row is not inside, the bracket is widened, at last to all scores.
    """
    while True:
        at = 1 - wanted / total
        ends = [min(1.0, max(0.0, at - error)), min(1.0, max(0.0, at + error))]
        low, high = rows.agg(F.percentile_approx("score", ends, max(1, int(2 / error)))).first()[0]
        if error >= 1:
            low, high = rows.agg(F.min("score"), F.max("score")).first()
        above, upto = rows.agg(F.count_if(F.col("score") > high), F.count_if(F.col("score") >= low)).first()
        if above < wanted <= upto:
            return low, high, above
        error *= WIDER


def draw_rule(rows: DataFrame, percent: int = PERCENT, error: float = ERROR) -> Column:
    """A condition true for the ``floor(percent * N / 100)`` highest scores of ``rows``, ties to the smaller ``doc_id``.

    ``rows`` has ``score``, ``doc_id`` and a ``uid`` that tells repeated rows apart.
    """
    total = rows.count()
    wanted = percent * total // 100
    if not wanted:
        return F.lit(False)
    low, high, above = bracket(rows, total, wanted, error)
    inside = numbered(rows.where(F.col("score").between(low, high)).withColumn("_all", F.lit(0)), ["_all"], _order(), "resample-bracket")
    last = inside.where(F.col("pos") == wanted - above - 1).select("score", "doc_id", "uid").first()
    same = F.col("score") == last["score"]
    before = F.coalesce(F.col("doc_id") < last["doc_id"], F.lit(False)) if last["doc_id"] is not None else F.col("doc_id").isNotNull()
    tied = F.col("doc_id").eqNullSafe(F.lit(last["doc_id"])) & (F.col("uid") <= last["uid"])
    return (F.col("score") > last["score"]) | (same & (before | tied))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, buckets: int = BUCKETS, error: float = ERROR) -> DataFrame:
    """``uid, doc_id, n_features, n_words, weight, score, rank``: every row of ``docs``, with its rank if it is drawn.

    ``target`` is a table with a ``text``.  Null and empty texts have no features,
    weigh 0 and are too short to be drawn.  Repeated rows have equal scores and
    are ranked one after the other; null ids come after others.  Other columns are
    ignored.  An empty target leaves all gains to the corpus; an empty table gives
    an empty result.
    """
    gains = bucket_gains(histogram(docs, buckets), histogram(target, buckets))
    rows = written(scored(docs, gains, seed), "resample-scores")
    enough = F.col("n_words") >= min_words
    drawn = enough & draw_rule(rows.where(enough), percent, error)
    ranked = numbered(rows.where(drawn).withColumn("_all", F.lit(0)), ["_all"], _order(), "resample-ranks").select(*rows.columns, (F.col("pos") + 1).alias("rank"))
    return ranked.unionByName(rows.where(~drawn).withColumn("rank", F.lit(None).cast("long")))
