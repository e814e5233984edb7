"""Quality rules and a log-likelihood ratio of hashed n-grams.

Two multinomials over hashed word 1- and 2-grams: one from trusted documents, one
from the whole corpus.  A document's score is its log-likelihood ratio divided by
its number of n-grams; every document is kept or rejected by one fixed threshold.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrid.llm.common import fixed_table, mix, payloads, sliced, word_hashes

BUCKETS = 1 << 16
PARTS = 64
#: Documents of known quality used for the trusted counts and the threshold, per class.  The rest of the statistics covers the corpus.
SAMPLE = 20_000
FEATURES = "uid long, doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double"
_WORDLESS = re.compile(rb"[\x20\x09-\x0D]*\Z")
_CELLS = pa.schema([("part", pa.int32()), ("cells", pa.binary())])


def gram_buckets(hashes: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of all words and of all pairs of neighbours."""
    pairs = mix(hashes[:-1] * np.uint64(3) + hashes[1:])
    return (np.concatenate([hashes, pairs]) & np.uint64(buckets - 1)).astype(np.int64)


def base_rules(text: bytes, words: list[bytes], hashes: np.ndarray) -> tuple[int, int, int, int]:
    """``word_chars, n_symbols, n_dup_lines, n_repeat_words`` of one text."""
    packed = b"".join(words)
    chars = len(packed) - int(np.count_nonzero((np.frombuffer(packed, np.uint8) & 0xC0) == 0x80)) if packed else 0
    symbols = len(text) - len(text.translate(None, b"#*$%&|<>"))
    lines = [x for x in text.split(b"\n") if not _WORDLESS.match(x)]
    repeated = 0
    if len(hashes) >= 3:
        windows = mix(hashes[:-2] * np.uint64(5) + mix(hashes[1:-1] * np.uint64(3) + hashes[2:]))
        _, back, times = np.unique(windows, return_inverse=True, return_counts=True)
        twice = np.flatnonzero(times[back] > 1)
        covered = np.zeros(len(hashes), bool)
        for step in range(3):
            covered[twice + step] = True
        repeated = int(covered.sum())
    return chars, symbols, len(lines) - len(set(lines)), repeated


def _sum_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, cells in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist(), strict=True):
            found = np.frombuffer(cells, np.int64)
            total[part] = total[part] + found if part in total else found
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], schema=_CELLS)


def corpus_counts(docs: DataFrame, trusted: set[int], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket counts of the trusted documents and of all documents; every task sums its own first."""
    ids = docs.sparkSession.sparkContext.broadcast(trusted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, buckets), np.int64)
        for batch in sliced(batches):
            for doc, text in zip(batch.column("doc_id").to_pylist(), payloads(batch, "text"), strict=True):
                hit = np.bincount(gram_buckets(word_hashes(text.split()), buckets), minlength=buckets)
                sums[1] += hit
                if doc in ids.value:
                    sums[0] += hit
        step = buckets // PARTS
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([sums[:, p * step:(p + 1) * step].tobytes() for p in range(PARTS)], pa.binary())], schema=_CELLS)

    parts = fixed_table(docs.select("doc_id", "text").mapInArrow(count, "part int, cells binary"), _sum_cells, "part int, cells binary")
    step = buckets // PARTS
    empty = np.zeros((2, step), np.int64)
    joined = np.concatenate([np.frombuffer(parts[p], np.int64).reshape(2, step) if p in parts else empty for p in range(PARTS)], axis=1)
    return joined[0], joined[1]


def log_ratio(trusted: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """Per bucket log p(trusted) - log p(corpus), both smoothed by the corpus: a bucket seen nowhere is neutral."""
    prior = (corpus + 0.5) / (corpus.sum() + 0.5 * len(corpus))
    weight = 0.1 * trusted.sum() + 1.0
    return np.log((trusted + weight * prior) / (trusted.sum() + weight)) - np.log(prior)


def figures(text: bytes, ratio: np.ndarray) -> tuple[int, int, int, int, int, float]:
    """Number of words, the four base figures and the mean log ratio of one text."""
    words = text.split()
    hashes = word_hashes(words)
    hit = gram_buckets(hashes, len(ratio))
    return len(words), *base_rules(text, words, hashes), float(ratio[hit].sum() / len(hit)) if len(hit) else 0.0


def features(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """Base figures and the length-normalised score of every row; ``uid`` numbers the rows."""
    table = docs.sparkSession.sparkContext.broadcast(ratio)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for text in payloads(batch, "text"):
                rows.append(figures(text, table.value))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64()] * 5 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]],
                                             names=[x.split()[0] for x in FEATURES.split(", ")])

    return docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, FEATURES)


def best_threshold(good: list[float], bad: list[float]) -> float:
    """The cut with the most rightly decided in both classes together; half way between the two scores around it."""
    if not good or not bad:
        return -math.inf
    marks = sorted([(x, 1 / len(good), 0.0) for x in good] + [(x, 0.0, 1 / len(bad)) for x in bad])
    best, cut, gain = 0.0, marks[0][0] - 1e-9, 0.0
    for (x, g, b), (y, _, _) in zip(marks, marks[1:] + [(math.inf, 0, 0)], strict=True):
        gain += b - g
        if y > x and gain > best:
            best, cut = gain, (x + y) / 2 if y < math.inf else x + 1e-9
    return cut


class Rules:
    """The fitted log ratios and the threshold."""

    def __init__(self, ratio: np.ndarray, cut: float):
        self.ratio, self.cut = ratio, cut


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Rules:
    """Counts over all of ``docs``; ``labels`` (``doc_id, quality``) names trusted (1) and poor (0) documents.

    At most ``sample`` of each class are used, chosen by a hash of the id.  Half of
    the trusted ones give the counts; the threshold is fitted to the scores of the
    other half and of the poor ones, as far as they pass the base rules.  Without
    both classes only the base rules decide.  A null id is never trusted.
    """
    order = F.xxhash64("doc_id")
    chosen = [
        [r[0] for r in labels.where((F.col("quality") == q) & F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(order, "doc_id").limit(sample).collect()]
        for q in (1, 0)
    ]
    trusted, corpus = corpus_counts(docs, set(chosen[0][::2]))
    ratio = log_ratio(trusted, corpus)
    known = docs.sparkSession.createDataFrame([(i, q) for q, ids in ((1, chosen[0][1::2]), (0, chosen[1])) for i in ids], "_id long, q int")
    scored = apply_rules(docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("_id"), "left_semi"), Rules(ratio, -math.inf)).where("kept")
    scored = scored.join(F.broadcast(known), F.col("doc_id") == F.col("_id")).groupBy("_id", "q").agg(F.min("score").alias("score")).collect()  # at most 2 * sample rows
    return Rules(ratio, best_threshold(*[[r["score"] for r in scored if r["q"] == q] for q in (1, 0)]))


def apply_rules(docs: DataFrame, rules: Rules) -> DataFrame:
    """``uid, doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score, base_failed, kept`` per row.

    Null and empty texts have no words and fail.  Repeated rows each get their own,
    equal result; other columns are ignored.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return features(docs, rules.ratio).withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= rules.cut))


def kept_rows(docs: DataFrame, rules: Rules) -> DataFrame:
    """The rows of ``docs``, all columns, that ``apply_rules`` keeps."""
    shared = docs.sparkSession.sparkContext.broadcast(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio, cut = shared.value.ratio, shared.value.cut
        for batch in sliced(batches):
            good = []
            for text in payloads(batch, "text"):
                n, *_, repeated, mean = figures(text, ratio)
                good.append(n >= 50 and 100 * repeated <= 50 * n and mean >= cut)
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
