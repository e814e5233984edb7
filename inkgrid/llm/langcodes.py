"""Language identification by error-correcting output codes.

Every language has a codeword of bits; for each bit a binary classifier tells the
languages with a one from those with a zero by hashed byte n-grams.  A text is
decoded to the codeword with the least loss, each bit weighed by how well its
classifier tells the two sides apart; a small lead over the runner-up is flagged.

The n-gram counts per language are taken over all training rows, tasks sum their
own first, and have a fixed size.  The slope and weight of each bit are fitted on
about ``SAMPLE`` training rows a language.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from inkgrid.llm.common import fixed_table

BITS = 15
BUCKETS = 1 << BITS
GRAMS = (2, 3, 4)
PARTS = 16
#: Training rows per language from which the slopes and weights of the bits are fitted, chosen by a hash of the row.
SAMPLE = 2_000
#: A text is ambiguous if the best language has less than this share.
SURE = 0.75
UNKNOWN = "und"
RESULT = "doc_id long, lang_pred string, score double, runner_up string, ambiguous boolean"
_LETTER = regex.compile(r"\p{L}")
_BLANKED = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
_MULTIPLIERS = [np.uint32(m) for m in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)]
_CELLS = pa.schema([("part", pa.int32()), ("cells", pa.binary())])


def normal(text: str) -> bytes:
    """Lower case, everything in ASCII but letters as one blank, a blank at both ends."""
    return b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_BLANKED).split()) + b" "


def gram_buckets(buffer: bytes) -> list[np.ndarray]:
    """For each n-gram length the bucket of the n bytes from every position on."""
    data = np.frombuffer(buffer, np.uint8).astype(np.uint32)
    out = []
    for n in GRAMS:
        size = max(0, len(data) - n + 1)
        code = np.full(size, n, np.uint32)
        for k in range(n):
            code = (code ^ data[k:k + size]) * _MULTIPLIERS[k]
            code ^= code >> np.uint32(15)
        out.append((code & np.uint32(BUCKETS - 1)).astype(np.int32))
    return out


def codewords(n: int) -> np.ndarray:
    """One row of -1 and 1 per language.

    Up to five languages get the exhaustive code, all splits in two.  More get random
    columns, of which a fixed number of draws keeps the code with the largest
    smallest distance; equal and complementary columns do not occur.
    """
    if n < 2:
        return np.zeros((n, 0), np.int8)
    if n <= 5:
        columns = [c for c in itertools.product((-1, 1), repeat=n - 1) if -1 in c]
        return np.array([(1, *c) for c in columns], np.int8).T
    bits = max(15, 6 * int(np.ceil(np.log2(n))))
    rnd, best, gap = random.Random(n), None, -1
    for _ in range(50):
        columns: set[tuple[int, ...]] = set()
        while len(columns) < bits:
            column = tuple(rnd.choice((-1, 1)) for _ in range(n))
            column = tuple(-x for x in column) if column[0] < 0 else column
            if -1 in column:
                columns.add(column)
        code = np.array(sorted(columns), np.int8).T
        apart = min(int((code[a] != code[b]).sum()) for a in range(n) for b in range(a))
        if apart > gap:
            best, gap = code, apart
    return best


@dataclass
class Model:
    """Languages, their codewords, and per bit a table of bucket ratios, a slope and a weight."""

    langs: list[str]
    code: np.ndarray  # language x bit
    ratios: np.ndarray  # bucket x bit, float32
    slope: np.ndarray
    weight: np.ndarray

    def margins(self, texts: list[bytes]) -> np.ndarray:
        """Text x bit: mean ratio of a text's n-grams times the square root of their number."""
        bits = self.code.shape[1]
        out = np.zeros((len(texts), bits))
        at = 0
        while at < len(texts):  # a slice of texts at a time, so that the tables fit the processor's memory
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size + len(texts[stop]) <= 1 << 17):
                size += len(texts[stop])
                stop += 1
            if stop == at + 1 and size > 1 << 20:
                out[at] = self._long(texts[at])
            else:
                starts = np.cumsum([0, *[len(t) for t in texts[at:stop - 1]]])
                buffer = b"".join(texts[at:stop])
                total = np.zeros((stop - at, bits))
                for n, hit in zip(GRAMS, gram_buckets(buffer), strict=True):
                    hit = np.concatenate([hit, np.zeros(len(buffer) - len(hit), np.int32)])
                    values = self.ratios[hit]
                    for k in range(1, n):  # n-grams that reach into the next text count for none
                        values[np.append(starts[1:], len(buffer)) - k] = 0
                    total += np.add.reduceat(values, starts, axis=0)
                out[at:stop] = total / np.sqrt(len(GRAMS) * np.diff(np.append(starts, len(buffer))))[:, None]
            at = stop
        return out

    def _long(self, text: bytes) -> np.ndarray:
        total = np.zeros(self.code.shape[1])
        for first in range(0, len(text), 1 << 20):
            for n, hit in zip(GRAMS, gram_buckets(text[first:first + (1 << 20) + 3]), strict=True):
                total += np.bincount(hit[:1 << 20], minlength=BUCKETS) @ self.ratios.astype(np.float64)
        return total / np.sqrt(len(GRAMS) * len(text))

    def decode(self, texts: list[bytes]) -> np.ndarray:
        """Text x language: shares that add up to 1, from the weighted losses of the codewords."""
        if not self.code.size or not texts:  # no language, or one alone
            return np.ones((len(texts), len(self.langs)))
        pull = self.margins(texts) * self.slope
        loss = np.stack([(np.logaddexp(0, -pull * word) * self.weight).sum(axis=1) for word in self.code.astype(float)], axis=1)
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        return share / share.sum(axis=1, keepdims=True)


def _sum_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, cells in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist(), strict=True):
            found = np.frombuffer(cells, np.int64)
            total[part] = total[part] + found if part in total else found
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], schema=_CELLS)


def gram_counts(train: DataFrame, langs: list[str]) -> np.ndarray:
    """Language x bucket over all rows of ``train`` (``lang``, ``text``)."""
    index = {lang: k for k, lang in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), BUCKETS), np.int64)
        for batch in batches:
            held: dict[int, list[bytes]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                held.setdefault(index[lang], []).append(normal(text))
            for k, texts in held.items():
                at = 0
                while at < len(texts):
                    stop, size = at, 0
                    while stop < len(texts) and (stop == at or size + len(texts[stop]) <= 1 << 20):
                        size += len(texts[stop])
                        stop += 1
                    for hit in gram_buckets(b"".join(texts[at:stop])):
                        total[k] += np.bincount(hit, minlength=BUCKETS)
                    at = stop
        step = BUCKETS // PARTS
        for k in np.flatnonzero(total.any(axis=1)):
            cells = [total[k, p * step:(p + 1) * step].tobytes() for p in range(PARTS)]
            yield pa.RecordBatch.from_arrays([pa.array([int(k) * PARTS + p for p in range(PARTS)], pa.int32()), pa.array(cells, pa.binary())], schema=_CELLS)

    parts = fixed_table(train.select("lang", "text").mapInArrow(count, "part int, cells binary"), _sum_cells, "part int, cells binary")
    out = np.zeros((len(langs) * PARTS, BUCKETS // PARTS), np.int64)
    for part, cells in parts.items():
        out[part] = np.frombuffer(cells, np.int64)
    return out.reshape(len(langs), BUCKETS)


def fit(train: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of the languages in ``train`` (``doc_id``, ``lang``, ``text``); rows without a language or a letter teach nothing.

    The languages are a setting of the corpus: their list and one table of counts
    each are held by the driver.  ``doc_id`` only helps to choose the sample.
    """
    train = train.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", "text")
    langs = sorted(r["lang"] for r in train.select("lang").distinct().collect())
    code = codewords(len(langs))
    if code.shape[1] == 0:
        return Model(langs, code, np.zeros((BUCKETS, 0), np.float32), np.ones(0), np.ones(0))
    counts = gram_counts(train, langs) + 0.0
    prior = (counts.sum(axis=0) + 0.5) / (counts.sum() + 0.5 * BUCKETS)
    shares = (counts + 500 * prior) / (counts.sum(axis=1, keepdims=True) + 500)  # every language counts alike, whatever its size
    sides = [(shares[word > 0].mean(axis=0), shares[word < 0].mean(axis=0)) for word in code.T]
    model = Model(langs, code, np.stack([np.log(a / b) for a, b in sides], axis=1).astype(np.float32), np.ones(code.shape[1]), np.ones(code.shape[1]))
    known = sample_margins(train, model, sample)
    margins = np.array([r["margins"] for r in known])
    truth = code[[langs.index(r["lang"]) for r in known]]
    model.slope = np.array([slope(margins[:, b] * truth[:, b]) for b in range(code.shape[1])])
    wrong = ((margins * truth <= 0).sum(axis=0) + 0.5) / (len(known) + 1)
    model.weight = np.log((1 - wrong) / wrong).clip(0.05)
    model.weight /= model.weight.mean()
    return model


def sample_margins(train: DataFrame, model: Model, sample: int) -> list[Row]:
    """``lang, margins`` of about ``sample`` rows of each language, chosen by a hash; texts stay in their tasks."""
    shared = train.sparkSession.sparkContext.broadcast(model)
    sizes = {r["lang"]: r["count"] for r in train.groupBy("lang").count().collect()}
    mark = F.pmod(F.xxhash64(F.lit(13), *train.columns), F.lit(1 << 40))
    below = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, int(min(1.0, sample / n) * (1 << 40)))])[F.col("lang")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = shared.value.margins([normal(t) for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(margins.tolist(), pa.list_(pa.float64()))], names=["lang", "margins"])

    return train.where(mark < below).select("lang", "text").mapInArrow(run, "lang string, margins array<double>").limit(2 * sample * len(sizes)).collect()


def slope(right: np.ndarray) -> float:
    """The factor of signed margins under which the logistic loss is least, by bisection on its derivative.

    The aim is not certainty but (n + 1) / (n + 2), so sides that never mix get a finite slope.
    """
    low, high, aim = 0.0, 50.0, (len(right) + 1) / (len(right) + 2)
    for _ in range(40):
        mid = (low + high) / 2
        if (right * (aim - 1 / (1 + np.exp(-np.clip(mid * right, -500, 500))))).sum() > 0:
            low = mid
        else:
            high = mid
    return max(low, 1e-3)


def predict(docs: DataFrame, model: Model, sure: float = SURE) -> DataFrame:
    """``doc_id, lang_pred, score, runner_up, ambiguous`` of every row, from the text alone.

    A null text or one without a letter is ``und`` with score 0; so is every text
    if nothing was learned.  With one language learned all others get it.  Ties go
    to the language that comes first.  Repeated rows come out as often; other
    columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            able = [k for k, t in enumerate(texts) if held.langs and t and _LETTER.search(t)]
            pred, score, second = [UNKNOWN] * len(texts), [0.0] * len(texts), [None] * len(texts)
            share = held.decode([normal(texts[k]) for k in able])
            best = np.argsort(-share, axis=1, kind="stable")
            for row, k in enumerate(able):
                pred[k], score[k] = held.langs[best[row, 0]], float(share[row, best[row, 0]])
                second[k] = held.langs[best[row, 1]] if len(held.langs) > 1 else None
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(second, pa.string()), pa.array([s < sure for s in score], pa.bool_())],
                                             names=[x.split()[0] for x in RESULT.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, RESULT)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether a row is kept out of training; a null id counts as an empty one."""
    return F.pmod(F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")), F.lit(folds)) == 0
