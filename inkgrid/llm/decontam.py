"""Benchmark passages found by the q-gram lemma.

A region that matches an item of length m within e edits shares at least
m - q + 1 - q*e of the item's q-grams, all on diagonals at most e apart.  Shared
q-grams are counted in overlapping bands of diagonals.  A band that reaches the
bound must also share enough of the item's short grams with its stretch of text (a
bit set per item and stretch, compared for all items at once), which is what
rejects items that have only a common beginning with it.  The others are aligned
inside their band, and regions within the budget are returned.

The items are a query set.  They are compared with all documents in blocks of at
most ``BLOCK_CHARS`` characters, one block at a time on the driver and in the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrid.llm.common import payloads, span_hashes, written

Q = 12
EDITS = 0.05
BLOCK_CHARS = 1 << 22
_BITS = 21
MATCH = "uid long, doc_id long, item_id long, start long, stop long, edits int, shared int"


def normal(text: bytes) -> bytes:
    """A-Z lower-cased, runs of white space as one blank, none at the ends."""
    return b" ".join(text.lower().split())


def budget(length: int, edits: float, q: int) -> int:
    """Edits allowed in an item: the given share of its bytes, and few enough for the lemma to ask for two q-grams."""
    return max(0, min(int(edits * length), (length - q - 1) // q))


class Items:
    """The q-grams of a block of items, sorted by hash, with a bit table in front; the short grams of each item as bits."""

    def __init__(self, items: list[tuple[int, bytes]], q: int, edits: float):
        self.q, self.ids, self.texts = q, [i for i, _ in items], [t for _, t in items]
        self.length = np.array([len(t) for t in self.texts], np.int64)
        self.allowed = np.array([budget(len(t), edits, q) for t in self.texts], np.int64)
        self.bound = self.length - q + 1 - q * self.allowed
        self.at_bits = max(map(len, self.texts), default=0).bit_length()
        grams, item, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, text in enumerate(self.texts):
            found = rolling(text, q)
            grams.append(found), item.append(np.full(len(found), k)), at.append(np.arange(len(found)))
        gram, self.item, self.at = np.concatenate(grams), np.concatenate(item), np.concatenate(at)
        order = np.argsort(gram, kind="stable")
        self.gram, self.item, self.at = gram[order], self.item[order], self.at[order]
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[(self.gram >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        self.signs = np.array([short_grams(t) for t in self.texts], np.uint64).reshape(-1, SIGN_WORDS)
        # An edit changes at most SHORT_Q short grams, so so many bits at most go missing.
        self.need = np.bitwise_count(self.signs).sum(axis=1).astype(np.int64) - SHORT_Q * self.allowed
        self.masks: dict[int, tuple[dict[int, int], dict[int, int]]] = {}

    def letters(self, i: int) -> tuple[dict[int, int], dict[int, int]]:
        """Per letter of item ``i`` the bits of its places, from the front and from the back."""
        if i not in self.masks:
            self.masks[i] = places(self.texts[i]), places(self.texts[i][::-1])
        return self.masks[i]

    def matches(self, text: bytes) -> list[tuple[int, int, int, int, int]]:
        """``item index, start, stop, edits, shared``: the best region of every run of overlapping ones."""
        grams = rolling(text, self.q)
        near = np.flatnonzero(self.seen[(grams >> np.uint64(64 - _BITS)).view(np.int64)])
        first = np.searchsorted(self.gram, grams[near], "left")
        times = np.searchsorted(self.gram, grams[near], "right") - first
        if not times.any():
            return []
        pos = np.repeat(near, times)
        spread = np.repeat(first - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
        item, at = self.item[spread], self.at[spread]
        # An item with fewer hits in the whole text than one band needs cannot match.
        ids, back, hits = np.unique(item, return_inverse=True, return_counts=True)
        enough = hits >= self.bound[ids]
        if not enough.any():
            return []
        held = enough[back]
        pos, item, at = pos[held], item[held], at[held]
        width = self.allowed[item] + 1
        diagonal = pos - at
        shift_by = -min(0, int(diagonal.min()))
        diagonal += shift_by  # so that none is negative
        found: dict[int, list[tuple[int, int, int, int, int]]] = {}
        signs: dict[tuple[int, int], np.ndarray] = {}
        for shift in (0, 1):  # bands of twice the width, the second set half a band later: any run of `width` diagonals lies inside one
            band = (diagonal + shift * width) // (2 * width)
            keys, back = np.unique(item << 40 | band, return_inverse=True)
            shared = np.bincount(np.unique(back << self.at_bits | at) >> self.at_bits, minlength=len(keys))
            owner = keys >> 40
            able = np.flatnonzero(shared >= self.bound[owner])
            if not len(able):
                continue
            wide = self.allowed[owner[able]] + 1
            low = (keys[able] & ((1 << 40) - 1)) * 2 * wide - shift * wide - shift_by
            able, low = self._alike(text, owner, able, low, signs)
            order = np.argsort(back, kind="stable")
            starts = np.searchsorted(back[order], able)
            stops = np.searchsorted(back[order], able, "right")
            for k, lo, start, stop in zip(able.tolist(), low.tolist(), starts.tolist(), stops.tolist(), strict=True):
                i = int(owner[k])
                w, length = int(self.allowed[i]) + 1, len(self.texts[i])
                if any(edits == 0 and lo <= begin < lo + 2 * w for begin, _, edits, _ in found.get(i, ())):
                    continue  # the other bands already gave the region without an edit
                # The band's commonest diagonal needs no alignment where the item stands on it letter by letter.
                here, votes = np.unique(diagonal[order[start:stop]], return_counts=True)
                begin = int(here[votes.argmax()]) - shift_by
                same = begin >= 0 and text[begin:begin + length] == self.texts[i]
                hit = (begin, begin + length, 0) if same else aligned(*self.letters(i), length, text, lo, lo + 2 * w - 1, int(self.allowed[i]))
                if hit:
                    found.setdefault(i, []).append((*hit, int(shared[k])))
        out = []
        for i, hits in found.items():
            last = None
            for start, stop, edits, shared in sorted(hits):
                if last and start < last[1]:
                    last = min(last, (start, stop, edits, shared), key=lambda x: (x[2], x[0]))
                else:
                    if last:
                        out.append((i, *last))
                    last = (start, stop, edits, shared)
            out.append((i, *last))
        return out

    def _alike(self, text: bytes, owner: np.ndarray, able: np.ndarray, low: np.ndarray, signs: dict[tuple[int, int], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The bands whose stretch of text holds enough short grams of the item; stretches are cut at multiples of 64, so many items share one."""
        items = owner[able]
        start = np.maximum(low - self.allowed[items], 0) // 64 * 64
        stop = -(-(low + 3 * self.allowed[items] + 2 + self.length[items]) // 64) * 64
        stretches, back = np.unique(np.stack([start, stop]), axis=1, return_inverse=True)
        kept = np.zeros(len(able), bool)
        order = np.argsort(back, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(back[order])) + 1):
            begin, end = map(int, stretches[:, back[group[0]]])
            if (begin, end) not in signs:
                signs[begin, end] = short_grams(text[begin:end])
            both = np.bitwise_count(self.signs[items[group]] & signs[begin, end]).sum(axis=1)
            kept[group] = both >= self.need[items[group]]
        return able[kept], low[kept]


SHORT_Q, SIGN_WORDS = 4, 64


def short_grams(text: bytes) -> np.ndarray:
    """The hashed 4-byte grams of a text as 4096 bits."""
    bits = np.zeros(SIGN_WORDS * 64, bool)
    if len(text) >= SHORT_Q:
        data = np.frombuffer(text, np.uint8).astype(np.uint32)
        n = len(data) - SHORT_Q + 1
        code = data[:n] | data[1:n + 1] << np.uint32(8) | data[2:n + 2] << np.uint32(16) | data[3:n + 3] << np.uint32(24)
        bits[(code * np.uint32(0x9E3779B1)) >> np.uint32(20)] = True
    return np.packbits(bits).view(np.uint64)


def places(text: bytes) -> dict[int, int]:
    """Per letter an integer whose bits are the places of the letter."""
    out: dict[int, int] = {}
    for k, letter in enumerate(text):
        out[letter] = out.get(letter, 0) | 1 << k
    return out


def rolling(text: bytes, q: int) -> np.ndarray:
    """A hash of the q bytes from each position on: of the two 8-byte words that cover them."""
    n = len(text) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if q < 8:
        starts = np.arange(n)
        return span_hashes(text, starts, starts + q)
    words = np.empty(len(text) - 7, np.uint64)
    for k in range(8):
        if len(text) - k >= 8:
            words[k::8] = np.frombuffer(text, "<u8", (len(text) - k) // 8, k)
    grams = words[:n] * np.uint64(0x9E3779B97F4A7C15)
    grams ^= words[q - 8:] * np.uint64(0xC2B2AE3D27D4EB4F)
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    return grams


def distances(masks: dict[int, int], length: int, text: bytes, free_start: bool) -> Iterator[int]:
    """After each letter of ``text`` the least edits between the whole item and a stretch that ends there.

    A column of the edit table is held as the signs of its differences, one bit a
    cell in two integers, so a letter takes a dozen integer operations (Myers).  The
    stretch may begin anywhere, or at the first letter only.
    """
    full, top = (1 << length) - 1, 1 << (length - 1)
    up, down, edits = full, 0, length
    begin = 0 if free_start else 1
    for letter in text:
        same = masks.get(letter, 0)
        vertical = same | down
        across = (((same & up) + up) ^ up) | same
        right, left = down | ~(across | up) & full, up & across
        if right & top:
            edits += 1
        elif left & top:
            edits -= 1
        right, left = (right << 1 | begin) & full, left << 1 & full
        up, down = left | ~(vertical | right) & full, right & vertical
        yield edits


def aligned(forward: dict[int, int], backward: dict[int, int], length: int, text: bytes, low: int, high: int, allowed: int) -> tuple[int, int, int] | None:
    """``start, stop, edits`` of the whole item in the stretch of ``text`` that diagonals ``low`` to ``high`` and the budget reach, the best and first one."""
    first, last = max(0, low - allowed), min(len(text), high + length + allowed)
    best, stop = allowed + 1, 0
    for k, edits in enumerate(distances(forward, length, text[first:last], True), first + 1):
        if edits < best:
            best, stop = edits, k
    if best > allowed:
        return None
    start = stop
    for k, edits in enumerate(distances(backward, length, text[max(first, stop - length - best):stop][::-1], False), 1):
        if edits == best:
            start = stop - k
            break
    return start, stop, best


def item_blocks(benchmark: DataFrame, chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, bytes]]]:
    """The distinct items in blocks of at most ``chars`` bytes, ids ascending; the driver holds one block at a time."""
    rows = benchmark.where(F.col("text").isNotNull()).select("item_id", "text").distinct().orderBy("item_id", "text")
    block: list[tuple[int, bytes]] = []
    held = 0
    for row in rows.toLocalIterator():
        text = normal(row["text"].encode())
        if block and held + len(text) > chars:
            yield block
            block, held = [], 0
        block.append((row["item_id"], text))
        held += len(text)
    yield block


def find(docs: DataFrame, benchmark: DataFrame, q: int = Q, edits: float = EDITS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``uid, doc_id, item_id, start, stop, edits, shared``: regions of ``docs`` that match an item of ``benchmark``.

    An item matches where its whole text occurs with at most ``edits`` of its bytes
    changed, apart from case and white space; positions count bytes of the
    normalised text.  Items shorter than ``q`` bytes, null and empty texts match
    nothing.  Of overlapping regions of one item the one with the fewest edits
    stays.  ``uid`` numbers the rows of ``docs``, so repeated rows and null ids each
    come out.  An empty benchmark or table gives an empty result.
    """
    numbered = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for block in item_blocks(benchmark, block_chars):
        index = docs.sparkSession.sparkContext.broadcast(Items([x for x in block if len(x[1]) >= q], q, edits))

        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            names = [x.split()[0] for x in MATCH.split(", ")]
            kinds = [pa.int64()] * 5 + [pa.int32()] * 2
            items = index.value
            for batch in batches:
                rows = []
                for uid, doc, text in zip(batch.column("uid").to_pylist(), batch.column("doc_id").to_pylist(), payloads(batch, "text"), strict=True):
                    rows += [(uid, doc, items.ids[i], *rest) for i, *rest in items.matches(normal(text))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        part = written(numbered.mapInArrow(search, MATCH), "leaks")
        index.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def without_matches(docs: DataFrame, benchmark: DataFrame, q: int = Q, edits: float = EDITS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs``, all columns, in which ``find`` finds nothing.

    What a block of items leaves is written before the next block is sent; the
    last block's rows are not written again.
    """
    previous = None
    for block in item_blocks(benchmark, block_chars):
        if previous is not None:
            docs = written(docs, "leak-free")
            previous.destroy()
        index = previous = docs.sparkSession.sparkContext.broadcast(Items([x for x in block if len(x[1]) >= q], q, edits))

        def clean(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            items = index.value
            for batch in batches:
                yield batch.filter(pa.array([not items.matches(normal(text)) for text in payloads(batch, "text")], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
