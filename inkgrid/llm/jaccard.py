"""Jaccard join on word n-grams by T-occurrence search.

Two sets with a Jaccard coefficient of at least ``t`` share at least
T = ceil(t * n) grams of the larger one.  With one order for all grams, the first
n - T + l grams of both share l of them, so an inverted index of these few grams
finds every pair.  The order puts rare grams first, by a sketch of fixed size.

* Exact copies are folded into one set before anything else.
* Short inverted lists are merged: pairs are counted over them.  Long lists are
  left out of the merge, as in DivideSkip; a pair's bound is lowered by the long
  lists it may share, and each long list ties its documents to one of them.
* Documents tied together are a family, searched in groups of bounded size: large
  families are cut by set size, where only neighbouring sizes can link, and by hash.
  A group gets the whole sets, merges its short inverted lists on a heap, looks the
  survivors up in the long ones by bisection, and gives one link per union it makes.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgrid.llm.common import fixed_table, payloads, sliced, span_hashes, word_spans, written
from inkgrid.operators.graph import connected_components

WIDTH, PERCENT = 3, 90
CELLS, PARTS = 1 << 21, 512
SHARED = 3
SHORT_LIST = 64
#: Grams so many times (as a power of two) as frequent as the median cell are dealt to so many tasks.
HOT, SALTS = 4, 64
#: Grams held by one group of a family at a time.
GROUP_GRAMS = 1 << 16
GROUP = ["family", "c1", "b1", "c2", "b2"]
#: Bits of the table of rows that may have to go.
BITS = 1 << 24
_PART = pa.schema([("part", pa.int32()), ("cells", pa.binary())])
_SIGNED = "kind byte, doc_id long, key string, sig binary, mark long, n int, part int, cells binary"
_LISTS = "token long, n int, mark long, members array<struct<n: int, sig: long>>"


def shingles(text: bytes, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct word n-grams, ascending, and their lengths in bytes; fewer words make one gram."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    buffer, starts, ends = word_spans(words)
    last = min(width, len(words)) - 1
    starts, ends = starts[:len(starts) - last], ends[last:]
    grams, first = np.unique(span_hashes(buffer, starts, ends), return_index=True)
    return grams, (ends - starts)[first]


def signature(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def mark_of(sig: bytes) -> int:
    """The first eight bytes of a signature, which stand for it in the inverted lists: sets that share them are one there and come apart when whole sets are compared."""
    return int.from_bytes(sig[:8], "little", signed=True)


def least_overlap(n: int, percent: int = PERCENT) -> int:
    return -(-percent * n // 100)


def pack(cells: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The parts of a sketch that have counts."""
    step = len(cells) // PARTS
    for part in np.flatnonzero(cells.reshape(PARTS, step).any(axis=1)):
        yield int(part), zlib.compress(cells[part * step:(part + 1) * step].tobytes(), 1)


def _sum_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the parts; gives the position of the highest bit of every cell's count."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, cells in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist(), strict=True):
            found = np.frombuffer(zlib.decompress(cells), np.uint32).astype(np.int64)
            total[part] = total[part] + found if part in total else found
    if total:
        ranks = [np.frexp(x.astype(float))[1].astype(np.uint8).tobytes() for x in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(ranks, pa.binary())], schema=_PART)


def _whole(parts: dict[int, bytes], cells: int = CELLS) -> np.ndarray:
    step = cells // PARTS
    out = np.zeros(cells, np.uint8)
    for part, data in parts.items():
        out[part * step:(part + 1) * step] = np.frombuffer(data, np.uint8)
    return out


def signed(docs: DataFrame, width: int, key: Column) -> DataFrame:
    """Kind 0: ``doc_id, key, sig, mark, n`` of every row; kind 1: the task's part of the sketch of gram frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("kind", pa.int8()), ("doc_id", pa.int64()), ("key", pa.string()), ("sig", pa.binary()), ("mark", pa.int64()), ("n", pa.int32()), ("part", pa.int32()), ("cells", pa.binary())])
        seen: set[bytes] = set()
        cells = np.zeros(CELLS, np.uint32)
        for batch in sliced(batches):
            sigs, sizes = [], []
            for text in payloads(batch, "text"):
                grams, _ = shingles(text, width)
                sig = signature(grams) if len(grams) else None
                if sig and sig not in seen:
                    seen.add(sig)
                    np.add.at(cells, (grams & np.uint64(CELLS - 1)).astype(np.int64), 1)
                sigs.append(sig), sizes.append(len(grams))
            k = len(sigs)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(k, np.int8)), batch.column("doc_id"), batch.column("key"), pa.array(sigs, pa.binary()), pa.array([x and mark_of(x) for x in sigs], pa.int64()), pa.array(sizes, pa.int32()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], schema=schema)
        parts = list(pack(cells))
        if parts:
            k = len(parts)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int8)), pa.nulls(k, pa.int64()), pa.nulls(k, pa.string()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()),
                                              pa.array([p for p, _ in parts], pa.int32()), pa.array([c for _, c in parts], pa.binary())], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), "text").mapInArrow(run, _SIGNED)


def prefixes(docs: DataFrame, ranks: np.ndarray, width: int, percent: int) -> DataFrame:
    """``token, mark, n, salt``: the first n - T + SHARED grams of every distinct set of a task, rare and long grams first; ``salt`` is -1 but for grams that may be very frequent."""
    hot = max(int(np.median(ranks[ranks > 0])) + HOT, SHORT_LIST.bit_length()) if ranks.any() else 0
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # CELLS bytes
    schema = pa.schema([("token", pa.int64()), ("mark", pa.int64()), ("n", pa.int32()), ("salt", pa.int8())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in sliced(batches):
            tokens, marks, sizes, salts = [], [], [], []
            for text in payloads(batch, "text"):
                grams, lengths = shingles(text, width)
                n = len(grams)
                sig = signature(grams) if n else None
                if not sig or sig in seen:
                    continue
                seen.add(sig)
                rank = shared.value[(grams & np.uint64(CELLS - 1)).astype(np.int64)]
                order = np.lexsort((grams, -lengths, rank))[:n - least_overlap(n, percent) + SHARED]
                mark = mark_of(sig)
                tokens.append(grams[order].view(np.int64)), marks.append(np.full(len(order), mark)), sizes.append(np.full(len(order), n, np.int32))
                salts.append(np.where(rank[order] > hot, mark % SALTS, -1).astype(np.int8))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tokens, marks, sizes, salts)], schema=schema)

    return docs.select("text").mapInArrow(run, "token long, mark long, n int, salt byte")


def _listed(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows ``token, salt, n, mark`` in this order to lists of distinct members: a row a list of 2 to ``most``, a row a member of longer and of salted ones."""
    names = ["token", "salt", "n", "mark"]
    member = pa.struct([("n", pa.int32()), ("sig", pa.int64())])
    schema = pa.schema([("token", pa.int64()), ("n", pa.int32()), ("mark", pa.int64()), ("members", pa.list_(member))])

    def lists(c: dict[str, np.ndarray], open_token: bool) -> pa.RecordBatch:
        """``open_token``: the first token's list was found to be long before."""
        first = np.flatnonzero(np.append(True, c["token"][1:] != c["token"][:-1]))
        sizes = np.diff(np.append(first, len(c["token"])))
        loose = (sizes > most) | (c["salt"][first] >= 0)
        loose[0] |= open_token
        one, short = np.repeat(loose, sizes), ~loose & (sizes > 1)
        kept = np.repeat(short, sizes)
        offsets = np.append(0, np.cumsum(sizes[short])).astype(np.int32)
        members = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(c["n"][kept]), pa.array(c["mark"][kept])], fields=list(member)))
        k, j = int(one.sum()), int(short.sum())
        columns = [
            pa.concat_arrays([pa.array(c["token"][one]), pa.array(c["token"][first[short]])]), pa.concat_arrays([pa.array(c["n"][one]), pa.nulls(j, pa.int32())]),
            pa.concat_arrays([pa.array(c["mark"][one]), pa.nulls(j, pa.int64())]), pa.concat_arrays([pa.nulls(k, pa.list_(member)), members.cast(pa.list_(member))]),
        ]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    held, last, open_token = None, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        c = {x: batch.column(x).to_numpy(zero_copy_only=False) for x in names}
        new = np.ones(batch.num_rows, dtype=bool)
        new[1:] = (c["token"][1:] != c["token"][:-1]) | (c["mark"][1:] != c["mark"][:-1]) | (c["n"][1:] != c["n"][:-1]) | (c["salt"][1:] != c["salt"][:-1])
        new[0] = last != tuple(int(c[x][0]) for x in names)
        last = tuple(int(c[x][-1]) for x in names)
        c = {x: v[new] for x, v in c.items()}
        held = c if held is None else {x: np.concatenate([held[x], v]) for x, v in c.items()}
        if not len(held["token"]):
            continue
        at = len(held["token"]) - int(np.argmax(np.append(held["token"][::-1] != held["token"][-1], True)))
        if len(held["token"]) - at > most:  # the last token's list is long, whatever follows
            now, at = int(held["token"][-1]), len(held["token"])
        else:
            now = open_token if open_token == held["token"][-1] else None
        if at:
            yield lists({x: v[:at] for x, v in held.items()}, open_token is not None and open_token == held["token"][0])
        held, open_token = {x: v[at:] for x, v in held.items()}, now
    if held is not None and len(held["token"]):
        yield lists(held, open_token is not None and open_token == held["token"][0])


def _pairs(lists: DataFrame, percent: int) -> DataFrame:
    """``a, b, na, nb`` for the pairs of a short, sorted array ``members`` of (n, sig) whose sizes allow a link."""
    one = lists.select("members", F.posexplode("members").alias("_i", "x"))
    later = F.expr("slice(members, _i + 2, size(members))")
    fits = F.filter(later, lambda y: F.col("x.n") * 100 >= y["n"] * percent)
    return one.select("x", F.explode(fits).alias("y")).select(F.col("x.sig").alias("a"), F.col("y.sig").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb"))


class Index:
    """Inverted lists over the sets of a group (arrays of distinct grams)."""

    def __init__(self, sets: list[np.ndarray]):
        grams = np.concatenate(sets)
        order = np.argsort(grams, kind="stable")
        self.grams, first = np.unique(grams[order], return_index=True)
        self.bounds = np.append(first, len(grams))
        self.owners = np.repeat(np.arange(len(sets)), [len(x) for x in sets])[order].tolist()

    def search(self, query: np.ndarray, least: int, skip: Callable[[int], bool] = lambda owner: False) -> Iterator[tuple[int, int]]:
        """``owner, overlap`` of the sets that share at least ``least`` grams with ``query``, by DivideSkip.

        The longest lists are set apart; the others are merged on a heap.  Owners seen
        too rarely even if all long lists held them are dropped, the rest is looked up
        in the long lists by bisection.  Owners that ``skip`` names are passed over.
        """
        place = np.searchsorted(self.grams, query)
        place[place == len(self.grams)] = 0
        place = place[self.grams[place] == query]
        if len(place) < least:
            return
        spans = sorted(zip(self.bounds[place].tolist(), self.bounds[place + 1].tolist(), strict=True), key=lambda x: x[1] - x[0])
        apart = min(max(least - SHARED, 0), len(spans))
        short, long = spans[:len(spans) - apart], spans[len(spans) - apart:]
        last, seen = -1, 0
        for owner in [*heapq.merge(*[self.owners[s:e] for s, e in short]), -2]:
            if owner == last:
                seen += 1
                continue
            if last >= 0 and seen >= least - apart and not skip(last):
                total = seen
                for k, (s, e) in enumerate(long):
                    if total + len(long) - k < least:
                        break
                    at = bisect_left(self.owners, last, s, e)
                    total += at < e and self.owners[at] == last
                if total >= least:
                    yield last, total
            last, seen = owner, 1


def group_links(sigs: list[bytes], sides: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[bytes, bytes]]:
    """Links that join the documents of one group as far as they hang together; 2 is the side that also links with itself."""
    index, parent, out = Index(sets), list(range(len(sets))), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for q, query in enumerate(sets):
        for other, overlap in index.search(query, least_overlap(len(query), percent), lambda o: o >= q or (sides[o] == sides[q] != 2) or root(o) == root(q)):
            if 100 * overlap >= percent * (len(query) + len(sets[other]) - overlap):
                parent[root(q)] = root(other)
                out.append((sigs[other], sigs[q]))
    return out


def _search_groups(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group; holds one group at a time."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])
    group, sigs, sides, sets = None, [], [], []

    def found() -> pa.RecordBatch:
        links = group_links(sigs, sides, sets, percent) if len(sets) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.binary()), pa.array([y for _, y in links], pa.binary())], schema=schema)

    for batch in sliced(batches):
        for *key, side, sig, grams in zip(*[batch.column(c).to_pylist() for c in (*GROUP, "side", "sig", "grams")], strict=True):
            if key != group:
                yield found()
                group, sigs, sides, sets = key, [], [], []
            sigs.append(sig), sides.append(side), sets.append(np.frombuffer(grams, np.uint64))
    yield found()


def _groups(members: DataFrame, percent: int) -> DataFrame:
    """``family, c1, b1, c2, b2, side, sig``: the groups in which a document of a family is searched.

    A family of up to ``GROUP_GRAMS`` grams is one group.  In larger ones a class
    spans the sizes that may link with each other, so links stay within a class or
    lead to the next; classes are cut into blocks by hash, and two blocks make a group.
    """
    totals = written(members.groupBy("family").agg(F.sum("n").alias("grams")), "jac-families")
    sized = members.join(totals, "family")
    plain = [F.lit(-1).alias("c1"), F.lit(0).alias("b1"), F.lit(-1).alias("c2"), F.lit(0).alias("b2"), F.lit(2).alias("side")]
    small = sized.where(F.col("grams") <= GROUP_GRAMS).select("family", *plain, "sig")
    large = sized.where(F.col("grams") > GROUP_GRAMS).withColumn("c", F.floor(F.log("n") / (float(np.log(100 / percent)) * 1.000001)).cast("int")).select("family", "c", "sig", "n")
    if large.isEmpty():
        return small
    cuts = written(large.groupBy("family", "c").agg(F.ceil(F.sum("n") * 2 / GROUP_GRAMS).cast("int").alias("k")), "jac-cuts")
    near = [cuts.select("family", (F.col("c") - step).alias("c"), F.col("k").alias(name)) for step, name in ((0, "k"), (1, "above"), (-1, "below"))]
    for table in near:
        large = large.join(table, ["family", "c"], "left")
    large = large.withColumn("b", F.pmod(F.xxhash64("sig"), "k").cast("int"))

    def blocks(count: str) -> Column:
        return F.when(F.coalesce(F.col(count), F.lit(0)) > 0, F.sequence(F.lit(0), F.col(count) - 1)).otherwise(F.array().cast("array<int>"))

    own = F.transform(blocks("k"), lambda j: F.struct(
        F.col("c").alias("c1"), F.least(F.col("b"), j).alias("b1"), F.col("c").alias("c2"), F.greatest(F.col("b"), j).alias("b2"), F.when(F.col("b") == j, 2).when(F.col("b") < j, 0).otherwise(1).alias("side")))
    up = F.transform(blocks("above"), lambda j: F.struct(F.col("c").alias("c1"), F.col("b").alias("b1"), (F.col("c") + 1).alias("c2"), j.alias("b2"), F.lit(0).alias("side")))
    down = F.transform(blocks("below"), lambda j: F.struct((F.col("c") - 1).alias("c1"), j.alias("b1"), F.col("c").alias("c2"), F.col("b").alias("b2"), F.lit(1).alias("side")))
    return small.unionByName(large.select("family", "sig", F.explode(F.concat(own, up, down)).alias("g")).select("family", "g.*", "sig"))


def _bit_table(rows: DataFrame, bits: int) -> np.ndarray:
    """A table of so many bits with those set that ``rows`` (``at``, any long) names."""
    step = bits // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(bits, np.uint8)
        for batch in batches:
            table[batch.column("at").to_numpy(zero_copy_only=False) & (bits - 1)] = 1
        parts = [int(part) for part in np.flatnonzero(table.reshape(PARTS, step).any(axis=1))]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([zlib.compress(np.packbits(table[p * step:(p + 1) * step]).tobytes(), 1) for p in parts], pa.binary())], schema=_PART)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, cells in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                found = np.frombuffer(zlib.decompress(cells), np.uint8)
                total[part] = total[part] | found if part in total else found
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], schema=_PART)

    out = np.zeros(bits // 8, np.uint8)
    for part, data in fixed_table(rows.select("at").mapInArrow(run, "part int, cells binary"), merge, "part int, cells binary").items():
        out[part * step // 8:(part + 1) * step // 8] = np.frombuffer(data, np.uint8)
    return out


def _has_bit(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    at = at & (len(table) * 8 - 1)
    return (table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def _whole_texts(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``sig, packed`` (the text, compressed) of the wanted signatures (``sig, mark``): a bit table of fixed size in the scan, the exact join later on.

    A text takes a quarter of the room of its grams, and gives them again.
    """
    bits = docs.sparkSession.sparkContext.broadcast(_bit_table(wanted.select(F.col("mark").alias("at")), BITS))
    schema = pa.schema([("sig", pa.binary()), ("packed", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in sliced(batches):
            sigs, texts = [], []
            for text in payloads(batch, "text"):
                grams, _ = shingles(text, width)
                sig = signature(grams) if len(grams) else None
                if not sig or sig in seen or not _has_bit(bits.value, np.array([mark_of(sig)]))[0]:
                    continue
                seen.add(sig)
                sigs.append(sig), texts.append(zlib.compress(text, 1))
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.binary()), pa.array(texts, pa.binary())], schema=schema)

    return docs.select("text").mapInArrow(run, "sig binary, packed binary").groupBy("sig").agg(F.first("packed").alias("packed"))


def _with_grams(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The compressed texts as the grams they hold, few rows at a time."""
    for batch in sliced(batches, 64):
        grams = pa.array([shingles(zlib.decompress(x), width)[0].tobytes() for x in batch.column("packed").to_pylist()], pa.binary())
        names = [x for x in batch.schema.names if x != "packed"]
        yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in names], grams], names=[*names, "grams"])


def _components(links: DataFrame) -> DataFrame:
    """``sig, comp`` of every linked signature."""
    edges = links.select(F.lit(0).alias("doc_id"), F.col("a").alias("src"), F.col("b").alias("dst"))
    nodes = edges.select("doc_id", F.col("src").alias("id")).unionByName(edges.select("doc_id", F.col("dst").alias("id"))).distinct()
    return written(connected_components(nodes, edges, small=0).select(F.col("id").alias("sig"), F.col("root").alias("comp")), "jac-comp")


def row_key() -> Column:
    """Id and text of a row as one string; equal for rows that repeat both."""
    return F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8")))


def keep_first(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` without all but one of each group of linked documents: the one with the smallest id stays.

    Rows without words stay.  A row repeated with its id and text stays once.  A bit
    table of fixed size tells the rows that are alone with their key and stay; only
    the others are shuffled.
    """
    rows = written(link_components(docs, width, percent, row_key()).where("n_shingles > 0").select("doc_id", "key", "group"), "jac-grouped")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    winners = written(rows.groupBy("group").agg(F.min(order).alias("first")).select("first.key"), "jac-winners")
    often = rows.groupBy("key").agg(F.count(F.lit(1)).alias("k")).join(winners.withColumn("wins", F.lit(1)), "key", "left").where("k > 1 or wins is null")
    table = docs.sparkSession.sparkContext.broadcast(_bit_table(often.select(F.xxhash64("key").alias("at")), BITS))

    @F.pandas_udf("boolean")
    def doubtful(at: pd.Series) -> pd.Series:
        return pd.Series(_has_bit(table.value, at.to_numpy()))

    packed = docs.select(F.struct("*").alias("row"), row_key().alias("key"), F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]").alias("worded"))
    packed = packed.withColumn("shuffled", F.col("worded") & doubtful(F.xxhash64("key")))
    kept = packed.where("shuffled").join(winners.hint("merge"), "key", "left_semi").dropDuplicates(["key"])
    return packed.where("not shuffled").select("row.*").unionByName(kept.select("row.*"))


def link_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, key: Column | None = None) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs`` (with ``key``: also the key and a ``group`` that is never null for rows with words).

    ``component_id`` is the smallest ``doc_id`` that chains of links reach, itself
    included; null ids are passed over, and a row that reaches null ids only has
    none.  Null and empty texts, and texts of white space, have no shingles and link
    with nothing.  Repeated rows are exact copies of each other and each come out.
    Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    passed = written(signed(docs, width, F.lit(None).cast("string") if key is None else key), "jac-signed")
    rows = passed.where("kind = 0").select("doc_id", "key", "sig", "mark", "n")
    ranks = _whole(fixed_table(passed.where("kind = 1").select("part", "cells"), _sum_parts, "part int, cells binary"))

    dealt = prefixes(docs, ranks, width, percent).repartition("token", "salt").sortWithinPartitions("token", "salt", "n", "mark")
    most = SHORT_LIST
    lists = written(dealt.select("token", "salt", "n", "mark").mapInArrow(lambda batches: _listed(batches, most), _LISTS), "jac-lists")
    loose = lists.where("members is null").select("token", "mark", "n")
    df = loose.groupBy("token").agg(F.count(F.lit(1)).cast("int").alias("df")).where("df > 1")
    loose = written(loose.join(df, "token"), "jac-loose")
    long = loose.where(F.col("df") > SHORT_LIST).withColumnRenamed("mark", "sig")

    members = loose.where(F.col("df") <= SHORT_LIST).groupBy("token").agg(F.sort_array(F.collect_list(F.struct("n", F.col("mark").alias("sig")))).alias("members"))
    members = lists.where("members is not null").select("token", "members").unionByName(members)
    counted = _pairs(members, percent).groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("c"))
    need = F.least(F.lit(SHARED), F.ceil(F.col("na") * percent / 100)).cast("int")
    if long.isEmpty():
        ties = counted.where(F.col("c") >= need).select("a", "b")
    else:
        skipped = written(long.groupBy("sig").agg(F.count(F.lit(1)).alias("skipped")), "jac-skipped")
        both = counted.join(skipped.select(F.col("sig").alias("a"), F.col("skipped").alias("_sa")), "a", "left").join(skipped.select(F.col("sig").alias("b"), F.col("skipped").alias("_sb")), "b", "left")
        lowered = need - F.least(F.coalesce("_sa", F.lit(0)), F.coalesce("_sb", F.lit(0)))
        hubs = written(long.groupBy("token").agg(F.min("sig").alias("a")), "jac-hubs")
        stars = long.join(hubs, "token").where(F.col("sig") != F.col("a")).select("a", F.col("sig").alias("b"))
        ties = both.where(F.col("c") >= F.greatest(F.lit(1), lowered)).select("a", "b").unionByName(stars).distinct()
    families = _components(written(ties, "jac-ties")).select(F.col("sig").alias("mark"), F.col("comp").alias("family"))
    classes = rows.where("sig is not null").select("sig", "mark", "n").distinct()
    wanted = written(families.join(classes, "mark"), "jac-wanted")
    grouped = _groups(wanted.select("family", "sig", "n"), percent)
    dealt = grouped.join(_whole_texts(docs, wanted, width).hint("merge"), "sig").repartition(*GROUP).sortWithinPartitions(*GROUP, "sig")
    links = dealt.select(*GROUP, "side", "sig", "packed").mapInArrow(lambda batches: _search_groups(_with_grams(batches, width), percent), "a binary, b binary")
    comps = _components(written(links, "jac-links"))

    # Classes of copies and components that hold more than one row; written, so that the join below can be split at a hot class.
    smallest = rows.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows"))
    smallest = smallest.join(comps, "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
    smallest = written(smallest, "jac-classes")
    merged = smallest.groupBy("comp").agg(F.min("least").alias("component_id"), F.sum("rows").alias("rows")).where("rows > 1").select("comp", "component_id")  # the others are their own component
    named = written(smallest.join(written(merged, "jac-merged"), "comp").select("sig", "comp", "component_id"), "jac-named-classes")
    out = rows.join(named, "sig", "left")
    columns = ["doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")]
    return out.select(*columns) if key is None else out.select(*columns, "key", F.coalesce("comp", "sig").alias("group"))
