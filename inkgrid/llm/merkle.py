"""A Merkle manifest of a dataset: a tree of digests per source, and a tree over the sources' roots.

Every level is one aggregate: the children of a parent are spread into ``fanout``
columns by conditional aggregates on their slot, the columns put together hash to
the parent's digest, and the columns without a child's own slot are the siblings
of its proof.  Proofs are made from the top down on rows of whole parents, so the
long sibling texts are shuffled once per parent, not once per leaf, and leaves
appear only when the lowest level is unfolded.  No level, source or tree passes
through one task: leaves are numbered by ranges, parents are keyed by place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgrid.llm.common import lower_ascii, numbered, written

FANOUT = 16
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
_STEP = "array<struct<left:string,right:string>>"


def digest(*inputs: Column) -> Column:
    """Lower-case hex SHA-256 of the inputs one after the other; nulls are left out."""
    return F.sha2(F.concat_ws("", *inputs), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value; no two rows of values encode alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def tree_key(source: Column) -> Column:
    """A key that is never null and sorts by UTF-8 bytes, null first."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit(""))


@dataclass
class Tree:
    """``leaves`` and the spread levels above them, each a written table; ``tops`` has one row per tree."""

    leaves: DataFrame  # tree, pos, n, digest, further columns
    levels: list[DataFrame]  # tree, parent, n, digest, c0 ... c15 (struct of digest and, on the lowest level, the further columns)
    tops: DataFrame  # tree, digest
    fanout: int


def spread(nodes: DataFrame, fanout: int, extra: list[str]) -> DataFrame:
    """One row per parent with its children in columns ``c0`` to ``c<fanout - 1>`` and their digest."""
    child = F.struct("digest", *extra)
    slots = [F.max(F.when(F.pmod("pos", F.lit(fanout)) == i, child)).alias(f"c{i}") for i in range(fanout)]
    parents = nodes.groupBy("tree", F.floor(F.col("pos") / fanout).alias("parent")).agg(F.max("n").alias("n"), *slots)
    return parents.withColumn("digest", digest(*[F.col(f"c{i}.digest") for i in range(fanout)]))


def grow(leaves: DataFrame, extra: list[str], fanout: int = FANOUT) -> Tree:
    """Trees over numbered leaves (``tree, pos, n, digest`` and ``extra``); a tree of one leaf has that leaf as its root."""
    most = leaves.agg(F.max("n")).first()[0] or 1
    nodes, levels = leaves, []
    tops = [nodes.where("n = 1").select("tree", "digest")]
    while most > 1:
        levels.append(written(spread(nodes.where("n > 1"), fanout, [] if levels else extra), f"merkle-level{len(levels)}"))
        nodes = levels[-1].select("tree", F.col("parent").alias("pos"), F.ceil(F.col("n") / fanout).alias("n"), "digest")
        tops.append(nodes.where("n = 1").select("tree", "digest"))
        most = -(-most // fanout)
    found = tops[0]
    for top in tops[1:]:
        found = found.unionByName(top)
    return Tree(leaves, levels, written(found, "merkle-tops"), fanout)


def prove(tree: Tree, starts: DataFrame, extra: list[str]) -> DataFrame:
    """``tree, pos, digest, path`` and the columns of ``starts`` and ``extra`` for every leaf.

    ``starts`` has per tree the ``path`` from its root upwards.  A path is a list of
    steps from the leaf on, each the siblings to the left and to the right.
    """
    fanout, paths = tree.fanout, None
    given = [c for c in starts.columns if c not in ("tree", "path")]
    for level, nodes in [*reversed(list(enumerate(tree.levels, 1))), (0, tree.leaves)]:
        here = nodes.select("tree", F.col("parent").alias("pos"), F.ceil(F.col("n") / fanout).alias("n")) if level else nodes
        roots = here.where("n = 1").join(starts, "tree").select(*([] if level else ["digest", *extra]), "tree", "pos", "path", *given)
        paths = roots if paths is None else roots.unionByName(paths)
        if level:
            low = extra if level == 1 else []
            kids = tree.levels[level - 1].select("tree", F.col("parent").alias("pos"), *[f"c{i}" for i in range(fanout)])
            paths = unfolded(kids.join(paths, ["tree", "pos"]), fanout, low, given, with_digest=level == 1)
            paths = paths if level == 1 else written(paths, f"merkle-paths{level}")
    return paths


def unfolded(parents: DataFrame, fanout: int, extra: list[str], given: list[str], with_digest: bool) -> DataFrame:
    """A row per child: its own column is left out, the columns before and after it are the new first step of the path."""
    slot = F.col("slot")
    child = F.element_at(F.array(*[F.col(f"c{i}") for i in range(fanout)]), slot + 1)
    left = F.concat_ws("", *[F.when(slot > i, F.col(f"c{i}.digest")) for i in range(fanout)])
    right = F.concat_ws("", *[F.when(slot < i, F.col(f"c{i}.digest")) for i in range(fanout)])
    rows = parents.select("*", F.explode(F.sequence(F.lit(0), F.lit(fanout - 1))).alias("slot")).withColumn("child", child).where(F.col("child.digest").isNotNull())
    path = F.concat(F.array(F.struct(left.alias("left"), right.alias("right"))), F.col("path"))
    return rows.select("tree", (F.col("pos") * fanout + slot).alias("pos"), path.cast(_STEP).alias("path"), *given, *([F.col("child.digest").alias("digest")] if with_digest else []), *[F.col(f"child.{c}").alias(c) for c in extra])


def proof_digest(path: Column) -> Column:
    """The digest of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf's digest leads to by its path."""
    return F.aggregate(path, start, lambda at, s: F.sha2(F.concat(s["left"], at, s["right"]), 256))


def tampered_fields(docs: DataFrame) -> Column:
    """The digest of a row whose text had A-Z lower-cased, for rows whose id's checksum is divisible by 5; else null."""
    chosen = F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(5)) == 0
    return F.when(chosen, digest(*[field(lower_ascii(F.col(c)) if c == "text" else F.col(c)) for c in FIELDS]))


def manifest(docs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """``doc_id, source, leaf, tampered, path, subroot, root`` of every row.

    A leaf is the digest of ``FIELDS``; leaves of a source ascend by ``doc_id`` (null
    first), then by digest; rows equal in both are the same leaf twice.  Sources
    ascend by UTF-8 bytes, null first.  Null and empty values encode apart.  Other
    columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", tree_key(F.col("source")).alias("tree"), digest(*[field(F.col(c)) for c in FIELDS]).alias("digest"),
                       tampered_fields(docs).alias("tampered"), F.monotonically_increasing_id().alias("uid"))
    # The texts are read once; what is sorted and joined from here on has a fixed width.
    rows = written(rows, "merkle-digests")
    leaves = written(numbered(rows, ["tree"], [F.col("doc_id").asc_nulls_first(), F.col("digest").asc(), F.col("uid").asc()], "merkle-ranges").drop("uid"), "merkle-leaves")
    kept = ["doc_id", "source", "tampered"]
    low = grow(leaves, kept, fanout)
    subroots = written(numbered(low.tops.select(F.lit("").alias("all"), F.col("tree").alias("name"), "digest"), ["all"], [F.col("name").asc()], "merkle-subroots"), "merkle-subroots")
    high = grow(subroots.withColumnRenamed("all", "tree"), ["name"], fanout)
    top = high.tops.first()
    starts = prove(high, high.tops.select("tree", F.array().cast(_STEP).alias("path")), ["name"]).select(F.col("name").alias("tree"), "path", F.col("digest").alias("subroot"))
    proofs = prove(low, written(starts, "merkle-starts"), kept)
    return proofs.select("doc_id", "source", F.col("digest").alias("leaf"), "tampered", "path", "subroot", F.lit(top["digest"] if top else None).cast("string").alias("root"))
