"""File sources: images, SVG text, JSON version records, catalogue tables."""

from __future__ import annotations

import itertools
import math
import os
import re
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkgrid.operators.validation import MAX_PIXELS, MAX_SIDE, MAX_UPLOAD_BYTES, dimension_guard, extension, validate_uploads
from inkgrid.session import cut_lineage, run_dir

# Content type by file ending.
_MIME = {".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".webp": "image/webp", ".svg": "image/svg+xml"}


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)


#: So many bytes are put into one task where a scan deals out fewer.
TASK_BYTES = 512 * 1024 * 1024


def _size(text: str) -> int:
    """Bytes of a size as Spark's settings write it."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*([a-z]*)\s*", text.lower()).groups()
    return int(number) << 10 * ("bkmgtp".index(unit[0]) if unit else 0)


def fewer_tasks(scan: DataFrame) -> DataFrame:
    """``scan`` in fewer tasks, each of up to ``TASK_BYTES``.

    A file counts as ``spark.sql.files.openCostInBytes`` at least, so a scan of small
    files has a task for every few of them, and starting tasks takes most of the time.
    """
    spark = scan.sparkSession
    dealt, least = scan.rdd.getNumPartitions(), 4 * spark.sparkContext.defaultParallelism
    each = max(1, TASK_BYTES // max(1, _size(spark.conf.get("spark.sql.files.maxPartitionBytes"))))
    return scan.coalesce(max(least, math.ceil(dealt / each))) if dealt > least and each > 1 else scan


def _local_path(spark: SparkSession, folder: str) -> str | None:
    """``folder`` as a path of the operating system; None where only Spark's file systems reach it."""
    place = folder
    if ":" not in folder.split("/")[0]:  # no file system is named, so the cluster's own counts
        probe = run_dir(spark, "place")
        spark.range(1, numPartitions=1).write.parquet(probe)
        place = spark.read.parquet(probe).select("_metadata.file_path").first()[0]
    return os.path.abspath(re.sub("^file:/*", "/", folder)) if place.startswith("file:") else None


def write_files(spark: SparkSession, rows: DataFrame, folder: str) -> None:
    """One file per row of ``name, content`` in a folder below the shared one: the content (null: none) and a line end.

    Names are distinct and, apart from null, fit a file system; a task that is run
    again puts the same files in place.  On a disk, tasks write the files themselves:
    Spark's writers start processes to set the rights of every single file, and the
    driver moves them one by one.  Elsewhere the text writer does it under names of its own.
    """
    local = _local_path(spark, folder)
    if local is None:
        rows.select(F.col("content").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(folder)
        return

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(local, exist_ok=True)
        draft = os.path.join(local, f".{uuid.uuid4().hex}")  # listings pass over it
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"], strict=True):
                with open(draft, "wb") as f:
                    f.write((content.as_py() or b"") + b"\n")
                os.replace(draft, os.path.join(local, name.as_py() or "null"))
            yield pa.RecordBatch.from_pydict({"files": pa.array([batch.num_rows], pa.int64())})

    os.makedirs(local, exist_ok=True)  # also without rows
    rows.select("name", "content").mapInArrow(put, "files long").agg(F.sum("files")).collect()


def _origin(path: Column) -> Column:
    """A listed path as the image source writes it (it gives local files three slashes)."""
    return F.regexp_replace(path, "^file:/(?!/)", "file:///")


#: So many refused paths are put into one listing filter.
REFUSED_BLOCK = 10_000


def image_headers(spark: SparkSession, folder: str, max_side: int = MAX_SIDE, max_pixels: int = MAX_PIXELS, max_bytes: int | None = None) -> DataFrame:
    """``path, length, width, height`` of every file and the ``reason`` not to decode it (null when fine).

    Nothing is decoded.  Files over ``max_bytes`` are not even read: the length is
    known from the listing.
    """
    listed = read_files(spark, folder).select(F.col("_metadata.file_path").alias("path"), "length", "content")
    small = listed if max_bytes is None else listed.where(F.col("length") <= max_bytes)
    sized = dimension_guard(header_dims(fewer_tasks(small), keep_content=False), max_side, max_pixels)
    if max_bytes is None:
        return sized
    nothing = F.lit(None).cast("int")
    return sized.unionByName(listed.where(F.col("length") > max_bytes).select(
        "path", "length", nothing.alias("width"), nothing.alias("height"), F.lit("file_too_large").alias("reason")))


def _among(names: list[str]) -> Column:
    """Is a file's path one of the names?  The list is one text, since a literal each takes the driver a millisecond."""
    return F.expr("_metadata.file_path in ({})".format(", ".join(f"cast(X'{n.encode().hex()}' as string)" for n in names)))


def _decoded(spark: SparkSession, folder: str, refused: DataFrame, block: int) -> DataFrame:
    """Image rows of all files but the refused ones, which the listing leaves out, so that they are never opened.

    Refused paths come to the driver one block at a time; with more than one block,
    files are taken by ranges of paths and each range is written before the next.
    """
    images = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(folder)
    path = F.col("_metadata.file_path")
    paths = (r.path for r in refused.select("path").orderBy("path").toLocalIterator())
    after, target = None, None
    while True:
        names = list(itertools.islice(paths, block))
        last = len(names) < block
        here = images if after is None else images.where(path > after)
        here = here if last else here.where(path <= names[-1])
        here = fewer_tasks((here.where(~_among(names)) if names else here).select("image.*"))
        if last and target is None:
            return here
        target = target or run_dir(spark, "decoded")
        here.write.mode("append").parquet(target)
        if last:
            return spark.read.schema(here.schema).parquet(target)
        after = names[-1]


def load_images(
    spark: SparkSession, folder: str, max_side: int = MAX_SIDE, max_pixels: int = MAX_PIXELS, max_bytes: int | None = None, block: int = REFUSED_BLOCK,
) -> tuple[DataFrame, DataFrame]:
    """Decoded images, and rejected files with a reason.

    Headers come first: ``dimensions_exceeded`` (by what the header says) and
    ``file_too_large`` (only with ``max_bytes``) are named before decoding and never
    decoded.  ``corrupt_image`` and ``unsupported_format`` are what decoding refuses; a
    decoded image whose header could not be read is held against the bounds again.
    Ids are hashes of the path.  Whether a fourth channel counts is decided
    when the pixels are listed (``explode_pixels(..., keep_alpha=False)``).
    """
    headers = image_headers(spark, folder, max_side, max_pixels, max_bytes)
    refused = cut_lineage(headers.where("reason is not null").select("path", "reason"))
    ident = F.xxhash64("origin").alias("image_id")
    webp = extension(F.col("origin")) == ".webp"
    rows = dimension_guard(_decoded(spark, folder, refused, block), max_side, max_pixels).withColumn(
        "reason", F.when(F.col("width") > 0, F.col("reason")).otherwise(F.when(webp, "unsupported_format").otherwise("corrupt_image")))
    good = rows.where("reason is null").select(ident, "origin", "width", "height", F.col("nChannels").alias("n_channels"), "data")
    bad = rows.where("reason is not null").select(ident, "origin", "reason")
    return good, bad.unionByName(refused.select(_origin(F.col("path")).alias("origin"), "reason").select(ident, "origin", "reason"))


def checked_uploads(spark: SparkSession, folder: str, types: DataFrame, max_bytes: int = MAX_UPLOAD_BYTES) -> DataFrame:
    """``file_name, reason``: the first upload rule that a stored file breaks, its decode result included (null when fine).

    ``types``: file_name, mime as declared, one row per name.  A file without a declared
    type is ``unsupported_format``; a declared one without bytes, which a listing passes
    over, is ``empty_file``.  Dimensions beyond the bounds and WebP files, which are not
    decoded here, are no upload fault.
    """
    _, bad = load_images(spark, folder, max_bytes=max_bytes)
    broken = bad.where("reason = 'corrupt_image'").select("origin", F.lit(False).alias("decodable"))
    listed = read_files(spark, folder).select(
        _origin(F.col("_metadata.file_path")).alias("origin"), F.col("_metadata.file_name").alias("name"), "length", "content")
    declared = types.select(F.col("file_name").alias("name"), "mime")
    heads = listed.where(F.col("length") <= max_bytes).select("origin", "name", F.substring("content", 1, 12).alias("content"))
    told = heads.join(declared, "name", "left").join(broken, "origin", "left").withColumn("decodable", F.coalesce("decodable", F.lit(True)))
    ruled = validate_uploads(told, max_bytes).select(F.col("name").alias("file_name"), "reason")
    large = listed.where(F.col("length") > max_bytes).select(F.col("name").alias("file_name"), F.lit("file_too_large").alias("reason"))
    empty = declared.join(listed.select("name"), "name", "left_anti").select(F.col("name").alias("file_name"), F.lit("empty_file").alias("reason"))
    return ruled.unionByName(large).unionByName(empty)


def image_catalog(files: DataFrame) -> DataFrame:
    """One row per file: name, content type, size, checksum, header dimensions, status."""
    name = F.regexp_extract("path", r"([^/\\]+)$", 1)
    kinds = F.create_map(*[F.lit(v) for pair in _MIME.items() for v in pair])
    return header_dims(files.select(
        "path", name.alias("file_name"), F.try_element_at(kinds, extension(name)).alias("mime"),
        F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("checksum"), "content",
    ), keep_content=False).withColumn("status", F.lit("uploaded"))


def _big_endian(at: int, length: int) -> Column:
    """A signed 32-bit number; null where the header holds none that is positive."""
    value = F.conv(F.hex(F.substring("content", at, length)), 16, 10).try_cast("long")
    return F.when(value <= 0x7FFFFFFF, value.try_cast("int"))


def _little_endian(at: int, length: int) -> Column:
    def byte(k: int) -> Column:
        return F.coalesce(F.conv(F.hex(F.substring("content", at + k, 1)), 16, 10).try_cast("long"), F.lit(0))

    return sum((F.shiftleft(byte(k), 8 * k) for k in range(1, length)), byte(0))


def header_dims(files: DataFrame, keep_content: bool = True) -> DataFrame:
    """Width and height read from the header bytes only; null where there are none.

    Without ``keep_content`` the column ``content`` is left out, and every file is read once only.
    """
    head = F.hex(F.substring("content", 1, 16))
    png = head.startswith("89504E470D0A1A0A") & (F.octet_length("content") >= 24)
    riff = (F.substring(head, 1, 8) == "52494646") & (F.substring(head, 17, 8) == "57454250")
    chunk = F.substring(head, 25, 8)
    low14 = F.lit(0x3FFF)
    bits = _little_endian(22, 4)
    wide = {"56503858": (_little_endian(25, 3) + 1, _little_endian(28, 3) + 1),
            "56503820": (_little_endian(27, 2).bitwiseAND(low14), _little_endian(29, 2).bitwiseAND(low14)),
            "5650384C": (bits.bitwiseAND(low14) + 1, F.shiftrightunsigned(bits, 14).bitwiseAND(low14) + 1)}
    width = F.when(png, _big_endian(17, 4))
    height = F.when(png, _big_endian(21, 4))
    for code, (w, h) in wide.items():
        width, height = width.when(riff & (chunk == code), w.cast("int")), height.when(riff & (chunk == code), h.cast("int"))
    native = files.withColumns({"width": width, "height": height})
    is_jpeg = F.coalesce(head.startswith("FFD8"), F.lit(False))
    if not keep_content:
        return jpeg_dims(native.withColumn("content", F.when(is_jpeg, F.col("content")))).drop("content")
    walked = jpeg_dims(native.where(is_jpeg))
    return native.where(~is_jpeg).unionByName(walked)


def jpeg_dims(files: DataFrame) -> DataFrame:
    """Walks the JPEG segments to the frame header (the one step that needs a loop per file); rows without content stay as they are."""
    def find(data: bytes) -> tuple[int | None, int | None]:
        at = 2
        while at + 9 <= len(data):
            if data[at] != 0xFF:
                return None, None
            marker = data[at + 1]
            if marker == 0xFF:
                at += 1
                continue
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                return int.from_bytes(data[at + 7:at + 9], "big"), int.from_bytes(data[at + 5:at + 7], "big")
            bare = marker == 0x01 or 0xD0 <= marker <= 0xD8
            at += 2 if bare else 2 + int.from_bytes(data[at + 2:at + 4], "big")
        return None, None

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = list(zip(batch["width"].to_pylist(), batch["height"].to_pylist(), strict=True))
            dims = [find(c.as_py()) if c.is_valid else d for c, d in zip(batch["content"], dims, strict=True)]
            for k, side in enumerate(("width", "height")):
                at = batch.schema.get_field_index(side)
                batch = batch.set_column(at, batch.schema.field(at), pa.array([d[k] for d in dims], pa.int32()))
            yield batch

    return files.mapInArrow(walk, files.schema)


def load_svg(files: DataFrame, max_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """SVG text from a binary file table; non UTF-8 files, and those over ``max_bytes`` if given, are refused with a reason."""
    too_large = F.lit(False) if max_bytes is None else F.octet_length("content") > max_bytes
    reason = F.when(too_large, "svg_too_large").when(
        ~F.is_valid_utf8(F.col("content").cast("string")), "invalid_input_svg"
    )
    rows = files.withColumn("reason", reason)
    good = rows.where("reason is null").select("path", F.decode("content", "UTF-8").alias("svg"))
    return good, rows.where("reason is not null").select("path", "reason")


def load_registry(spark: SparkSession, folder: str, schema: T.StructType, one_per_file: bool = True) -> DataFrame:
    """Version records from a tree of JSON files, one per file or one per line; unreadable ones are skipped."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = spark.read.schema(full).option("recursiveFileLookup", "true").option("multiLine", str(one_per_file).lower()).option("mode", "PERMISSIVE").json(folder)
    return rows.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def append_registry(rows: DataFrame, folder: str, key: str = "project_id", buckets: int = 64) -> None:
    """Adds version rows, filed by a hash of the key; history is never rewritten."""
    rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).write.mode("append").partitionBy("bucket").parquet(folder)


def read_registry(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(folder)


def load_catalog(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The catalogue tables, one Parquet folder each."""
    names = ("users", "projects", "assets", "documents", "versions", "layers", "colors")
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}


def write_svg_text(docs: DataFrame, folder: str) -> None:
    """One document per line; documents have no line breaks of their own."""
    docs.select("svg").write.mode("errorifexists").text(folder)
