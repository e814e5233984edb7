"""WARC archives with revisit records.

Headers (never payloads) are shuffled by payload digest to find the record that
stays; the payload moves once, to the file it is written to.  A revisit record
has fresh headers and an empty block; reading joins it back to its original.

Archives are written by Spark's text writer, whose line separator is the blank
lines that end a WARC record, so any file system that Spark knows will do.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkgrid.llm.common import written

FILE_BYTES = 24 << 20
RECORD = "record_id string, record_type string, page_id long, url string, payload_digest string, payload_bytes long, refers_to_id string, block binary"
_END = b"\r\n\r\n"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: ten hex digits make eight base32 digits."""
    sha = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(sha, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(kind: str, *parts: Column) -> Column:
    h = F.md5(F.concat_ws(" ", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def resolve(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, payload_digest, first_id`` for the rows that revisit another record.

    Of the records with one digest and at least ``min_bytes``, the smallest
    ``page_id`` stays (rows that repeat it stay, too); a null id revisits the
    smallest id if there is one.
    """
    large = headers.where(F.col("payload_bytes") >= min_bytes).select("page_id", "payload_digest")
    first = large.groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    # Written, so that the join can be split where one digest has many records.
    repeated = written(first.where((F.col("n") > 1) & F.col("first_id").isNotNull()).drop("n"), "warc-repeated")
    return large.join(repeated, "payload_digest").where(~F.col("page_id").eqNullSafe(F.col("first_id"))).select("page_id", "payload_digest", "first_id").distinct()


def _clean(value: Column) -> Column:
    return F.regexp_replace(value, r"[\r\n]+", " ")


def write_deduplicated(pages: DataFrame, folder: str, min_bytes: int = 0, file_bytes: int = FILE_BYTES, date: str = "2000-01-01T00:00:00Z") -> None:
    """One record per row of ``page_id, url, html``: a response, or a revisit with an empty block.

    A null html is an empty payload, a null url the empty target; line breaks in
    an url become blanks, since a header is one line.  Rows are dealt to as many
    files as the payloads need at ``file_bytes`` each.  Record ids are named after
    page id, digest and type, so a rerun writes the same archives, and rows equal
    in all three share one.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8") if dict(pages.dtypes)["html"] == "string" else F.coalesce("html", F.lit(b""))
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.select("page_id", "url", "payload", base32_sha1(F.col("payload")).alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    headers = rows.select("page_id", "payload_digest", "payload_bytes")
    total = rows.agg(F.sum("payload_bytes"), F.count(F.lit(1))).first()
    files = max(1, -(-((total[0] or 0) + 600 * total[1]) // file_bytes))
    key = F.concat_ws(" ", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.col("payload_digest"))
    # Payloads and decisions are dealt together, so that the payload is shuffled once, straight to its file.
    revisits = resolve(headers, min_bytes).select(key.alias("_key"), "first_id", F.lit(True).alias("_told"))
    dealt = rows.withColumn("_key", key).unionByName(revisits, allowMissingColumns=True).repartition(files, "_key")
    dealt = dealt.withColumn("first_id", F.max("first_id").over(Window.partitionBy("_key"))).where("_told is null")
    again = F.col("first_id").isNotNull()
    head = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), F.when(again, _urn("revisit", F.col("page_id"), F.col("payload_digest"))).otherwise(_urn("response", F.col("page_id"), F.col("payload_digest")))),
        F.concat(F.lit("WARC-Date: "), F.lit(date)),
        F.concat(F.lit("WARC-Target-URI: "), _clean(F.col("url"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.concat(F.lit("X-Page-ID: "), F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        F.when(again, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(again, F.concat(F.lit("WARC-Refers-To: "), _urn("response", F.col("first_id"), F.col("payload_digest")))),
        F.lit("Content-Type: application/octet-stream"),
        F.concat(F.lit("Content-Length: "), F.when(again, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
    ]
    block = F.when(again, F.lit("")).otherwise(F.col("payload").cast("string"))
    record = F.concat(F.concat_ws("\r\n", *head), F.lit("\r\n\r\n"), block)
    dealt.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(folder)


def parse_archive(data: bytes) -> Iterator[tuple]:
    """The records of one archive, framed by their content length."""
    at = 0
    while at < len(data):
        head_end = data.index(_END, at)
        lines = data[at:head_end].decode("utf-8", "replace").split("\r\n")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start = head_end + 4
        stop = start + int(head["content-length"])
        if not re.match(r"WARC/\d", lines[0]) or stop > len(data):
            raise ValueError(f"no WARC record at byte {at}")
        yield head, data[start:stop]
        at = stop + 4 if data[stop:stop + 4] == _END else stop


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()),
                       ("payload_bytes", pa.int64()), ("refers_to_id", pa.string()), ("block", pa.binary())])
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            data = content.as_py()
            data = gzip.decompress(data) if path.endswith(".gz") else data
            rows: list[tuple] = []
            held = 0
            for head, block in parse_archive(data):
                revisit = head["warc-type"] == "revisit"
                digest = None if revisit else base64.b32encode(hashlib.sha1(block).digest()).decode()
                told = head.get("warc-payload-digest", "").removeprefix("sha1:")
                if digest not in (None, told):
                    raise ValueError(f"payload of {head['warc-record-id']} does not have its digest")
                page = head.get("x-page-id", "")
                rows.append((head["warc-record-id"], head["warc-type"], int(page) if page else None, head.get("warc-target-uri", ""), told, None if revisit else len(block),
                             head.get("warc-refers-to"), block))
                held += len(block)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """All records of the archives in ``folder`` (plain or gzip), one row each; one file is one row of the reader."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")
    return files.mapInArrow(_records, RECORD)


def join_revisits(records: DataFrame) -> DataFrame:
    """Adds ``payload_bytes`` and ``refers_to`` (the original's page id) to revisits; responses stay as they are."""
    originals = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("_bytes"))
    originals = written(originals.dropDuplicates(["refers_to_id"]), "warc-originals")
    revisits = records.where("record_type = 'revisit'").join(originals, "refers_to_id", "left")
    columns = ["record_id", "record_type", "page_id", "url", "payload_digest"]
    return records.where("record_type = 'response'").select(*columns, "payload_bytes", F.lit(None).cast("long").alias("refers_to")).unionByName(
        revisits.select(*columns, F.col("_bytes").alias("payload_bytes"), "refers_to"))
