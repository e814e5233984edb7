"""Small inputs for the golden tests."""

from __future__ import annotations

import struct
import zlib

VERTEX = "doc_id long, path_index int, subpath_index int, closed boolean, i int, x double, y double"
PIXEL = "image_id long, y int, x int, b int, g int, r int, a int"
MASK = "image_id long, mask_id int, y int, x int"


def outline(doc, path, points, sub=0, closed=True):
    return [(doc, path, sub, closed, i, float(x), float(y)) for i, (x, y) in enumerate(points)]


def square(x, y, side):
    return [(x, y), (x + side, y), (x + side, y + side), (x, y + side)]


def vertices(spark, *outlines):
    return spark.createDataFrame([row for o in outlines for row in o], VERTEX)


def png(width, height, rgba):
    """A minimal RGBA file; ``rgba(x, y)`` gives four channel values."""
    raw = b"".join(b"\0" + b"".join(bytes(rgba(x, y)) for x in range(width)) for y in range(height))

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
