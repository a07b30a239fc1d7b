"""Image file checks from header bytes."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import materialize
from .files import IMAGE_SUFFIXES

SCHEMA = "path string, format string, width int, height int, tail string"


def _tiff_tags(b: bytes, at: int = 0) -> dict[int, int]:
    """First-directory tags with small integer values."""
    order = "<" if b[at : at + 2] == b"II" else ">"
    (start,) = struct.unpack_from(order + "I", b, at + 4)
    (n,) = struct.unpack_from(order + "H", b, at + start)
    out = {}
    for i in range(n):
        tag, kind, _ = struct.unpack_from(order + "HHI", b, at + start + 2 + 12 * i)
        spot = at + start + 10 + 12 * i
        if kind == 3:
            (out[tag],) = struct.unpack_from(order + "H", b, spot)
        elif kind == 4:
            (out[tag],) = struct.unpack_from(order + "I", b, spot)
    return out


def _jpeg(b: bytes) -> tuple[int, int]:
    """Size from the frame header, sides swapped when the orientation tag turns the picture by 90 degrees."""
    i, turned = 2, False
    while i + 9 < len(b):
        if b[i] != 0xFF:
            raise ValueError("marker expected")
        m = b[i + 1]
        if m == 0xFF or m == 0x01 or 0xD0 <= m <= 0xD8:
            i += 1 if m == 0xFF else 2
            continue
        (size,) = struct.unpack_from(">H", b, i + 2)
        if m == 0xE1 and b[i + 4 : i + 10] == b"Exif\0\0":
            try:
                turned = _tiff_tags(b, i + 10).get(274) in (6, 8)
            except struct.error:
                pass
        if 0xC0 <= m <= 0xCF and m not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack_from(">HH", b, i + 5)
            return (h, w) if turned else (w, h)
        i += 2 + size
    raise ValueError("no frame header")


def header(b: bytes) -> tuple[str, int, int]:
    """Format, width and height of an encoded image."""
    if b[:8] == b"\x89PNG\r\n\x1a\n":
        return ("png", *struct.unpack_from(">II", b, 16))
    if b[:2] == b"\xff\xd8":
        return ("jpeg", *_jpeg(b))
    if b[:2] == b"BM":
        w, h = struct.unpack_from("<ii", b, 18)
        return "bmp", w, abs(h)
    if b[:4] in (b"II*\0", b"MM\0*"):
        t = _tiff_tags(b)
        return "tiff", t[256], t[257]
    if b[:4] == b"RIFF" and b[8:12] == b"WEBP":
        kind = b[12:16]
        if kind == b"VP8X":
            return "webp", 1 + int.from_bytes(b[24:27], "little"), 1 + int.from_bytes(b[27:30], "little")
        if kind == b"VP8L":
            v = int.from_bytes(b[21:25], "little")
            return "webp", (v & 0x3FFF) + 1, ((v >> 14) & 0x3FFF) + 1
        w, h = struct.unpack_from("<HH", b, 26)
        return "webp", w & 0x3FFF, h & 0x3FFF
    if b[:2] in (b"PF", b"Pf"):
        w, h = b.split(b"\n", 2)[1].split()
        return "pfm", int(w), int(h)
    if b[4:8] == b"ftyp" and b[8:12] in (b"heic", b"heix", b"mif1", b"hevc"):
        at = b.find(b"ispe")
        if at > 0:
            return ("heic", *struct.unpack_from(">II", b, at + 8))
    raise ValueError("unknown format")


#: Bytes of a file that go to Python first; sizes stand there in nearly all files.
HEAD = 1 << 16


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for path, content, tail in zip(pdf["path"], pdf["content"], pdf["tail"]):
            try:
                fmt, w, h = header(bytes(content))
            except (ValueError, KeyError, IndexError, struct.error):
                fmt, w, h = None, None, None
            rows.append((path, fmt, w, h, tail))
        out = pd.DataFrame(rows, columns=["path", "format", "width", "height", "tail"])
        yield out.astype({"width": "Int32", "height": "Int32"})


def audit_images(files: DataFrame, root: str | None = None) -> DataFrame:
    """``image_id, path, width, height, status, reason`` of a ``path, content`` table.

    ``status`` is ``ok``, ``truncated`` (a JPEG without its end marker; usable, reported only) or ``corrupt``. Only the first
    ``HEAD`` bytes of a file leave the JVM, and its last two. Files whose size is not found there are read in full; their paths are
    a table of their own, which Spark broadcasts only if it is small.
    """
    tail = F.lower(F.hex(F.substring("content", -2, 2)))
    head = files.select("path", F.substring("content", 1, HEAD).alias("content"), tail.alias("tail"))
    first = materialize(head.mapInPandas(_read, SCHEMA), "headers")
    long = files.where(F.length("content") > HEAD).select("path", "content", tail.alias("tail"))
    open_ = first.where("format IS NULL").select("path").distinct()
    again = materialize(long.join(open_, "path", "left_semi").mapInPandas(_read, SCHEMA), "headers")
    h = first.join(again.select("path").distinct(), "path", "left_anti").unionByName(again)
    known = F.col("format").isin(IMAGE_SUFFIXES)
    small = (F.col("width") < 10) | (F.col("height") < 10)
    reason = (
        F.when(F.col("format").isNull(), "unreadable")
        .when(small, "smaller than 10 pixels")
        .when(~known, "format")
        .when((F.col("format") == "jpeg") & (F.col("tail") != "ffd9"), "no end marker")
    )
    status = F.when(reason.isNull(), "ok").when(reason == "no end marker", "truncated").otherwise("corrupt")
    return h.select(X.image_key("path", root).alias("image_id"), "path", "width", "height", status.alias("status"), reason.alias("reason"))


def read_image_audit(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return audit_images(df.select(F.regexp_replace("path", "^file:", "").alias("path"), "content"), root)
