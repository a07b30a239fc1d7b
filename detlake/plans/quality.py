"""Queries over data checks."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import functions as F

from ..functions import points as P
from ..sources import audit as AU
from ..sources import files as FI
from ..sources import labels as LB
from .ingest import PARSED, PATHS, _files, label_lines
from .registry import query


def _encode(batches):
    """Small image headers made from each row's size: PNG, JPEG (some cut off, some turned), BMP."""
    for pdf in batches:
        out = []
        for i, w, h in zip(pdf["image_id"], pdf["width"], pdf["height"]):
            kind = i % 5
            if kind == 0:
                b = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", w, h)
            elif kind == 1:
                b = b"BM" + bytes(16) + struct.pack("<ii", w, -h)
            elif kind == 2:
                b = b"not an image"
            else:
                exif = b""
                if kind == 4:
                    tiff = b"II*\0" + struct.pack("<IHHHIHHI", 8, 1, 274, 3, 1, 6, 0, 0)
                    exif = b"\xff\xe1" + struct.pack(">H", 8 + len(tiff)) + b"Exif\0\0" + tiff
                frame = b"\xff\xc0" + struct.pack(">HBHH", 11, 8, h, w) + bytes(6)
                b = b"\xff\xd8" + exif + frame + (b"\xff\xd9" if i % 2 else b"")
            out.append((f"/d/images/{i}.bin", b))
        yield pd.DataFrame(out, columns=["path", "content"])


@query(
    "q01_audit_images", "images",
    "SELECT CAST(image_id AS VARCHAR) AS image_id, CASE image_id % 5 WHEN 2 THEN NULL WHEN 4 THEN height ELSE w END AS width, CASE image_id % 5 WHEN 2 THEN NULL WHEN 4 THEN w ELSE height END AS height,"
    " CASE WHEN image_id % 5 = 2 OR w < 10 THEN 'corrupt' WHEN image_id % 5 >= 3 AND image_id % 2 = 0 THEN 'truncated' ELSE 'ok' END AS status"
    " FROM (SELECT image_id, height, CASE WHEN image_id % 7 = 0 THEN 9 ELSE width END AS w FROM images) i",
)
def q01(t):
    im = t.images.withColumn("width", F.when(F.col("image_id") % 7 == 0, 9).otherwise(F.col("width")))
    files = im.select("image_id", "width", "height").mapInPandas(_encode, "path string, content binary")
    return AU.audit_images(files).select("image_id", "width", "height", "status")


def _audit(t):
    parsed = LB.parse_labels(label_lines(t))
    return parsed, LB.audit_labels(parsed, 5)


@query("q02_audit_labels", "det images", f"WITH {PARSED} SELECT path, reason, class_at_limit FROM au WHERE reason IS NOT NULL OR class_at_limit")
def q02(t):
    a = _audit(t)[1]
    return a.filter(F.col("reason").isNotNull() | F.col("class_at_limit")).select("path", "reason", "class_at_limit")


@query("q03_duplicate_labels", "det images", f"WITH {PARSED} SELECT path, rows, duplicates FROM au WHERE duplicates > 0")
def q03(t):
    return _audit(t)[1].filter("duplicates > 0").select("path", "rows", "duplicates")


@query(
    "q04_label_status", "det images",
    f"WITH {PARSED}, im AS (SELECT '/data/labels/' || image_id || '.txt' AS path, image_id FROM images), f AS (SELECT path FROM im WHERE image_id % 11 <> 0)"
    " SELECT count(*) FILTER (WHERE f.path IS NULL) AS missing, count(f.path) AS found, count(*) FILTER (WHERE f.path IS NOT NULL AND au.path IS NULL) AS empty, count(au.reason) AS corrupt, count(*) AS total"
    " FROM im LEFT JOIN f USING (path) LEFT JOIN au ON au.path = f.path",
)
def q04(t):
    path = F.concat(F.lit("/data/labels/"), F.col("image_id").cast("string"), F.lit(".txt"))
    im = t.images.select(path.alias("path"), "image_id")
    files = im.filter(F.col("image_id") % 11 != 0)
    a = _audit(t)[1].join(files, "path", "left_semi")
    return LB.label_status(im, files, a)


@query("q05_add_visibility", "det", "SELECT image_id, det_id, CASE WHEN x1 - 100 < 0 OR y1 - 50 < 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS v FROM det")
def q05(t):
    p = F.array(F.struct((F.col("x1") - 100).alias("x"), (F.col("y1") - 50).alias("y")))
    return t.det.select("image_id", "det_id", P.add_visibility(p)[0]["v"].alias("v"))


@query("q06_isolate_corrupt", "det images", f"WITH {PARSED} SELECT reason IS NULL AS good, CAST(count(*) AS BIGINT) AS files, CAST(sum(rows) AS BIGINT) AS rows FROM au GROUP BY 1")
def q06(t):
    a = _audit(t)[1]
    return a.groupBy(F.col("reason").isNull().alias("good")).agg(F.count("*").alias("files"), F.sum("rows").alias("rows"))


@query("q07_mixed_polygons", "det", "SELECT image_id, det_id, det_id % 3 = 0 AS had, false AS has FROM det")
def q07(t):
    d = t.polys.withColumn("polygon", F.when(F.col("det_id") % 3 == 0, F.col("polygon")))
    out = LB.drop_mixed_polygons(d)
    return out.select("image_id", "det_id", (F.col("det_id") % 3 == 0).alias("had"), F.col("polygon").isNotNull().alias("has"))


HEX = " , ".join(f"bit_xor(('0x' || substr(h, {1 + 15 * i}, 15))::BIGINT) AS x{i}" for i in range(4))


@query(
    "q08_dataset_hash", "",
    f"WITH f AS ({PATHS}), k AS (SELECT length, sha256(path || '|' || length) AS h FROM f), a AS (SELECT CAST(sum(length) AS BIGINT) AS bytes, count(*) AS files, {HEX}, sum(('0x' || substr(h, 1, 15))::HUGEINT) AS s FROM k)"
    " SELECT bytes, files, sha256(bytes || '|' || files || '|' || x0 || '|' || x1 || '|' || x2 || '|' || x3 || '|' || s) AS digest FROM a",
)
def q08(t):
    return FI.dataset_hash(_files(t))


