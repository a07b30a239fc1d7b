"""Plain-text label files: one object per line, class first, one file per image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.boxes import xyxy2xywh
from ..functions.points import add_visibility
from ..functions.rotated import envelope, point

BOX = ("cx", "cy", "w", "h")


def read_label_lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, pos, line`` of all non-empty lines below ``path``; ``pos`` grows along a file."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(path)
    df = df.select(
        F.regexp_replace("_metadata.file_path", "^file:(//)?", "").alias("path"),
        F.monotonically_increasing_id().alias("pos"),
        F.col("value").alias("line"),
    )
    return df.filter(F.trim("line") != "")


def tokens(lines: DataFrame) -> DataFrame:
    """Adds ``v``, the numbers of a line; a token that is no number becomes NULL."""
    parts = F.split(F.trim("line"), r"\s+")
    return lines.withColumn("v", F.transform(parts, lambda s: s.try_cast("double")))


def _pairs(v: Column, start: int) -> Column:
    """Numbers from index ``start`` (1-based) as points."""
    n = F.greatest(F.floor((F.size(v) - (start - 1)) / 2).cast("int"), F.lit(0))
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: point(F.element_at(v, i * 2 + start), F.element_at(v, i * 2 + start + 1)))


def parse_labels(lines: DataFrame, task: str = "detect", nkpt: int = 0, ndim: int = 3) -> DataFrame:
    """Lines to typed rows, plus what the file checks need.

    For every task but ``pose`` a single line with more than six tokens turns the whole file into polygons, whose boxes are
    derived. Adds ``cls``, the centre-format box, ``polygon``, ``keypoints``, ``n_tokens`` and ``bad`` (not parseable).
    """
    t = tokens(lines).withColumn("n_tokens", F.size("v"))
    if task == "pose":
        t = t.withColumn("is_poly", F.lit(False))
    else:
        # one row per file; lines of a file mostly combine before the shuffle
        kind = t.groupBy("path").agg((F.max("n_tokens") > 6).alias("is_poly"))
        t = t.join(kind, "path")
    v, poly = F.col("v"), F.col("is_poly")
    bad = F.exists(v, lambda x: x.isNull()) | F.when(poly, (F.size(v) % 2 == 0) | (F.size(v) < 3)).otherwise(F.lit(False))
    t = t.withColumns({"bad": bad, "cls": F.try_element_at(v, F.lit(1))})
    t = t.withColumn("polygon", F.when(poly & ~F.col("bad"), _pairs(v, 2)))
    derived = xyxy2xywh(*envelope("polygon").values())
    box = {c: F.when(poly, derived[c]).otherwise(F.try_element_at(v, F.lit(i + 2))) for i, c in enumerate(BOX)}
    t = t.withColumns(box)
    if task == "pose":
        step = F.lit(ndim)
        pts = F.transform(
            F.sequence(F.lit(0), F.lit(nkpt - 1)),
            lambda i: F.struct(
                F.try_element_at(v, i * step + 6).alias("x"),
                F.try_element_at(v, i * step + 7).alias("y"),
                (F.try_element_at(v, i * step + 8) if ndim == 3 else F.lit(1.0)).alias("v"),
            ),
        )
        t = t.withColumn("keypoints", pts if ndim == 3 else add_visibility(pts))
    else:
        t = t.withColumn("keypoints", F.lit(None).cast("array<struct<x:double,y:double,v:double>>"))
    return t


def _expected(task: str, nkpt: int, ndim: int) -> int:
    return 5 + nkpt * ndim if task == "pose" else 5


def _identity(task: str) -> list[str]:
    return ["cls", *BOX, "keypoints"] if task == "pose" else ["cls", *BOX]


def audit_labels(parsed: DataFrame, nc: int, task: str = "detect", nkpt: int = 0, ndim: int = 3) -> DataFrame:
    """One row per label file: ``path, rows, duplicates, reason, class_at_limit``; ``reason`` is NULL for a good file.

    Rules in order: numbers that cannot be read, wrong column count, a coordinate above 1, a negative value, a class above
    ``nc``. A class equal to ``nc`` passes, as it always did; ``class_at_limit`` reports it.
    """
    want = _expected(task, nkpt, ndim)
    wrong = F.when(F.col("is_poly"), F.lit(False)).otherwise(F.col("n_tokens") != want)
    if task == "pose":
        xy = F.flatten(F.transform("keypoints", lambda k: F.array(k["x"], k["y"])))
        coords, values = F.array_max(xy), F.array_min(F.col("v"))
    else:
        coords = F.greatest(*[F.col(c) for c in BOX])
        values = F.least(F.col("cls"), *[F.col(c) for c in BOX])
    per_row = parsed.select(
        "path", "bad", wrong.alias("wrong"), (coords > 1).alias("big"), (values < 0).alias("neg"),
        (F.col("cls") > nc).alias("over"), (F.col("cls") == nc).alias("edge"), *_identity(task),
    )
    # rows that are equal in a file count once; two shuffles with partial sums instead of one set per file
    uniq = per_row.groupBy("path", *_identity(task)).agg(
        F.count("*").alias("n"), *[F.max(c).alias(c) for c in ("bad", "wrong", "big", "neg", "over", "edge")]
    )
    out = uniq.groupBy("path").agg(
        F.sum("n").alias("rows"),
        F.sum(F.col("n") - 1).alias("duplicates"),
        *[F.max(c).alias(c) for c in ("bad", "wrong", "big", "neg", "over", "edge")],
    )
    reason = (
        F.when(F.col("bad"), "unreadable")
        .when(F.col("wrong"), "columns")
        .when(F.col("big"), "out of bounds")
        .when(F.col("neg"), "negative")
        .when(F.col("over"), "class")
    )
    return out.select(
        "path", "rows", "duplicates", reason.alias("reason"), F.coalesce("edge", F.lit(False)).alias("class_at_limit")
    )


def dedupe_labels(parsed: DataFrame, task: str = "detect") -> DataFrame:
    """Equal rows of a file reduced to the first one (its polygon is kept)."""
    ident = _identity(task)
    rest = [c for c in parsed.columns if c not in ("path", *ident)]
    first = F.min_by(F.struct(*rest), F.col("pos")) if "pos" in parsed.columns else F.min(F.struct(*rest))
    out = parsed.groupBy("path", *ident).agg(first.alias("_r"))
    return out.select("path", *ident, *[F.col(f"_r.{c}").alias(c) for c in rest])


def good_labels(parsed: DataFrame, audit: DataFrame, task: str = "detect") -> DataFrame:
    """Distinct rows of the files that pass the checks; a bad file never fails the job."""
    fine = parsed.join(audit.filter(F.col("reason").isNull()).select("path"), "path", "left_semi")
    out = dedupe_labels(fine, task)
    return out.select("path", F.col("cls").cast("int").alias("cls"), *BOX, "polygon", "keypoints")


def read_labels(
    spark: SparkSession, path: str, nc: int, task: str = "detect", nkpt: int = 0, ndim: int = 3, root: str | None = None
) -> DataFrame:
    """Clean annotations of a label folder, normalised centre format, with ``image_id`` from the path below ``root`` (see
    ``image_key``) or else from the file name."""
    parsed = parse_labels(read_label_lines(spark, path), task, nkpt, ndim)
    good = good_labels(parsed, audit_labels(parsed, nc, task, nkpt, ndim), task)
    return good.withColumn("image_id", X.image_key("path", root))


def label_status(images: DataFrame, files: DataFrame, audit: DataFrame) -> DataFrame:
    """Counts over images: labels ``missing``, ``found``, ``empty``, ``corrupt``, and the ``total``.

    ``images`` has the expected label ``path`` of each image, ``files`` the existing label files, ``audit`` one row per file
    with content.
    """
    j = images.select("path").join(files.select("path", F.lit(1).alias("there")), "path", "left")
    j = j.join(audit.select("path", "rows", "reason"), "path", "left")
    found = F.col("there").isNotNull()
    return j.agg(
        F.count_if(~found).alias("missing"),
        F.count_if(found).alias("found"),
        F.count_if(found & F.col("rows").isNull()).alias("empty"),
        F.count_if(F.col("reason").isNotNull()).alias("corrupt"),
        F.count("*").alias("total"),
    )


def drop_mixed_polygons(ann: DataFrame) -> DataFrame:
    """When only some of the objects have polygons, use boxes for all: the polygons become NULL."""
    counts = ann.agg(F.count("*").alias("_n"), F.count("polygon").alias("_p"))
    out = ann.join(F.broadcast(counts))  # one row
    return out.withColumn("polygon", F.when(F.col("_n") == F.col("_p"), F.col("polygon"))).drop("_n", "_p")
