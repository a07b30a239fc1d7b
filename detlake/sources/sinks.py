"""Writers: label text, prediction JSON, summaries, snapshots and logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import rotated as R
from ..functions import text as X
from ..functions.numbers import py_round
from .commits import read_if_there, replace_keys
from .files import dataset_hash

BOX = ("x1", "y1", "x2", "y2")


def label_lines(df: DataFrame, kind: str = "box", conf: bool = False, track: bool = False) -> DataFrame:
    """``image_id, line``: class, then normalised box, polygon or rotated corners, keypoints, confidence, track id.

    ``df`` has pixel coordinates and the image's ``width`` and ``height``. ``kind`` is ``box``, ``polygon`` or ``rotated``.
    """
    w, h = F.col("width"), F.col("height")

    def flat(points):
        return F.flatten(F.transform(points, lambda q: F.array(q["x"] / w, q["y"] / h)))

    if kind == "box":
        nums = F.array(*B.xyxy2xywhn(*BOX, "width", "height").values())
    elif kind == "polygon":
        nums = flat(F.col("polygon"))
    elif kind == "rotated":
        nums = flat(R.corners("cx", "cy", "w", "h", "r"))
    else:
        raise ValueError(kind)
    if "keypoints" in df.columns:
        nums = F.concat(nums, F.flatten(F.transform("keypoints", lambda q: F.array(q["x"] / w, q["y"] / h, q["v"]))))
    parts = [F.col("cls").cast("string"), X.joined_g(nums)]
    if conf:
        parts.append(X.format_g("conf"))
    if track and "track_id" in df.columns:
        parts.append(F.col("track_id").cast("string"))
    return df.select("image_id", F.concat_ws(" ", *parts).alias("line"))


def class_lines(image_probs: DataFrame, names: Sequence[str], k: int = 5) -> DataFrame:
    """``image_id, rank, line`` with the ``k`` most probable classes as ``0.93 name``."""
    from ..operators.metrics import class_order

    order = F.slice(class_order(F.col("probs")), 1, k)
    table = F.array(*[F.lit(n) for n in names])
    d = image_probs.select("image_id", "probs", F.posexplode(order).alias("rank", "c"))
    line = F.format_string("%.2f %s", py_round(F.element_at("probs", F.col("c") + 1), 2), F.element_at(table, F.col("c") + 1))
    return d.select("image_id", "rank", line.alias("line"))


def write_labels(lines: DataFrame, path: str, shards: int | None = None) -> None:
    """One folder of text per image. With ``shards`` images share folders, which suits millions of small images.

    An image that is written again has its lines replaced, so the same job run twice leaves the same files.
    """
    if shards is None:
        replace_keys(lines.select("image_id", F.col("line").alias("value")), path, "image_id", ["image_id"], "text")
        return
    sharded = lines.withColumn("shard", F.pmod(F.xxhash64("image_id"), F.lit(shards)))
    out = sharded.select(F.concat_ws("\t", F.col("image_id").cast("string"), "line").alias("value"), "shard")
    # the first field of a line is its image
    replace_lines(out, path, "shard")


def replace_lines(rows: DataFrame, path: str, folder: str) -> None:
    """``value`` lines in folders; earlier lines with the same first field are replaced."""
    spark = rows.sparkSession
    key = F.substring_index("value", "\t", 1)
    there = read_if_there(spark, path, "text", rows.schema)
    if there is not None:
        touched = rows.select(F.col(folder).alias("_f")).distinct()
        new = rows.select(key.alias("_k")).distinct()
        other = there.join(touched, F.col(folder) == F.col("_f"), "left_semi").join(new, key == F.col("_k"), "left_anti")
        rows = rows.unionByName(other)
    rows.hint("rebalance", folder).write.format("text").option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(folder).save(path)


def round3(c: Column) -> Column:
    return py_round(c, 3)


def predictions(df: DataFrame, kind: str = "bbox", class_map: dict[int, int] | None = None) -> DataFrame:
    """Rows of the prediction JSON: ``image_id, category_id, bbox, score`` (top-left box, three digits).

    ``kind="obb"`` gives ``rbox`` and ``poly`` instead of ``bbox``; ``kind="kpts"`` adds flat keypoints.
    """
    cat = F.col("cls")
    if class_map is not None:
        table = F.create_map(*[F.lit(v) for kv in class_map.items() for v in kv])
        cat = F.try_element_at(table, F.col("cls"))
    score = py_round("conf", 5).alias("score")
    if kind == "obb":
        rbox = F.array(*[round3(F.col(c)) for c in ("cx", "cy", "w", "h", "r")])
        poly = F.flatten(F.transform(R.corners("cx", "cy", "w", "h", "r"), lambda q: F.array(round3(q["x"]), round3(q["y"]))))
        return df.select("image_id", cat.alias("category_id"), score, rbox.alias("rbox"), poly.alias("poly"))
    box = F.array(*[round3(c) for c in B.xyxy2ltwh(*BOX).values()])
    cols = ["image_id", cat.alias("category_id"), box.alias("bbox"), score]
    if kind == "kpts":
        cols.insert(3, F.flatten(F.transform("keypoints", lambda q: F.array(q["x"], q["y"], q["v"]))).alias("keypoints"))
    return df.select(*cols)


def write_predictions(df: DataFrame, path: str, kind="bbox", class_map=None) -> None:
    predictions(df, kind, class_map).write.mode("overwrite").json(path)


def class_result_lines(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``class_name, line`` of rotated detections: image, score and the eight corner numbers."""
    p = predictions(df, "obb").select("image_id", "category_id", "score", "poly")
    table = F.array(*[F.lit(n.replace(" ", "-")) for n in names])
    nums = F.array_join(F.transform("poly", lambda v: v.cast("string")), " ")
    return p.select(
        F.element_at(table, F.col("category_id") + 1).alias("class_name"),
        F.concat_ws(" ", F.col("image_id").cast("string"), F.col("score").cast("string"), nums).alias("line"),
    )


def write_by_class(df: DataFrame, path: str, names: Sequence[str]) -> None:
    """One folder of result text per class; a class may span many files, so a frequent one is no bottleneck."""
    class_result_lines(df, names).write.mode("overwrite").partitionBy("class_name").text(path)


def summary(df: DataFrame, names: Sequence[str], normalize: bool = False, decimals: int = 5, rotated: bool = False) -> DataFrame:
    """Nested summary rows: name, class, confidence, box and, where present, track id, segments and keypoints."""
    w = F.col("width") if normalize else F.lit(1)
    h = F.col("height") if normalize else F.lit(1)
    table = F.array(*[F.lit(n) for n in names])

    def rx(c):
        return py_round(c / w, decimals)

    def ry(c):
        return py_round(c / h, decimals)

    if rotated:
        p = R.corners("cx", "cy", "w", "h", "r")
        pts = [p[i] for i in range(4)]
        box = F.struct(*[f(q[a]).alias(f"{a}{i + 1}") for i, q in enumerate(pts) for a, f in (("x", rx), ("y", ry))])
    else:
        box = F.struct(rx(F.col("x1")).alias("x1"), ry(F.col("y1")).alias("y1"), rx(F.col("x2")).alias("x2"), ry(F.col("y2")).alias("y2"))
    cols = [
        "image_id",
        F.element_at(table, F.col("cls") + 1).alias("name"),
        F.col("cls").alias("class"),
        py_round("conf", decimals).alias("confidence"),
        box.alias("box"),
    ]
    if "track_id" in df.columns:
        cols.append("track_id")
    if "polygon" in df.columns:
        cols.append(
            F.struct(F.transform("polygon", lambda q: rx(q["x"])).alias("x"), F.transform("polygon", lambda q: ry(q["y"])).alias("y")).alias("segments")
        )
    if "keypoints" in df.columns:
        cols.append(
            F.struct(
                F.transform("keypoints", lambda q: rx(q["x"])).alias("x"),
                F.transform("keypoints", lambda q: ry(q["y"])).alias("y"),
                F.transform("keypoints", lambda q: py_round(q["v"], decimals)).alias("visible"),
            ).alias("keypoints")
        )
    return df.select(*cols)


def write_summary(rows: DataFrame, path: str, fmt: str = "json") -> None:
    """Summary rows as ``json``, ``csv`` (box fields as columns, other nested values as JSON text) or ``xml``; files of text are compressed
    (gzip), since field names and tags are most of it."""
    out = (flat_summary(rows) if fmt == "csv" else rows).write.mode("overwrite").option("compression", "gzip")
    if fmt == "json":
        out.json(path)
    elif fmt == "xml":
        out.format("xml").option("rowTag", "detection").option("rootTag", "detections").save(path)
    elif fmt == "csv":
        out.option("header", "true").csv(path)
    else:
        raise ValueError(fmt)


def flat_summary(rows: DataFrame) -> DataFrame:
    cols = []
    for f in rows.schema.fields:
        if f.name == "box":
            cols += [F.col(f"box.{c}").alias(f"box_{c}") for c in f.dataType.names]
        elif f.dataType.typeName() == "struct":
            cols.append(F.to_json(f.name).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return rows.select(*cols)


SNAPSHOT_VERSION = "1"


def snapshot(spark: SparkSession, files: DataFrame, build, path: str) -> DataFrame:
    """Parsed labels kept as Parquet next to the fingerprint of their files; ``build()`` runs only when that changed."""
    now = dataset_hash(files).withColumn("version", F.lit(SNAPSHOT_VERSION)).first()  # one row
    folder = f"{path}/{now['digest']}-v{now['version']}"
    try:
        seen = spark.read.parquet(f"{folder}/meta").count() > 0
    except Exception as e:  # the folder does not exist yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        seen = False
    if not seen:
        build().write.mode("overwrite").parquet(f"{folder}/data")
        # written last: a snapshot without it is incomplete and is rebuilt
        spark.createDataFrame([tuple(now)], list(now.asDict())).write.mode("overwrite").parquet(f"{folder}/meta")
    return spark.read.parquet(f"{folder}/data")


def stats_json(instance: DataFrame, image: DataFrame) -> DataFrame:
    """One JSON text per split from the per-class counts (one row per split and class on input)."""
    i = instance.groupBy("split").agg(
        F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("cls", "n"))).alias("c")
    )
    i = i.select("split", F.struct("total", F.transform("c", lambda s: s["n"]).alias("per_class")).alias("instance_stats"))
    m = image.groupBy("split").agg(
        F.max("total").alias("total"),
        F.max("unlabelled").alias("unlabelled"),
        F.sort_array(F.collect_list(F.struct("cls", "n"))).alias("c"),
    )
    m = m.select("split", F.struct("total", "unlabelled", F.transform("c", lambda s: s["n"]).alias("per_class")).alias("image_stats"))
    return i.join(m, "split").select("split", F.to_json(F.struct("instance_stats", "image_stats")).alias("stats"))


def write_stats(instance: DataFrame, image: DataFrame, path: str) -> None:
    stats_json(instance, image).write.mode("overwrite").partitionBy("split").text(path)


def split_lines(split: DataFrame) -> DataFrame:
    """``split, line`` with ``./`` paths."""
    return split.select("split", F.concat(F.lit("./"), F.col("path")).alias("line"))


def write_splits(split: DataFrame, path: str) -> None:
    split_lines(split).withColumn("split", F.concat(F.lit("autosplit_"), "split")).write.mode("overwrite").partitionBy("split").text(path)


def metric_rows(runs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Numbers of a log as six-digit text."""
    return runs.select(*[X.format_g(c).alias(c) for c in columns])


def append_metrics(runs: DataFrame, path: str, columns: Sequence[str], keys: Sequence[str] = ("run_id", "epoch"), shards: int | None = None) -> None:
    """Add rows to a CSV log with one folder per ``keys[0]``, or ``shards`` folders shared by all. Rows whose ``keys`` are there
    already are replaced, so a job may run again."""
    numbers = [X.format_g(c).alias(c) for c in columns if c not in keys]
    rows, folder = runs.select(*keys, *numbers), keys[0]
    if shards is not None:
        rows, folder = rows.withColumn("shard", F.pmod(F.xxhash64(keys[0]), F.lit(shards))), "shard"
    replace_keys(rows, path, folder, keys, "csv", header="true")


def to_json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("line"))


def parse_json_lines(df: DataFrame, schema: str) -> DataFrame:
    return df.select(F.from_json("line", schema).alias("r")).select("r.*")
