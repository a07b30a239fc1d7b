"""Queries over tracking, streams and model scoring."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..session import materialize, scratch_path
from ..streaming import score as SC
from ..streaming import stateful as SF
from ..streaming import track as TR
from ..streaming.core import Options
from .analytics import ANGLE, CROSS, MEET, STEPS, _lanes
from .registry import query, r6

BOX = ("x1", "y1", "x2", "y2")
#: Rows of a file of a stream, at least.
QUARTER_FILE = 250_000


def _det(t):
    """Detections per frame: the track rows without their ids."""
    return t.tracks.select(
        "video_id", "frame_no", F.col("ts").cast("timestamp").alias("ts"), F.col("track_id").alias("det_id"), F.ascii("cls").alias("cls"), "conf", *BOX
    )


def _files(t, df, parts=4):
    path = scratch_path(t.spark, "stream")
    df.repartitionByRange(parts, "frame_no").write.parquet(path)
    return path


def _stream(t, df, per_trigger=None, **kw):
    df = df.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in df.columns else df
    return SF.read_detection_stream(t.spark, _files(t, df), df.schema, per_trigger=per_trigger, **kw)


def _scattered(t, df, watermark=True):
    """Stream of a quarter of the rows per micro-batch in which frames are split over batches and rows come out of order.

    Each half of the time span lies in two quarters, dealt by frame and object. The watermark's delay covers a half, so the first half is
    handled when the second arrives; a last file holds one row of another key far in the future, which closes all frames. The rows are
    made once. All quarters have as many files, which grow in number with the rows: no task holds a quarter.
    """
    df = materialize(df.withColumn("ts", F.col("ts").cast("timestamp")), "rows")
    path = scratch_path(t.spark, "scattered")
    lo, hi = df.agg(F.min("ts"), F.max("ts")).first()
    middle = lo + (hi - lo) / 2
    odd = F.pmod(F.col("frame_no") + F.col("track_id" if "track_id" in df.columns else "det_id"), F.lit(2)) == 1
    quarters = [half & part for half in (F.col("ts") < F.lit(middle), F.col("ts") >= F.lit(middle)) for part in (odd, ~odd)]
    sizes = df.agg(*[F.count_if(q) for q in quarters]).first()  # one row
    files = max(1, min(sizes) // QUARTER_FILE)
    for q in quarters:
        df.where(q).repartition(files).write.mode("append").parquet(path)
    closing = {f.name: F.lit(None).cast(f.dataType) for f in df.schema.fields}
    closing |= {k: F.lit(-1).cast(df.schema[k].dataType) for k in ("video_id", "track_id", "det_id") if k in closing}
    closing |= {"ts": F.lit(hi + 4 * (hi - lo)), "frame_no": F.lit(1 << 40).cast("bigint")}
    t.spark.range(1).select(*[c.alias(k) for k, c in closing.items()]).coalesce(1).write.mode("append").parquet(path)
    stream = SF.read_detection_stream(t.spark, path, df.schema, per_trigger=files)
    return stream.withWatermark("ts", f"{int((hi - middle).total_seconds()) + 1} seconds") if watermark else stream


def _drain(t, out, mode="append"):
    """Run a stream over all files there are and read what it wrote."""
    path, check = scratch_path(t.spark, "sink"), scratch_path(t.spark, "check")
    q = out.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", check).trigger(availableNow=True).start(path)
    q.awaitTermination()
    return t.spark.read.schema(out.schema).parquet(path)


def _tracks(df):
    return df.select("video_id", "frame_no", "track_id", "det_id", *r6(**{c: F.col(c) for c in BOX}))


@query("t01_track")
def t01(t):
    return _tracks(TR.track(_det(t)))


@query("t01_track_stream")
def t01s(t):
    return _tracks(_drain(t, TR.track_stream(_scattered(t, _det(t)))))


@query("t02_track_bot")
def t02(t):
    warp = F.array(*[F.lit(v) for v in (1.0, 0.0, 1.5, 0.0, 1.0, -0.5)])
    return _tracks(TR.track(_det(t).withColumn("warp", warp), Options(kind="bot")))


# Objects far apart that drift half a pixel a frame, so that ids follow from the rows: object 0 is always there, 1 misses nine
# frames (less than the buffer, its id stays), 2 misses 49 (more, it comes back as a new track), 3 comes five frames late. The
# first frame's tracks are reported at once, later ones from their second frame on.
SCENE = """
scene AS (
  SELECT v.video_id, f.frame_no, o.k, dense_rank() OVER (PARTITION BY v.video_id ORDER BY f.frame_no) - 1 AS r
  FROM (SELECT DISTINCT CAST(FLOOR(event_id / 40) AS BIGINT) AS frame_no FROM events) f,
    (SELECT DISTINCT user_id % 4 AS video_id FROM events) v, (SELECT * FROM (VALUES (0), (1), (2), (3)) AS w(k)) o),
shown AS (SELECT * FROM scene WHERE NOT (k = 1 AND r BETWEEN 10 AND 18) AND NOT (k = 2 AND r BETWEEN 10 AND 58) AND NOT (k = 3 AND r < 5))"""
SCENE_IDS = f"""WITH {SCENE} SELECT video_id, frame_no, CAST(k AS BIGINT) AS det_id, CAST(CASE WHEN k = 2 AND r >= 59 THEN 5 ELSE k + 1 END AS BIGINT) AS track_id
FROM shown WHERE NOT (k = 3 AND r = 5) AND NOT (k = 2 AND r = 59)"""


def _scene(t):
    rows = t.spark.sql(f"WITH {SCENE.replace('FROM events', 'FROM {events}')} SELECT * FROM shown", events=t.table("events"))
    x, y = F.col("k") * 300 + F.col("r") * 0.5, F.lit(100.0)
    return rows.select(
        "video_id", "frame_no", F.timestamp_seconds(F.col("r") + 1_700_000_000).alias("ts"), F.col("k").cast("bigint").alias("det_id"),
        F.lit(0).alias("cls"), F.lit(0.9).alias("conf"), x.alias("x1"), y.alias("y1"), (x + 80).alias("x2"), (y + 120).alias("y2"),
    )


@query("t01_track_scene", "", SCENE_IDS)
def t01_scene(t):
    return TR.track(_scene(t)).select("video_id", "frame_no", "det_id", "track_id")


@query("t01_track_scene_stream", "", SCENE_IDS)
def t01_scene_stream(t):
    return _drain(t, TR.track_stream(_scattered(t, _scene(t)))).select("video_id", "frame_no", "det_id", "track_id")


@query("t02_track_bot_scene", "", SCENE_IDS)
def t02_scene(t):
    return TR.track(_scene(t), Options(kind="bot")).select("video_id", "frame_no", "det_id", "track_id")


@query("t05_track_per_source", "tracks", "SELECT DISTINCT video_id, session, frame_no FROM (SELECT video_id, frame_no, frame_no // 100 AS session, max(conf) AS c FROM tracks GROUP BY 1, 2, 3) q WHERE c >= 0.25 AND frame_no % 100 = 0")
def t05(t):
    """A tracker per video and session: ids restart, and the first frame of a session is reported at once."""
    d = _det(t).withColumn("session", F.floor(F.col("frame_no") / 100))
    out = TR.track(d, keys=("video_id", "session")).filter(F.col("frame_no") % 100 == 0)
    return out.select("video_id", "session", "frame_no").distinct()


@query("s20_detection_stream", "tracks", "SELECT video_id, frame_no, track_id FROM tracks WHERE frame_no % 2 = 0")
def s20(t):
    s = _stream(t, t.tracks.select("video_id", "frame_no", "track_id"), stride=2)
    return _drain(t, s)


@query("t03_latest_frame", "tracks", "SELECT video_id, frame_no, track_id FROM tracks WHERE (video_id, frame_no) IN (SELECT (video_id, max(frame_no)) FROM tracks GROUP BY video_id)")
def t03(t):
    s = _stream(t, t.tracks.select("video_id", "frame_no", "track_id"))
    path = scratch_path(t.spark, "latest")
    w = SF.write_latest(s, path, scratch_path(t.spark, "check"))
    w.trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(path).drop("batch")


@query(
    "t06_windowed_counts", "tracks",
    "SELECT video_id, CAST(epoch(time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '1970-01-01')) AS BIGINT) AS start, count(*) AS n FROM tracks GROUP BY 1, 2",
)
def t06(t):
    """Windows come out once, when the watermark has passed them; their counts then leave the state."""
    s = _scattered(t, t.tracks.select("video_id", "frame_no", "track_id", "ts"), watermark=False)
    lo, hi = t.tracks.agg(F.min(F.col("ts").cast("timestamp")), F.max(F.col("ts").cast("timestamp"))).first()
    w = SF.windowed(s, "5 minutes", watermark=f"{int((hi - lo).total_seconds() / 2) + 1} seconds")
    return _drain(t, w).select("video_id", F.unix_seconds("start").alias("start"), "n")


@query(
    "t06_sliding_counts", "tracks",
    "WITH b AS (SELECT video_id, CAST(floor(epoch(ts) / 300) * 300 AS BIGINT) - k * 300 AS start FROM tracks, (VALUES (0), (1)) v(k)) SELECT video_id, start, count(*) AS n FROM b GROUP BY 1, 2",
)
def t06s(t):
    """Sliding windows on a stream; each comes out once, when the watermark has passed its end."""
    s = _scattered(t, t.tracks.select("video_id", "frame_no", "track_id", "ts"), watermark=False)
    lo, hi = t.tracks.agg(F.min(F.col("ts").cast("timestamp")), F.max(F.col("ts").cast("timestamp"))).first()
    w = SF.windowed(s, "10 minutes", "5 minutes", watermark=f"{int((hi - lo).total_seconds() / 2) + 1} seconds")
    return _drain(t, w).select("video_id", F.unix_seconds("start").alias("start"), "n")


@query("t07_crossing_stream", "tracks", f"WITH {CROSS} SELECT region_id::BIGINT AS region_id, video_id, track_id, frame_no, cls, CASE WHEN goes THEN 'IN' ELSE 'OUT' END AS direction FROM fi")
def t07(t):
    out = _drain(t, SF.first_events(_scattered(t, t.tracks), _lanes(t), "crossing"))
    return out.select("region_id", "video_id", "track_id", "frame_no", "cls", "direction")


@query(
    "t07_speed_stream", "tracks",
    f"WITH {STEPS}, h AS (SELECT *, epoch_us(ts) - epoch_us(pts) AS dt, ROW_NUMBER() OVER (PARTITION BY video_id, track_id ORDER BY frame_no) AS k FROM sp WHERE {MEET})"
    " SELECT video_id, track_id, frame_no, round(CASE WHEN dt > 0 THEN abs(cy - py) * 1e6 / dt END, 6) AS speed FROM h WHERE k = 1",
)
def t07s(t):
    out = _drain(t, SF.first_events(_scattered(t, t.tracks), t.region("band"), "speed"))
    return out.select("video_id", "track_id", "frame_no", F.round("speed", 6).alias("speed"))


@query(
    "t07_reps_stream", "tracks",
    f"WITH a AS (SELECT video_id, track_id, frame_no, {ANGLE} AS angle FROM tracks), e AS (SELECT *, CASE WHEN angle < 90 THEN 'down' WHEN angle > 145 THEN 'up' END AS ev FROM a),"
    " l AS (SELECT *, last_value(ev IGNORE NULLS) OVER (PARTITION BY video_id, track_id ORDER BY frame_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS le FROM e)"
    " SELECT video_id, track_id, frame_no, coalesce(ev, le, '-') AS stage, CAST(sum(CASE WHEN ev = 'down' AND le = 'up' THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, track_id ORDER BY frame_no) AS BIGINT) AS reps FROM l",
)
def t07r(t):
    angle = ((F.col("track_id") * 37 + F.col("frame_no") * 53) % 180).cast("double")
    return _drain(t, SF.reps_stream(_scattered(t, t.tracks.select("video_id", "track_id", "frame_no", "ts", angle.alias("angle")))))


@query("t07_alarm_stream", "tracks", "WITH c AS (SELECT video_id, frame_no, count(*) AS n FROM tracks GROUP BY 1, 2) SELECT video_id, min(frame_no) AS frame_no, arg_min(n, frame_no) AS objects FROM c WHERE n > 12 GROUP BY 1")
def t07a(t):
    return _drain(t, SF.alarm_stream(_scattered(t, t.tracks.select("video_id", "frame_no", "track_id", "ts")), 12))


def _detector():
    """Stand-in model: two boxes per image, from its size."""

    def model(pdf):
        rows = []
        for i, w, h in zip(pdf["image_id"], pdf["width"], pdf["height"]):
            rows += [(i, 0, int(i % 5), 0.9, 0.0, 0.0, w / 2, h / 2), (i, 1, int((i + 1) % 5), 0.4, w / 4, h / 4, float(w), float(h))]
        return pd.DataFrame(rows, columns=["image_id", "det_id", "cls", "conf", *BOX])

    return model


def _segmenter():
    def model(pdf):
        rows = []
        for i, boxes in zip(pdf["image_id"], pdf["boxes"]):
            rows += [(i, b["det_id"], [{"x": b["x1"], "y": b["y1"]}, {"x": b["x2"], "y": b["y1"]}, {"x": b["x2"], "y": b["y2"]}]) for b in boxes]
        return pd.DataFrame(rows, columns=["image_id", "det_id", "polygon"])

    return model


DET = "image_id bigint, det_id int, cls int, conf double, x1 double, y1 double, x2 double, y2 double"
STUB = "SELECT image_id, 0 AS det_id, CAST(image_id % 5 AS INT) AS cls, 0.9::DOUBLE AS conf, width / 2 AS x2 FROM images UNION ALL SELECT image_id, 1, CAST((image_id + 1) % 5 AS INT), 0.4::DOUBLE, width::DOUBLE FROM images"


@query("u01_score", "images", STUB)
def u01(t):
    return SC.score(t.images, _detector, DET).select("image_id", "det_id", "cls", "conf", "x2")


@query("u02_embed", "images", "SELECT image_id, width / 100.0::DOUBLE AS a, height / 100.0::DOUBLE AS b FROM images")
def u02(t):
    def load():
        return lambda pdf: [[float(w), float(h)] for w, h in zip(pdf["width"], pdf["height"])]

    e = SC.embed(t.images, load)
    return e.select("image_id", (F.col("embedding")[0].cast("double") / 100).alias("a"), (F.col("embedding")[1].cast("double") / 100).alias("b"))


@query("j12_auto_annotate", "images", f"SELECT image_id, det_id, cls, x2, 3 AS points FROM ({STUB}) s")
def j12(t):
    seg = "image_id bigint, det_id int, polygon array<struct<x:double,y:double>>"
    out = SC.auto_annotate(t.images, _detector, _segmenter, DET, seg)
    return out.select("image_id", "det_id", "cls", F.col("polygon")[1]["x"].alias("x2"), F.size("polygon").alias("points"))


@query(
    "u05_custom_similarity", "det gt",
    "SELECT count(*) AS pairs FROM det a JOIN gt b ON a.image_id = b.image_id AND a.cls = b.cls WHERE (greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0)) / least((a.x2 - a.x1) * (a.y2 - a.y1), (b.x2 - b.x1) * (b.y2 - b.y1)) >= 0.9",
)
def u05(t):
    """Overlap over the smaller box, passed in as the similarity."""
    from ..functions.boxes import area
    from ..functions.similarity import intersection
    from ..operators.joins import overlap_join

    def smaller(a, b):
        return intersection(a, b) / F.least(area(*a), area(*b))

    d, g = t.det.select("image_id", "det_id", "cls", *BOX), t.gt.select("image_id", "ann_id", "cls", *BOX)
    return overlap_join(d, g, ("image_id", "cls"), 0.9, smaller).agg(F.count("*").alias("pairs"))


