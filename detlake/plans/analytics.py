"""Queries over track analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import video as V
from ..session import scratch_path
from ..sources.regions import read_regions
from .registry import keypoints_of, query, r6, sql6

CENTER = "(x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy"
STEPS = f"""tc AS (SELECT video_id, frame_no, ts, track_id, cls, {CENTER} FROM tracks),
sp AS (SELECT *, lag(cx) OVER w AS px, lag(cy) OVER w AS py, lag(ts) OVER w AS pts FROM tc WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame_no))"""
# strict and closed containment in the axis-aligned sample regions
BAND = "cx > 20 AND cx < 1080 AND cy > 360 AND cy < 400"
SLOTS = "(VALUES (3, 100, 300), (4, 600, 800)) v(region_id, a, b)"


@query("j09_previous_point", "tracks", f"WITH {STEPS} SELECT video_id, track_id, frame_no, {sql6(px='px', py='py')} FROM sp")
def j09(t):
    return V.previous_point(t.tracks).select("video_id", "track_id", "frame_no", *r6(px=F.col("px"), py=F.col("py")))


@query("j04_in_region", "tracks", f"WITH {STEPS} SELECT 1 AS region_id, video_id, track_id, frame_no FROM tc WHERE {BAND} UNION ALL SELECT region_id, video_id, track_id, frame_no FROM tc, {SLOTS} WHERE cx > a AND cx < b AND cy > 340 AND cy < 420")
def j04(t):
    poly = t.regions.filter(F.size("points") > 2)
    return J.in_region(V.with_centers(t.tracks), poly).select("region_id", "video_id", "track_id", "frame_no")


# a saw-toothed outline: 40 teeth of 20 px below a slanting roof
SAW = [(100.0, 360.0), (900.0, 344.0), *[(900.0 - 10 * k, 400.0 + 16 * (k % 2)) for k in range(81)]]
SAW_SQL = ", ".join(f"({i}, {x}::DOUBLE, {y}::DOUBLE)" for i, (x, y) in enumerate(SAW))


@query(
    "j04_in_outline", "tracks",
    f"WITH {STEPS}, v(i, x, y) AS (VALUES {SAW_SQL}), e AS (SELECT a.x AS ax, a.y AS ay, b.x AS bx, b.y AS \"by\" FROM v a JOIN v b ON b.i = (a.i + 1) % {len(SAW)}),"
    " hit AS (SELECT video_id, track_id, frame_no, cx, cy, count(*) FILTER (((ay > cy) <> (\"by\" > cy)) AND cx < (bx - ax) * (cy - ay) / (\"by\" - ay) + ax) % 2 = 1 AS odd,"
    " bool_or((bx - ax) * (cy - ay) = (\"by\" - ay) * (cx - ax) AND cx BETWEEN least(ax, bx) AND greatest(ax, bx) AND cy BETWEEN least(ay, \"by\") AND greatest(ay, \"by\")) AS edge"
    " FROM tc, e GROUP BY ALL) SELECT video_id, track_id, frame_no FROM hit WHERE odd AND NOT edge",
)
def j04_outline(t):
    """Rows inside an outline of 83 corners: most are told by their cell."""
    saw = t.spark.createDataFrame([(9, SAW)], "region_id int, points array<struct<x:double,y:double>>")
    return J.in_region(V.with_centers(t.tracks), saw).select("video_id", "track_id", "frame_no")


@query("j05_in_region_inclusive", "tracks", f"WITH {STEPS} SELECT 1 AS region_id, video_id, track_id, frame_no FROM tc WHERE cx >= 20 AND cx <= 1080 AND cy >= 360 AND cy <= 400")
def j05(t):
    return J.in_region(V.with_centers(t.tracks), t.region("band"), inclusive=True).select("region_id", "video_id", "track_id", "frame_no")


# the line y = 380 from x = 20 to 1080: the step spans it and the crossing point lies on it
LINE = """px IS NOT NULL AND ((py - 380) * (cy - 380) <= 0) AND CASE WHEN py = cy THEN greatest(least(px, cx), 20) <= least(greatest(px, cx), 1080)
 ELSE (px + (cx - px) * (380 - py) / (cy - py)) BETWEEN 20 AND 1080 END"""


@query("j06_step_crosses", "tracks", f"WITH {STEPS} SELECT video_id, track_id, frame_no FROM sp WHERE {LINE}")
def j06(t):
    steps = V.previous_point(t.tracks).filter("px IS NOT NULL")
    return J.step_crosses(steps, t.region("line")).select("video_id", "track_id", "frame_no")


CROSS = f"""{STEPS}, ev AS (SELECT 1 AS region_id, *, cy > py AS goes FROM sp WHERE px IS NOT NULL AND {BAND} UNION ALL SELECT 2, *, cy > py FROM sp WHERE {LINE}),
f1 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY region_id, video_id, track_id ORDER BY frame_no) AS k FROM ev),
fi AS (SELECT * FROM f1 WHERE k = 1)"""


def _lanes(t):
    return t.regions.filter(F.col("region_id") <= 2)


@query("v01_crossing", "tracks", f"WITH {CROSS}, se AS (SELECT DISTINCT video_id, cls FROM tracks), rg AS (SELECT 1 AS region_id UNION ALL SELECT 2) SELECT region_id, video_id, cls, (SELECT count(*) FROM fi WHERE fi.region_id = rg.region_id AND fi.video_id = se.video_id AND fi.cls = se.cls AND goes) AS n_in, (SELECT count(*) FROM fi WHERE fi.region_id = rg.region_id AND fi.video_id = se.video_id AND fi.cls = se.cls AND NOT goes) AS n_out FROM se, rg")
def v01(t):
    return V.count_crossings(t.tracks, _lanes(t)).select("region_id", "video_id", "cls", "n_in", "n_out")


@query("v02_region_counts", "tracks", f"WITH {STEPS} SELECT video_id, frame_no, 1 AS region_id, count(*) AS n FROM tc WHERE {BAND} GROUP BY 1, 2 UNION ALL SELECT video_id, frame_no, region_id, count(*) AS n FROM tc, {SLOTS} WHERE cx > a AND cx < b AND cy > 340 AND cy < 420 GROUP BY 1, 2, 3")
def v02(t):
    return V.region_counts(t.tracks, t.regions.filter(F.size("points") > 2))


@query("v03_queue_length", "tracks", f"WITH {STEPS} SELECT video_id, frame_no, count(*) FILTER (WHERE px IS NOT NULL AND {BAND}) AS n FROM sp GROUP BY 1, 2")
def v03(t):
    return V.queue_length(t.tracks, t.region("band"))


@query("v04_slot_occupancy", "tracks", f"WITH {STEPS}, u AS (SELECT DISTINCT video_id, frame_no, region_id FROM tc, {SLOTS} WHERE trunc(cx) BETWEEN a AND b AND trunc(cy) BETWEEN 340 AND 420) SELECT video_id, frame_no, count(region_id) AS occupied, 2 - count(region_id) AS available FROM (SELECT DISTINCT video_id, frame_no FROM tracks) f LEFT JOIN u USING (video_id, frame_no) GROUP BY 1, 2")
def v04(t):
    return V.slot_occupancy(t.tracks, t.regions.filter(F.col("region_id") >= 3))


# a step meets the closed band when it starts, ends in it or passes its upper or lower edge within it
MEET = """px IS NOT NULL AND ((cx BETWEEN 20 AND 1080 AND cy BETWEEN 360 AND 400) OR (px BETWEEN 20 AND 1080 AND py BETWEEN 360 AND 400)
 OR ((py - 360) * (cy - 360) < 0 AND px + (cx - px) * (360 - py) / (cy - py) BETWEEN 20 AND 1080) OR ((py - 400) * (cy - 400) < 0 AND px + (cx - px) * (400 - py) / (cy - py) BETWEEN 20 AND 1080)
 OR ((px - 20) * (cx - 20) < 0 AND py + (cy - py) * (20 - px) / (cx - px) BETWEEN 360 AND 400) OR ((px - 1080) * (cx - 1080) < 0 AND py + (cy - py) * (1080 - px) / (cx - px) BETWEEN 360 AND 400))"""


@query(
    "v05_speed", "tracks",
    f"WITH {STEPS}, h AS (SELECT *, epoch_us(ts) - epoch_us(pts) AS dt, ROW_NUMBER() OVER (PARTITION BY video_id, track_id ORDER BY frame_no) AS k FROM sp WHERE {MEET})"
    " SELECT 1 AS region_id, video_id, track_id, frame_no, round(CASE WHEN dt > 0 THEN abs(cy - py) * 1e6 / dt END, 6) AS speed FROM h WHERE k = 1",
)
def v05(t):
    return V.speed(t.tracks, t.region("band")).withColumn("speed", F.round("speed", 6))


@query(
    "v06_heatmap", "tracks",
    "WITH b AS (SELECT video_id, trunc(x1)::INT AS x1, trunc(y1)::INT AS y1, trunc(x2)::INT AS x2, trunc(y2)::INT AS y2 FROM tracks), c AS (SELECT *, (x1 + x2) // 2 AS mx, (y1 + y2) // 2 AS my, least(x2 - x1, y2 - y1) // 2 AS r FROM b),"
    " p AS (SELECT video_id, mx, my, r, x1, x2, unnest(range(y1, y2))::INT AS y FROM c), q AS (SELECT video_id, mx, my, r, y, unnest(range(x1, x2))::INT AS x FROM p)"
    " SELECT video_id, x, y, count(*) * 2.0::DOUBLE AS heat FROM q WHERE x >= 0 AND y >= 0 AND x < 640 AND (x - mx) * (x - mx) + (y - my) * (y - my) <= r * r GROUP BY 1, 2, 3",
)
def v06(t):
    return V.heatmap(t.tracks, width=640, height=1000)


@query("v07_frame_counts", "tracks", "SELECT video_id, frame_no, cls, count(*) AS n FROM tracks GROUP BY 1, 2, 3")
def v07(t):
    return V.frame_counts(t.tracks, by_class=True)


@query(
    "v08_track_distance", "tracks",
    "SELECT a.video_id, a.frame_no, round(sqrt(pow(floor((a.x1 + a.x2) / 2) - floor((b.x1 + b.x2) / 2), 2) + pow(floor((a.y1 + a.y2) / 2) - floor((b.y1 + b.y2) / 2), 2)), 6) AS distance FROM tracks a JOIN tracks b ON a.video_id = b.video_id AND a.frame_no = b.frame_no WHERE a.track_id = 4 AND b.track_id = 8",
)
def v08(t):
    return V.track_distance(t.tracks, 4, 8).withColumn("distance", F.round("distance", 6))


ANGLE = "CAST((track_id * 37 + frame_no * 53) % 180 AS DOUBLE)"


@query(
    "v09_count_reps", "tracks",
    f"WITH a AS (SELECT video_id, track_id, frame_no, {ANGLE} AS angle FROM tracks), e AS (SELECT *, CASE WHEN angle < 90 THEN 'down' WHEN angle > 145 THEN 'up' END AS ev FROM a),"
    " l AS (SELECT *, last_value(ev IGNORE NULLS) OVER (PARTITION BY video_id, track_id ORDER BY frame_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS le FROM e)"
    " SELECT video_id, track_id, frame_no, coalesce(ev, le, '-') AS stage, CAST(sum(CASE WHEN ev = 'down' AND le = 'up' THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, track_id ORDER BY frame_no) AS BIGINT) AS reps FROM l",
)
def v09(t):
    angle = ((F.col("track_id") * 37 + F.col("frame_no") * 53) % 180).cast("double")
    return V.count_reps(t.tracks.select("video_id", "track_id", "frame_no", angle.alias("angle"))).drop("angle")


@query("v09_keypoint_angle", "det", "SELECT image_id, det_id, round(abs((atan2((y1 + y2) / 2 - y1, (x1 + x2) / 2 - x2) - atan2(0, x1 - x2)) * 180 / pi()), 6) AS angle FROM det")
def v09k(t):
    d = t.det.withColumn("keypoints", keypoints_of("det_id"))
    return V.with_angle(d, 0, 1, 4).select("image_id", "det_id", *r6(angle=F.col("angle")))


@query("v10_alarm", "tracks", "WITH c AS (SELECT video_id, frame_no, count(*) AS n FROM tracks GROUP BY 1, 2) SELECT video_id, min(frame_no) AS frame_no, arg_min(n, frame_no) AS objects FROM c WHERE n > 12 GROUP BY 1")
def v10(t):
    return V.alarm(t.tracks, 12)


@query("v11_zone", "tracks", f"WITH {STEPS} SELECT video_id, track_id, frame_no FROM tc WHERE cx BETWEEN 150 AND 900 AND cy BETWEEN 350 AND 390")
def v11(t):
    zone = [(150, 350), (900, 390), (900, 350), (150, 390), (400, 360)]
    return V.restrict_to_zone(t.tracks, zone).select("video_id", "track_id", "frame_no")


@query(
    "w01_track_line", "tracks",
    f"WITH {STEPS}, l AS (SELECT video_id, track_id, frame_no, count(*) OVER w AS points, sum(cx) OVER w AS sx, first_value(cx) OVER w AS first_x FROM tc WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame_no ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))"
    " SELECT video_id, track_id, frame_no, CAST(points AS INT) AS points, round(sx, 6) AS sx, round(first_x, 6) AS first_x FROM l",
)
def w01(t):
    line = V.track_line(t.tracks)
    total = F.aggregate("line", F.lit(0.0), lambda a, p: a + p["x"])
    return line.select("video_id", "track_id", "frame_no", F.size("line").alias("points"), *r6(sx=total, first_x=F.col("line")[0]["x"]))


@query(
    "w02_running_counts", "tracks",
    f"WITH {CROSS}, g AS (SELECT region_id, video_id, frame_no, sum(goes::INT) AS i, sum((NOT goes)::INT) AS o FROM fi GROUP BY 1, 2, 3)"
    " SELECT region_id, video_id, frame_no, CAST(sum(i) OVER w AS BIGINT) AS total_in, CAST(sum(o) OVER w AS BIGINT) AS total_out FROM g WINDOW w AS (PARTITION BY region_id, video_id ORDER BY frame_no)",
)
def w02(t):
    return V.running_counts(V.crossings(t.tracks, _lanes(t)))


@query("w03_last_points", "tracks", "WITH c AS (SELECT video_id, frame_no, count(*) AS n FROM tracks GROUP BY 1, 2), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY video_id ORDER BY frame_no DESC) AS k FROM c) SELECT video_id, frame_no, n FROM r WHERE k <= 45")
def w03(t):
    return V.last_points(V.frame_counts(t.tracks))


@query(
    "w09_track_sequences", "tracks",
    "WITH s AS (SELECT video_id, track_id, frame_no, list(frame_no) OVER (PARTITION BY video_id, track_id ORDER BY frame_no ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS f FROM tracks WHERE frame_no % 2 = 0),"
    " c AS (SELECT *, min(frame_no) OVER (PARTITION BY video_id) AS first FROM s WHERE len(f) = 8) SELECT video_id, track_id, frame_no, f[1] AS start FROM c WHERE frame_no % 12 = 0 OR frame_no = first",
)
def w09(t):
    s = V.track_sequences(t.tracks)
    return s.select("video_id", "track_id", "frame_no", F.col("frames")[0].alias("start"))


@query(
    "w08_embedding_ema", "",
    "WITH RECURSIVE e AS (SELECT label AS track_id, vec_id, embedding, ROW_NUMBER() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings),"
    " v AS (SELECT track_id, vec_id, k, list_transform(embedding, lambda x: x::DOUBLE) AS f FROM e), u AS (SELECT track_id, vec_id, k, list_transform(f, lambda x: x / sqrt(list_sum(list_transform(f, lambda y: y * y)))) AS f FROM v),"
    " r AS (SELECT track_id, vec_id, k, f AS s FROM u WHERE k = 1 UNION ALL SELECT track_id, vec_id, k, list_transform(m, lambda x: x / sqrt(list_sum(list_transform(m, lambda y: y * y)))) FROM"
    " (SELECT u.track_id, u.vec_id, u.k, list_transform(list_zip(r.s, u.f), lambda z: 0.9::DOUBLE * z[1] + 0.1::DOUBLE * z[2]) AS m FROM r JOIN u ON u.track_id = r.track_id AND u.k = r.k + 1) q)"
    " SELECT track_id, vec_id, round(s[1], 6) AS s0, round(s[64], 6) AS s63 FROM r",
)
def w08(t):
    e = t.table("embeddings").select(F.col("label").alias("track_id"), "vec_id", "embedding")
    out = V.embedding_ema(e, keys=("track_id",), order="vec_id")
    return out.select("track_id", "vec_id", *r6(s0=F.col("smooth")[0], s63=F.col("smooth")[63]))


@query(
    "t04_track_sessions", "tracks",
    "WITH p AS (SELECT video_id, track_id, frame_no, lag(frame_no) OVER w AS q FROM tracks WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame_no)),"
    " l AS (SELECT *, sum(CASE WHEN q IS NULL OR frame_no - q > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, track_id ORDER BY frame_no) AS life FROM p)"
    " SELECT video_id, track_id, CAST(life AS BIGINT) AS life, min(frame_no) AS start_frame, max(frame_no) AS end_frame, count(*) AS length FROM l GROUP BY 1, 2, 3",
)
def t04(t):
    return V.track_sessions(t.tracks, 5)


@query(
    "s21_regions_of_videos", "tracks",
    "WITH c AS (SELECT *, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM tracks), r AS (SELECT video_id, floor(min(cx)) AS lx, floor(avg(cx)) + 1 AS hx, floor(min(cy)) - 1 AS ly, floor(avg(cy)) AS hy FROM c GROUP BY video_id)"
    " SELECT c.video_id, c.frame_no, c.video_id + 100 AS region_id, count(*) AS n FROM c JOIN r USING (video_id) WHERE cx > lx AND cx < hx AND cy > ly AND cy < hy GROUP BY 1, 2, 3",
)
def s21(t):
    """Each video's own region, from a JSON file written out of the tracks, counted in that video only."""
    c = V.with_centers(t.tracks)
    r = c.groupBy("video_id").agg(
        F.floor(F.min("cx")).alias("lx"), (F.floor(F.avg("cx")) + 1).alias("hx"), (F.floor(F.min("cy")) - 1).alias("ly"), F.floor(F.avg("cy")).alias("hy")
    )
    corners = F.array(*[F.array(F.col(x).cast("double"), F.col(y).cast("double")) for x, y in (("lx", "ly"), ("hx", "ly"), ("hx", "hy"), ("lx", "hy"))])
    path = scratch_path(t.spark, "regions")
    r.select((F.col("video_id") + 100).alias("region_id"), "video_id", corners.alias("points")).write.json(path)
    return V.region_counts(t.tracks, read_regions(t.spark, path, multiline=False)).select("video_id", "frame_no", "region_id", "n")
